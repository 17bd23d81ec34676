"""Readers and writers: text and Markdown sections, JSON lines, corpora by manifest, slices replaced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FENCE = r"(?ms)^```.*?^```[^\n]*$"
HEADING = r"(?m)^#{1,6}[ \t]+"


def heading_chunks(docs: DataFrame, key: str, text: str, least: int = 24) -> DataFrame:
    """``key, no, heading, body``: Markdown cut at its headings, fenced code taken out.

    A chunk is a heading and what follows it; what stands before the first has an empty heading. Chunks whose heading and body
    have under ``least`` characters are left out. A heading met before in its document gets ``#2``, ``#3`` and so on.
    """
    plain = F.regexp_replace(F.col(text), FENCE, "")
    marked = F.regexp_replace(plain, HEADING, "\x01$0")
    parts = docs.select(key, F.posexplode(F.split(marked, "\x01")).alias("no", "part"))
    is_heading = F.col("part").rlike(r"^#{1,6}[ \t]+")
    heading = F.when(is_heading, F.trim(F.regexp_replace(F.substring_index("part", "\n", 1), r"^#{1,6}[ \t]+", ""))).otherwise("")
    line = F.length(F.substring_index("part", "\n", 1))
    body = F.when(is_heading, F.expr("substring(part, length(substring_index(part, '\n', 1)) + 2)")).otherwise(F.col("part"))
    rows = parts.select(key, "no", heading.alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), line.alias("_line"))
    rows = rows.where(F.length(F.trim(F.concat_ws(" ", "heading", "body"))) >= least).drop("_line")
    nth = F.row_number().over(Window.partitionBy(key, "heading").orderBy("no"))
    return rows.withColumn("heading", F.when(nth > 1, F.concat("heading", F.lit("#"), nth.cast("string"))).otherwise(F.col("heading")))


def section_chunks(docs: DataFrame, key: str, text: str, most: int = 1000) -> DataFrame:
    """``key, section, chunk, first_line, last_line, body``: lines of texts in sections, cut after ``most`` characters.

    A section starts at a line with ``#`` or a number like ``1.2 Title``; before the first it is General. A chunk ends with the
    line that brings it to ``most`` characters (running sums of line lengths decide), and with its section.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    start = F.col("body").rlike(r"^#+ *\S|^\d+\.\d+ [A-Z]")
    order = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumn("_s", F.sum(start.cast("int")).over(order))
    within = Window.partitionBy(key, "_s").orderBy("line")
    name = F.first(F.when(start, F.trim(F.regexp_replace("body", "^#+ *", "")))).over(within)
    before = F.coalesce(F.sum(F.length("body") + 1).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumns({"section": F.coalesce(name, F.lit("General")), "_c": F.floor(before / most)})
    chunks = lines.groupBy(key, "_s", "_c").agg(
        F.min("section").alias("section"), F.min("line").alias("first_line"), F.max("line").alias("last_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("body"),
    )
    return chunks.where(F.length(F.trim("body")) > 0).select(key, "section", F.col("_c").cast("int").alias("chunk"), "first_line", "last_line", "body")


def sheet_rows(cells: DataFrame, by: list[str], row: str, column: str, text: str, bold: str, mark: str, rows_each: int = 10) -> DataFrame:
    """``by, chunk, body``: cells of sheets as lines, ten rows a chunk, begun anew with each sheet.

    A row's cells are joined by `` | ``, bold ones between ``**``; the strongest mark of a row (red, green, yellow in this order)
    stands before it. Empty cells and rows are left out.
    """
    shown = F.when(F.col(bold), F.concat(F.lit("**"), F.col(text), F.lit("**"))).otherwise(F.col(text))
    held = cells.where(F.coalesce(F.col(text) != "", F.lit(False)))
    strength = F.when(F.col(mark) == "red", 1).when(F.col(mark) == "green", 2).when(F.col(mark) == "yellow", 3)
    lines = held.groupBy(*by, row).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column), shown.alias("s")))), lambda c: c["s"]), " | ").alias("line"),
        F.min(strength).alias("_m"),
    )
    prefix = F.when(F.col("_m") == 1, "[red] ").when(F.col("_m") == 2, "[green] ").when(F.col("_m") == 3, "[yellow] ").otherwise("")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(row)) - 1
    lines = lines.withColumn("chunk", F.floor(nth / rows_each).cast("int")).withColumn("line", F.concat(prefix, "line"))
    return lines.groupBy(*by, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, "line"))), lambda x: x["line"]), "\n").alias("body"))


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with its columns in order of name; nulls are kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    """One canonical JSON object a line, in as many files as there are partitions."""
    df.select(canonical_json(df).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines; missing fields are null, unknown ones left out, and a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corpus(manifest: DataFrame, payload: DataFrame, key: str, held_out: str, reason: str = "", origin: Column | None = None) -> DataFrame:
    """Payload rows of the manifest's entries; held-out ones only for a stated reason, others by origin where one is given."""
    wanted = manifest if reason.strip() else manifest.where(~F.coalesce(F.col(held_out), F.lit(False)))
    wanted = wanted if origin is None else wanted.where(origin)
    return payload.join(wanted.select(key).distinct(), key, "left_semi")


def checksums(manifest: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, problem``: entries without a file (missing) and those whose file differs (drift), told apart."""
    both = manifest.select(key, F.col(digest).alias("_want")).join(found.select(key, F.col(digest).alias("_have"), F.lit(True).alias("_is")), key, "left")
    problem = F.when(F.col("_is").isNull(), "missing").when(~F.col("_want").eqNullSafe(F.col("_have")), "drift")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def replace_slices(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``current`` with all rows of the keys of ``new`` replaced by the new ones."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(*current.columns).union(new.select(*current.columns))


def write_slices(new: DataFrame, path: str, key: str) -> None:
    """Overwrites just the slices (partitions by ``key``) that ``new`` holds; the others stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def entities(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """One slice of a table partitioned by ``key``: other slices' files aren't opened."""
    return spark.read.parquet(path).where(F.col(key) == value)
