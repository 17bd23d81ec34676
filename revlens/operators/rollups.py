"""Aggregates: scores, profiles, metrics, dedupe, clusters and tables."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import checkpointed

# Points that a violation costs by severity; any other severity costs REST.
SEVERITY = {"critical": 25.0, "high": 15.0, "medium": 8.0, "low": 3.0}
REST = 5.0


def compliance_score(severity: Column) -> Column:
    """Aggregate: 100 less the points of all violations, within 0 and 100, at two places; none gives 100."""
    points = F.lit(REST)
    for name, value in SEVERITY.items():
        points = F.when(severity == name, value).otherwise(points)
    lost = F.coalesce(F.sum(F.when(severity.isNotNull(), points)), F.lit(0.0))
    return F.round(F.least(F.greatest(100.0 - lost, F.lit(0.0)), F.lit(100.0)), 2)


def mean_confidence(value: Column, empty: float = 0.95) -> Column:
    """Aggregate: mean within 0 and 1 at four places; ``empty`` where there is none."""
    return F.round(F.least(F.greatest(F.coalesce(F.avg(value), F.lit(empty)), F.lit(0.0)), F.lit(1.0)), 4)


def matched_share(matched: Column) -> Column:
    """Aggregate: percent of rows matched at two places; no rows give 100."""
    return F.coalesce(F.round(100.0 * F.avg(matched.cast("double")), 2), F.lit(100.0))


def counts_by(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of each listed value as columns, zero where there are none."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def histogram(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Per group the number of rows and a histogram of a column as text, ``value:count`` in order of value."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).cast("string").alias("v"), "n")))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["v"], p["n"])), ",")
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), shown.alias("histogram"))


def mode_first_seen(df: DataFrame, by: list[str], column: str, order: str) -> DataFrame:
    """The most frequent value of each group; the one seen first wins ties."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*by).agg(F.max_by(column, F.struct("n", -F.col("seen"))).alias("mode"), F.max("n").alias("n"))


def dedupe_by_digest(df: DataFrame, text_col: str, order: str) -> DataFrame:
    """First row of each distinct text, with the number of rows it stands for."""
    return df.groupBy(F.sha2(text_col, 256).alias("digest")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n"))


def classification_counts(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1; undefined ratios are null, but f1 is 0 where there was something to find."""
    n = df.groupBy(*by).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn")
    )
    p = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return n.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def retrieval_metrics(hits: DataFrame, k: int, by: list[str]) -> DataFrame:
    """recall@k, mean reciprocal rank and precision@k of queries (query_id, rank of each relevant hit or null, n_returned)."""
    per = hits.groupBy(*by, "query_id").agg(
        F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("relevant"), F.max("n_returned").alias("returned")
    )
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.try_divide(F.sum("relevant").cast("double"), F.sum(F.least(F.lit(k), F.col("returned")))), 6).alias("precision_at_k"),
    )


def chance_recall(n: int, k: int, relevant: int) -> Column:
    """Chance that k random picks of n hold one of the relevant: hypergeometric."""
    if relevant <= 0 or n <= 0:
        return F.lit(0.0)
    steps = F.sequence(F.lit(0), F.lit(min(relevant, n) - 1))
    miss = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(n - k) - i, F.lit(0)) / (F.lit(n) - i))
    return F.round(1 - miss, 6)


def chance_mrr(n: int) -> Column:
    return F.round(F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda acc, i: acc + 1.0 / i) / n, 6)


def trimmed_bounds(df: DataFrame, by: list[str], value: str, spread: float = 2.0) -> DataFrame:
    """Least and greatest value within ``spread`` interquartile ranges of the quartiles; groups under four are left whole.

    A quartile is the value at place floor(n * q) of the sorted values, found by ranks, not by gathering the group.
    """
    w = Window.partitionBy(*by).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(
        *by, value, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n")
    )
    quartiles = ranked.groupBy(*by).agg(
        *[F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col(value))).alias(f"q{int(q * 4)}") for q in (0.25, 0.75)],
        F.max("n").alias("n"),
    )
    low = F.col("q1") - spread * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + spread * (F.col("q3") - F.col("q1"))
    rows = df.join(quartiles, by).where((F.col("n") < 4) | F.col(value).between(low, high))
    return rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n_kept"))


def bounds(df: DataFrame, by: list[str], x: str, y: str, reach: Column, padding: float = 0.05) -> DataFrame:
    """Extent of points with a reach (a circle's radius), padded by a share of each side."""
    e = df.groupBy(*by).agg(
        F.min(F.col(x) - reach).alias("x0"), F.max(F.col(x) + reach).alias("x1"),
        F.min(F.col(y) - reach).alias("y0"), F.max(F.col(y) + reach).alias("y1"),
    )
    px, py = padding * (F.col("x1") - F.col("x0")), padding * (F.col("y1") - F.col("y0"))
    return e.select(*by, (F.col("x0") - px).alias("xmin"), (F.col("y0") - py).alias("ymin"), (F.col("x1") + px).alias("xmax"), (F.col("y1") + py).alias("ymax"))


def promoted(df: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Keys that occur ``least`` times or more."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def majority_baseline(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Share of the most frequent label at four places."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.round(F.max("n") / F.sum("n"), 4).alias("baseline"), F.sum("n").alias("n"))


def category_rollup(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """Changed and matched counts and a status: CHANGED where anything isn't matched."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(status) != "MATCHED").alias("n_changed"),
        F.count_if(F.col(status) == "MATCHED").alias("n_matched"),
        F.when(F.bool_or(F.col(status) != "MATCHED"), "CHANGED").otherwise("MATCHED").alias("status"),
    )


def grouping_summary(df: DataFrame, a: str, b: str, top: int) -> DataFrame:
    """Counts by a, by b and by both, the ``top`` most frequent of each grouping; ties by value."""
    g = df.groupingSets([[a], [b], [a, b]], a, b).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("level").orderBy(F.desc("n"), F.col(a).asc_nulls_first(), F.col(b).asc_nulls_first())
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def canonical_duplicates(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Groups of two rows or more: the oldest is canonical, with how many others it replaces."""
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order, id_col)).alias("first"), (F.count(F.lit(1)) - 1).alias("n_others"))
        .where("n_others > 0")
        .select(*keys, F.col(f"first.{id_col}").alias("canonical"), "n_others")
    )


def version_histogram(df: DataFrame, version: Column, current: int) -> DataFrame:
    """Rows by version, null being unstamped, and whether that is stale."""
    return df.groupBy(F.coalesce(version.cast("string"), F.lit("unstamped")).alias("version"), (version.isNull() | (version < current)).alias("stale")).agg(
        F.count(F.lit(1)).alias("n")
    )


def verification_matrix(items: DataFrame, findings: DataFrame, keys: list[str], seen: str, bad: Column) -> DataFrame:
    """Every item of a taxonomy with its findings: PASS, DISCREPANCY, NO_SIGNAL (item seen, nothing found) or UNCHECKED."""
    n = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
    zero = F.lit(0)
    return items.join(n, keys, "left").select(
        *keys,
        F.coalesce("n", zero).alias("n"),
        F.coalesce("n_bad", zero).alias("n_bad"),
        F.when(F.col("n_bad") > 0, "DISCREPANCY").when(F.col("n") > 0, "PASS").when(F.col(seen), "NO_SIGNAL").otherwise("UNCHECKED").alias("verdict"),
    )


def flood_box(points: pd.DataFrame, reach: float, max_w: float, max_h: float) -> tuple[float, float, float, float]:
    """A box that grows, in the order of the points, by each point within ``reach`` of it, until none is added.

    Starts at the first point; a point that would take it over the largest width or height is passed over.
    """
    p = points.sort_values("ord")[["x", "y"]].to_numpy()
    box = [p[0][0], p[0][1], p[0][0], p[0][1]]
    left = list(range(1, len(p)))
    while True:
        rest = []
        for i in left:
            x, y = p[i]
            near = box[0] - reach <= x <= box[2] + reach and box[1] - reach <= y <= box[3] + reach
            grown = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            if near and grown[2] - grown[0] <= max_w and grown[3] - grown[1] <= max_h:
                box = grown
            else:
                rest.append(i)
        if len(rest) == len(left):
            return tuple(box)
        left = rest


def flood_boxes(df: DataFrame, by: str, reach: float, max_w: float = 1e6, max_h: float = 1e6) -> DataFrame:
    """The flood box of each group (by, ord, x, y); order matters, so a group, that of one sheet, is one task's."""

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf[by].iloc[0], *flood_box(pdf, reach, max_w, max_h))], columns=[by, "xmin", "ymin", "xmax", "ymax"])

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, "ord", "x", "y").groupBy(by).applyInPandas(grown, f"{by} {kind}, xmin double, ymin double, xmax double, ymax double")


def row_grid(pdf: pd.DataFrame, pitch: float) -> pd.DataFrame:
    """Rows of a table from its cells (ord, x, y), top down: a cell joins the row whose running mean y is within ``pitch``."""
    pdf = pdf.sort_values(["y", "x", "ord"], ascending=[False, True, True])
    row, mean, n, rows = -1, None, 0, []
    for y in pdf["y"]:
        if mean is None or abs(y - mean) > pitch:
            row, mean, n = row + 1, y, 1
        else:
            mean, n = (mean * n + y) / (n + 1), n + 1
        rows.append(row)
    return pdf.assign(row=rows)


def table_rows(df: DataFrame, by: str, pitch: float) -> DataFrame:
    """``by, ord, x, y, row, col``: cells in rows (see :func:`row_grid`) and in order of x within them."""
    kind = df.schema[by].dataType.simpleString()

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        return row_grid(pdf, pitch)

    out = df.select(by, "ord", "x", "y").groupBy(by).applyInPandas(placed, f"{by} {kind}, ord long, x double, y double, row int")
    return out.withColumn("col", F.row_number().over(Window.partitionBy(by, "row").orderBy("x", "ord")) - 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, cluster``: the least node that each node of ``edges`` is linked with, over any number of steps.

    Each round hangs every node on the least label among its neighbours and then on that label's own, so reach doubles;
    rounds go on until none changes. Each is written out by checkpoint(), so plans stay short and lost executors cost one round.
    """
    context = edges.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir")
        if root is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="revlens-")
        context.setCheckpointDir(root)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct().checkpoint()
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("cluster")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("cluster").alias("near"))
        hop = label.select(F.col("u").alias("h"), F.col("cluster").alias("far"))
        step = label.join(near, "u").withColumn("low", F.least("cluster", "near"))
        step = step.join(hop, F.col("low") == F.col("h"), "left").select("u", "cluster", F.least("low", "far").alias("new"))
        step = step.checkpoint()
        label = step.select("u", F.col("new").alias("cluster"))
        if step.where("new <> cluster").isEmpty():
            return label.withColumnRenamed("u", "node")


def linked_points(points: DataFrame, by: str, id_col: str, radius: float) -> DataFrame:
    """``node, cluster``: single-linkage clusters of points (by, id_col, x, y) within ``radius`` in their group; the least id names one. A point without a group or place is alone.

    Points of one cell, whose diagonal is a quarter of the radius, are linked anyway, so cells stand for them. Two cells are linked surely where the far corners of
    their points' boxes are within the radius, and never where the near ones aren't. Points are held against each other only for pairs of cells that this leaves open and
    that no chain of sure links joins, so pairs of points don't grow with the square of a dense place.
    """
    side = radius / 4 / 2**0.5
    cell = [by, "cx", "cy"]
    placed = points.where(F.col(by).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    placed = placed.select(by, F.col(id_col).alias("id"), "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    cells = checkpointed(placed.groupBy(*cell).agg(F.min("id").alias("id"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    reach = 6  # cells of a radius and one more, either way; a block is as wide
    block = [F.floor(F.col(c) / reach) for c in ("cx", "cy")]
    a = cells.select(F.col(by).alias("g"), block[0].alias("bx"), block[1].alias("by"), F.struct(*cells.columns).alias("a"))
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    b = cells.select(F.col(by).alias("g"), block[0].alias("bx"), block[1].alias("by"), F.struct(*cells.columns).alias("b"), shifts)
    b = b.select("g", (F.col("bx") + F.col("s.i")).alias("bx"), (F.col("by") + F.col("s.j")).alias("by"), "b")
    gap = lambda c: F.greatest(F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.lit(0.0))
    span = lambda c: F.greatest(F.col(f"b.{c}1") - F.col(f"a.{c}0"), F.col(f"a.{c}1") - F.col(f"b.{c}0"))
    after = (F.col("a.cx") < F.col("b.cx")) | ((F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") < F.col("b.cy")))
    pairs = a.join(b, ["g", "bx", "by"]).where(after & (F.hypot(gap("x"), gap("y")) <= radius * (1 + 1e-12)))
    pairs = pairs.select("a", "b", (F.hypot(span("x"), span("y")) <= radius * (1 - 1e-12)).alias("sure"))
    own = points.select(F.col(id_col).alias("a"), F.col(id_col).alias("b"))
    stars = placed.join(cells.select(*cell, F.col("id").alias("a")), cell).select("a", F.col("id").alias("b")).union(own)
    sure = pairs.where("sure").select("a.id", F.col("b.id").alias("other")).toDF("a", "b")
    first = checkpointed(components(stars.union(sure)))  # also joins places of one id
    label = lambda c: first.select(F.col("node").alias(f"n_{c}"), F.col("cluster").alias(f"c_{c}"))
    open_ = pairs.where("not sure").join(label("a"), F.col("a.id") == F.col("n_a")).join(label("b"), F.col("b.id") == F.col("n_b")).where("c_a <> c_b")
    ends = lambda c: placed.select(*[F.col(k).alias(f"{k}_{c}") for k in (*cell, "x", "y")])
    met = checkpointed(open_.select("c_a", "c_b", *[F.col(f"{c}.{k}").alias(f"{k}_{c}") for c in "ab" for k in cell]))
    met = met.join(ends("a"), [f"{k}_a" for k in cell]).join(ends("b"), [f"{k}_b" for k in cell])
    more = checkpointed(met.where(F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) <= radius).select("c_a", "c_b").distinct())
    if more.isEmpty():
        return first
    second = components(more, "c_a", "c_b").select(F.col("node").alias("cluster"), F.col("cluster").alias("low"))
    return first.join(second, "cluster", "left").select("node", F.coalesce("low", "cluster").alias("cluster"))


def largest_cluster(labels: DataFrame, by: list[str], cluster: str, least: int = 3) -> DataFrame:
    """The cluster of most members in each group, if it has ``least``; ties go to the least label."""
    n = labels.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.groupBy(*by).agg(F.max_by(cluster, F.struct("n", -F.col(cluster))).alias(cluster), F.max("n").alias("n"))
