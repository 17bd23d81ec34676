"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as ``<turn:ROLE>TEXT</turn>`` and a line break. In roles and texts a backslash becomes ``\\b``, ``<`` becomes
``\\l`` and ``>`` becomes ``\\g``; so no text can hold a mark of the template, and reading backwards is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
TURN = r"<turn:([^>]*)>([^<]*)</turn>"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
PER_TURN = 4  # tokens of the marks
CHUNK = 256


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for n in names:
        on &= F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return on


def _numbered(turns: DataFrame, half: int) -> DataFrame:
    """Turns with idx (place in the conversation), start and end (prefix sums of tokens) and large (large turns before).

    The sums are taken over chunks of turn numbers first and then within the chunks, so that one huge
    conversation is not summed up in one task.
    """
    size = F.regexp_count("text", F.lit(TOKEN)) + PER_TURN
    rows = turns.withColumns({"tokens": size.cast("long"), "chunk": F.floor(F.col("turn") / CHUNK)})
    rows = rows.withColumn("big", (F.col("tokens") > half).cast("long"))
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"), F.sum("big").alias("b")
    )
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        "conv_id", "chunk", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("t", "c", "b")]
    )
    within = Window.partitionBy("x.conv_id", "x.chunk").orderBy("turn", "role", "text")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("t0") + F.sum("tokens").over(running)
    return (
        rows.alias("x")
        .join(chunks.alias("y"), _same("x", "y", "conv_id", "chunk"))
        .select(
            "x.conv_id",
            "role",
            "text",
            "big",
            (F.col("c0") + F.row_number().over(within) - 1).alias("idx"),
            (end - F.col("tokens")).alias("start"),
            end.alias("end"),
            (F.col("b0") + F.sum("big").over(running) - F.col("big")).alias("large"),
        )
    )


def windows(
    conversations: DataFrame, new_tokens: int = 1024, history_tokens: int = 256, target_role: str = "assistant"
) -> DataFrame:
    """``conv_id, window, formatted, loss_spans, repeated``: each conversation (conv_id, turn, role, text) in windows.

    Every turn is new in just one window. A window takes new turns of at most ``new_tokens`` tokens together, or one
    turn of more than half of them; before them come the conversation's first turn, if that is a system turn, and
    the turns just before, whole, up to ``history_tokens``. ``repeated`` counts the turns that are not new; they come
    first. ``loss_spans`` holds the stretches (start, end in code points of ``formatted``) of new texts of the
    target role: each such text is under the mask once. Windows are numbered by the place of their first new
    turn.

    Prefix sums of tokens decide all that. Null texts and roles are empty ones; null ids form a conversation
    and null turns come first; equal turn numbers are ordered by role and text, and repeated rows are turns of
    their own. Extra columns are ignored.
    """
    half = new_tokens // 2
    turns = conversations.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    rows = _numbered(turns, half)
    span = {"k": F.floor(F.col("start") / half), "g": 2 * F.col("large") + F.col("big")}
    rows = rows.withColumns(span)
    first = Window.partitionBy("conv_id", "k", "g")
    rows = rows.withColumns({"window": F.min("idx").over(first), "at": F.min("start").over(first)})
    body = ["role", "text"]
    new = rows.select("conv_id", "window", "idx", F.lit(True).alias("new"), *body)
    spans = rows.where("idx = window").select("conv_id", "window", "at")
    system = rows.where("idx = 0 and role = 'system'").select("conv_id", "idx", *body)
    kept = (
        spans.where("window > 0").alias("x").join(system.alias("y"), _same("x", "y", "conv_id"))
        .select("x.conv_id", "window", "idx", F.lit(False), *body)
    )
    places = F.sequence(F.floor(F.col("end") / history_tokens), F.floor(F.col("start") / history_tokens) + 1)
    past = rows.where(~((F.col("idx") == 0) & (F.col("role") == "system"))).where(
        F.col("end") - F.col("start") <= history_tokens
    )
    past = past.select("conv_id", "idx", "start", "end", *body, F.explode(places).alias("place"))
    near = spans.withColumn("place", F.floor(F.col("at") / history_tokens))
    history = (
        past.alias("x")
        .join(near.alias("y"), _same("x", "y", "conv_id") & (F.col("x.place") == F.col("y.place")))
        .where((F.col("at") >= F.col("end")) & (F.col("at") - F.col("start") <= history_tokens))
        .select("x.conv_id", "window", "idx", F.lit(False), *body)
    )
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"))
    text = escape(F.col("text"))
    items = new.union(kept).union(history).select("conv_id", "window", "idx", "new", "role", head.alias("head"), text.alias("body"))
    items = items.withColumn("line", F.concat("head", "body", F.lit("</turn>\n")))
    own = Window.partitionBy("conv_id", "window").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("line")).over(own), F.lit(0)) + F.length("head")
    stretch = F.struct(offset.alias("start"), (offset + F.length("body")).alias("end"))
    items = items.withColumn("loss", F.when(F.col("new") & (F.col("role") == target_role), stretch))
    grouped = items.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("lines"),
        F.sort_array(F.collect_list("loss")).alias("loss_spans"),
        F.sum(F.when(F.col("new"), 0).otherwise(1)).alias("repeated"),
    )
    return grouped.select(
        "conv_id", "window", F.array_join("lines.line", "").alias("formatted"), "loss_spans", F.col("repeated").cast("int")
    )


def read_turns(formatted: Column, repeated: Column) -> Column:
    """The new turns of a window, read back: array of struct(role, text)."""
    pattern = F.lit(TURN)
    found = F.arrays_zip(
        F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("role"),
        F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("text"),
    )
    fresh = F.slice(found, repeated + 1, F.greatest(F.size(found) - repeated, F.lit(0)))
    return F.transform(fresh, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under a window's loss mask, read back."""
    parts = F.transform(loss_spans, lambda s: F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))
    return unescape(F.array_join(parts, ""))
