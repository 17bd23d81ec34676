"""Measuring a comparison: sheets changed on purpose with the truth beside them, and what each setting of its constants does to the result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import checkpointed

# Operators with their weights, zones by operator in the order in which they are looked at, categories of zones, texts that are put in, steps of numbers.
WEIGHTS = {"edit_text": 4, "delete_text": 2, "insert_text": 2, "edit_dimension_measurement": 3, "edit_title_field": 2, "restyle_dimension_text": 2, "translate_entities": 2}
ZONES = {
    "edit_text": ["notes", "views", "bom", "iso"], "delete_text": ["notes", "views", "bom"], "insert_text": ["notes", "views", "bom"], "edit_dimension_measurement": ["views"],
    "edit_title_field": ["title"], "restyle_dimension_text": ["views"], "translate_entities": ["views", "notes"],
}
CATEGORIES = {"notes": "notes_section", "views": "drawing_views", "bom": "bill_of_materials", "iso": "isometric_view", "title": "title_block"}
INSERTED = ["追加注記", "※ 要確認", "NEW NOTE", "追加 3-M8"]
STEPS, MEASURES, LETTERS = [1, 2, 5, 10, -1, -5], [1.0, 2.5, 5.0, -1.0, -2.5], ["A", "B", "2"]
UNCHANGED = 0.2  # share of sheets that stay as they are


def drawn(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that follows from the seed and the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.lit(p) if isinstance(p, str) else p for p in parts]), 11) / float(1 << 53)


def _one_of(values: Sequence, share: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(share * len(values)).cast("int"))


def bumped(text: Column, share: Column) -> Column:
    """A text with its first number moved by a step, as wide as before and not below zero; without a number, with a letter or 2 at the end. Numbers of over 18 digits get that end, too."""
    digits = F.regexp_extract(text, r"\d+", 0)
    value = F.greatest(F.try_to_number(digits, F.lit("9" * 18)).cast("long") + _one_of(STEPS, share), F.lit(0)).cast("string")
    wide = F.when(F.char_length(digits) > F.char_length(value), F.lpad(value, F.char_length(digits), F.lit("0"))).otherwise(value)
    at = F.instr(text, digits)
    moved = F.concat(F.substring(text, F.lit(1), at - 1), wide, F.substring(text, at + F.char_length(digits), F.char_length(text)))
    return F.when((digits != "") & value.isNotNull(), moved).otherwise(F.concat(text, _one_of(LETTERS, share)))


def retargeted(text: Column, value: Column) -> Column:
    """A text with its first number, decimals and all, set to ``value``; the value alone without one."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value), r"0+$", ""), r"\.$", "")
    return F.when(text.rlike(r"\d"), F.regexp_replace(text, r"^(\D*)\d+(?:\.\d+)?", F.concat(F.lit("$1"), shown))).otherwise(shown)


@dataclass
class Mutation:
    entities: DataFrame  # the changed sheets, with the columns of the given ones
    truth: DataFrame  # sheet, operator, category, status, old_ord, new_ord, old_text, new_text
    plan: DataFrame  # sheet, step, operator, zone, ord: what was done to what (ord null: nothing fitted)


def mutate(entities: DataFrame, seed: int, edits: int = 3, operators: Sequence[str] | None = None) -> Mutation:
    """Sheets with ``edits`` changes each, drawn by hash of (seed, sheet, step), so that any partitioning gives the same.

    entities: ``sheet, ord, kind, text, x, y, zone, measurement``, ord unique in a sheet. One sheet in five stays as it is. Else each step draws an operator by weight (or takes the given ones in turn), the first zone, in an order drawn for it, that offers a
    target that no step before has touched, and of those the one that comes first by hash. Texts need a text; dimensions a measurement. Editing moves a number, deleting and inserting (beside the target) do what they say, and a dimension's text goes along with its measurement:
    these are in the truth. Restyling changes a dimension's text alone, translating moves the target by up to three units each way: no findings. A step without a target is in the plan without an ord. Sheets of any size are dealt with by aggregates; no sheet is gathered.
    """
    e = entities
    sheets = e.select("sheet").distinct()
    if operators is None:
        sheets = sheets.where(drawn(seed, F.col("sheet"), "none") >= UNCHANGED)
    bounds, total, low = [], sum(WEIGHTS.values()), 0
    for name, w in WEIGHTS.items():
        low += w
        bounds.append((name, low / total))
    texts = F.btrim(F.coalesce("text", F.lit(""))) != ""
    whole = e.withColumn("__dim", (F.col("kind") == "dimension") & F.col("measurement").isNotNull())
    taken: DataFrame | None = None
    plan: DataFrame | None = None
    for step in range(len(operators) if operators is not None else edits):
        share = drawn(seed, F.col("sheet"), "operator", F.lit(step))
        name = F.lit(operators[step]) if operators is not None else F.coalesce(*[F.when(share < b, F.lit(n)) for n, b in bounds])
        chosen = sheets.withColumn("operator", name)
        zones = F.explode(F.coalesce(*[F.when(F.col("operator") == n, F.array(*map(F.lit, z))) for n, z in ZONES.items()])).alias("zone")
        asked = chosen.select("sheet", "operator", zones).withColumn("turn", drawn(seed, F.col("sheet"), "zone", F.lit(step), F.col("zone")))
        dims = F.col("operator").isin("edit_dimension_measurement", "restyle_dimension_text")
        fits = F.when(F.col("operator") == "restyle_dimension_text", F.col("__dim") & texts).when(dims, F.col("__dim")).otherwise((F.col("kind") == "text") & texts)
        open_ = whole if taken is None else whole.join(taken, ["sheet", "ord"], "left_anti")
        target = open_.join(asked, ["sheet", "zone"]).where(fits).groupBy("sheet").agg(
            F.min(F.struct("turn", drawn(seed, F.col("sheet"), "target", F.lit(step), F.col("ord")).alias("draw"), "zone", "ord")).alias("t")
        )
        did = checkpointed(chosen.join(target, "sheet", "left").select("sheet", F.lit(step).alias("step"), "operator", "t.zone", "t.ord"))
        plan = did if plan is None else plan.union(did)
        touched = did.where("ord is not null").select("sheet", "ord")
        taken = touched if taken is None else taken.union(touched)
    done = plan.where("ord is not null")
    rows = e.join(done.select("sheet", "ord", "step", "operator", F.col("zone").alias("__zone")), ["sheet", "ord"], "left")
    op, key = F.col("operator"), (F.col("sheet"), F.col("step"))
    after = F.when(op.isin("edit_text", "edit_title_field"), bumped(F.col("text"), drawn(seed, "bump", *key)))
    measured = F.round(F.col("measurement") + _one_of(MEASURES, drawn(seed, "measure", *key)), 3)
    measured = F.when((op == "edit_dimension_measurement") & (measured > 0) & (measured != F.col("measurement")), measured)
    shown = F.when(measured.isNotNull() & texts, retargeted(F.col("text"), measured))
    restyled = F.when(op == "restyle_dimension_text", F.when(F.startswith("text", F.lit("%%c")), F.lit("")).otherwise(F.concat(F.lit("%%c"), retargeted(F.lit(""), F.col("measurement")))))
    shift = lambda axis: F.when(op == "translate_entities", drawn(seed, axis, *key) * 6.0 - 3.0).otherwise(F.lit(0.0))
    rows = checkpointed(rows.withColumns({"__after": after, "__measured": measured, "__shown": shown}))
    changed = rows.where(op.isNull() | (op != "delete_text")).withColumns(
        {
            "text": F.coalesce("__after", "__shown", restyled, "text"), "measurement": F.coalesce("__measured", F.col("measurement")),
            "x": F.col("x") + shift("dx"), "y": F.col("y") + shift("dy"),
        }
    )
    most = e.groupBy("sheet").agg(F.max("ord").alias("__most"))
    put = rows.where(op == "insert_text").join(most, "sheet").withColumns(
        {"ord": F.col("__most") + 1 + F.col("step"), "text": _one_of(INSERTED, drawn(seed, "insert", *key)), "x": F.col("x") + 2.0, "y": F.col("y") - 6.0}
    )
    columns = [F.col(c).cast(t).alias(c) for c, t in e.dtypes]
    category = F.coalesce(*[F.when(F.col("__zone") == z, F.lit(c)) for z, c in CATEGORIES.items()])
    said = lambda old, new, old_text, new_text, status: [op.alias("operator"), category.alias("category"), F.lit(status).alias("status"), old.alias("old_ord"), new.alias("new_ord"), old_text.alias("old_text"), new_text.alias("new_text")]
    kind = dict(e.dtypes)["ord"]
    none, blank, own = F.lit(None).cast(kind), F.lit(""), F.col("ord").cast(kind)
    number = lambda v: retargeted(F.lit(""), v)
    edited = rows.where("__after is not null or __measured is not null")
    truth = edited.select("sheet", *said(own, own, F.when(texts, F.col("text")).otherwise(number(F.col("measurement"))), F.coalesce("__after", "__shown", number(F.col("__measured"))), "CHANGED"))
    truth = truth.union(rows.where(op == "delete_text").select("sheet", *said(own, none, F.col("text"), blank, "REMOVED")))
    truth = truth.union(put.select("sheet", *said(none, own, blank, F.col("text"), "ADDED")))
    return Mutation(changed.select(*columns).union(put.select(*columns)), truth, plan)


def scored(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """``status, n_truth, n_found, n_right``: findings (sheet, status, old_ord, new_ord; MATCHED ones aside) against the truth, a finding being right if status and both ords are."""
    keys = ["sheet", "status", "old_ord", "new_ord"]
    f = findings.where("status <> 'MATCHED'").select(*keys, F.lit(1).alias("found"), F.lit(0).alias("true_"))
    t = truth.select(*keys, F.lit(0).alias("found"), F.lit(1).alias("true_"))
    met = f.unionByName(t).groupBy(*keys).agg(F.sum("found").alias("found"), F.sum("true_").alias("true_"))
    return met.groupBy("status").agg(F.sum("true_").alias("n_truth"), F.sum("found").alias("n_found"), F.sum(F.least("found", "true_")).alias("n_right"))


def one_at_a_time(baseline: Mapping[str, float], ranges: Mapping[str, Sequence[float]]) -> list[tuple[str, float, dict[str, float]]]:
    """(name, value, all constants) for the baseline (name ``baseline``) and every value of each constant, the others as in the baseline."""
    unknown = set(ranges) - set(baseline)
    if unknown:
        raise KeyError(f"no such constant: {sorted(unknown)}")
    return [("baseline", 0.0, dict(baseline)), *((n, float(v), dict(baseline) | {n: v}) for n, values in ranges.items() for v in values)]


def sweep(candidates: DataFrame, item: Sequence[str], settings: Sequence[tuple[str, float, Mapping[str, float]]], accepts: Callable[[Mapping[str, float]], Column], order: Callable[[Mapping[str, float]], Sequence[Column]], correct: Column, n_truth: int) -> DataFrame:
    """``name, value, n_found, n_right, precision, recall, f1`` of every setting, from one pass over candidates made once at the widest.

    Under a setting each item picks, of the candidates that it ``accepts``, the one that is greatest by the setting's ``order``; the pick is right if ``correct``. All settings are columns of one aggregate by item, so candidates are read and shuffled once, partially aggregated, whatever the number of settings
    (tens). Precision is null where nothing is found, F1 0 where nothing is right.
    """
    picks = candidates.groupBy(*item).agg(*[F.max(F.when(accepts(p), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order(p))], correct.alias("right")))).alias(f"s{k}") for k, (_, _, p) in enumerate(settings)])
    totals = picks.agg(*[c for k in range(len(settings)) for c in (F.count(f"s{k}").alias(f"n{k}"), F.count_if(F.col(f"s{k}.right")).alias(f"r{k}"))])
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.col(f"n{k}").alias("n_found"), F.col(f"r{k}").alias("n_right")) for k, (n, v, _) in enumerate(settings)])).alias("s")).select("s.*")
    precision, recall = F.try_divide(F.col("n_right"), F.col("n_found")), F.try_divide(F.col("n_right"), F.lit(n_truth))
    f1 = F.coalesce(F.try_divide(2 * F.col("n_right"), F.col("n_found") + n_truth), F.lit(0.0))
    return rows.withColumns({"precision": precision, "recall": recall, "f1": f1})


def sensitivity(swept: DataFrame) -> DataFrame:
    """``name, least, most, spread`` of F1 over the values of each constant."""
    n = swept.where("name <> 'baseline'").groupBy("name").agg(F.min("f1").alias("least"), F.max("f1").alias("most"))
    return n.withColumn("spread", F.col("most") - F.col("least"))
