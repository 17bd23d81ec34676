"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD_BREAKS, WORDS, Scratch

SLOTS = 1 << 21
KEY = ["doc", "body"]
SHADE_AT = 57  # bits of a word's hash below its rarity, which takes six: a key is never negative
SHARED_SHADE = 3  # of a slot with more than its seeded row and one word: words below are in one line only
LEADERS = 16
WAYS = 3
SLICES = 3


def _holds(text: Column, *parts: str) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def _words(text: Column) -> Column:
    """Words, and empty ones; the plain blank, without a pattern, is the cheap common case."""
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.when(_holds(text, *"\t\x0b\x0c\r"), F.split(text, WORD_BREAKS)).otherwise(plain)


def _hashes(line: Column) -> Column:
    """Hashes of 64 bits of the words of a line, repeated ones too.

    Whatever stands below a lambda is interpreted, so there is only what an odd line needs; repeated ones go above it.
    """
    odd = _holds(line, *"\t\x0b\x0c\r", "  ") | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    words = F.when(odd, F.array_remove(F.split(line, WORD_BREAKS), "")).otherwise(F.split(line, " "))
    return F.transform(words, lambda w: F.xxhash64(w))


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SLOTS - 1))


def rarity_table(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """How common the words of all ``docs`` are: one row, an array of a byte for each of 2,097,152 hash slots.

    Counts are taken over every word of every text; the byte is twice the binary logarithm of a slot's count, 63 at
    most. The table has a fixed size (2 MB) whatever the corpus. Any order of the words makes the join exact;
    this one makes it cheap.
    """
    text = F.col("text")
    low = docs.select(F.explode(F.array(F.lower(F.col(text_col)))).alias("text"))  # made once: a generator shares no expressions
    words = low.select(F.explode(_words(text)).alias("w"))
    slots = words.select(_slot(F.xxhash64("w")).alias("slot")).union(docs.sparkSession.range(SLOTS))  # each at least once
    shade = F.least(F.floor(2 * F.log2("n")), F.lit(63)).cast("tinyint")
    shades = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", shade.alias("shade"))

    def strung(at: str, part: str) -> Column:
        return F.sort_array(F.collect_list(F.struct(at, part))).getField(part)

    block = F.shiftright("slot", 12).alias("block")
    blocks = shades.groupBy(block).agg(strung("slot", "shade").alias("shades"))
    return scratch.save(blocks.agg(F.flatten(strung("block", "shades")).alias("rarity")))


def _least(n: Column, share: float) -> Column:
    """Smallest whole number that is at least share * n."""
    return F.ceil(n * share - 1e-9).cast("int")


def _sketch(words: Column) -> Column:
    """64 parities: two sets differ in at least as many words as their sketches in bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))),
    )


def _shared(n: Column, m: Column, similarity: float) -> Column:
    """Words that sets of n and m words must have in common."""
    return _least(n + m, similarity / (1 + similarity))


def _may_match(a: str, b: str, similarity: float) -> Column:
    """Length filter and the bound by parities for rows a and b with n and sketch; different sets differ in a word at least."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = n + m - 2 * _shared(n, m, similarity)
    return (
        (F.least(n, m) >= _least(F.greatest(n, m), similarity))
        & (apart > 0)
        & (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= apart)
    )


def line_classes(docs: DataFrame, scratch: Scratch, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, body, no, n, sketch, front``: the first line of each word set; ids follow their order.

    front holds the rarest words in order, without those that occur once in all ``docs``: they meet nobody. Those are the
    first ones, so a word's place in the set follows from how many are left.
    """
    rarity = rarity_table(docs, scratch, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("body"),
        F.posexplode(F.split(F.lower(F.col(text_col)), "\n")).alias("no", "line"),
    )
    rows = rows.where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "")

    def by_rarity(h: Column) -> Column:
        shade = F.get(F.col("__rarity"), _slot(h).cast("int")).cast("long")
        return F.shiftleft(shade, SHADE_AT).bitwiseOR(F.shiftrightunsigned(h, 64 - SHADE_AT))

    # In a plain projection the scalar is one value for a task; below an explode it would be a column of every row.
    sets = rows.withColumn("__rarity", rarity.scalar()).select(*KEY, "no", F.sort_array(F.array_distinct(F.transform(_hashes(F.col("line")), by_rarity))).alias("set"))
    sets = sets.select(*KEY, "no", F.size("set").alias("n"), _sketch(F.col("set")).alias("sketch"), "set")
    front = F.slice("set", 1, F.col("n") - _least(F.col("n"), similarity) + 1)
    front = F.filter(front, lambda w: w >= F.lit(SHARED_SHADE << SHADE_AT))
    keyed = sets.select(
        F.xxhash64("set").alias("k1"), F.xxhash64(F.lit(1), "set").alias("k2"),
        F.struct(*KEY, "no", "n", "sketch", front.alias("front")).alias("f"),
    )
    firsts = keyed.groupBy("k1", "k2").agg(F.min("f").alias("f"))
    firsts = scratch.save(firsts.select("f.*"))
    ranked = scratch.save(firsts.orderBy(*KEY, "no").withColumn("id", F.monotonically_increasing_id()))
    scratch.drop(firsts)
    scratch.drop(rarity)
    return ranked


def likely_matches(classes: DataFrame, similarity: float) -> DataFrame:
    """``late, early``: for each class the two most alike earlier ones among the leaders of its groups.

    A class is in three groups, each named by the least of its front's words in an order of that group's own. Leaders of a
    group are 16 of its classes, the earliest of a third (another for each way), then the others. That is two rows at most for a class, however large its groups.
    """

    def least(way: int) -> Column:
        """The name; a word that is four times as common has twice the chance, as an edit brings in rarer ones."""

        def drawn(w: Column) -> Column:
            often = (F.shiftrightunsigned(w, SHADE_AT + 2) + 1).cast("int")
            return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(way), w), often)

        return F.array_min(F.transform("front", drawn))

    names = [f"name{way}" for way in range(WAYS)]
    members = classes.select("id", "n", "sketch", *[least(way).alias(name) for way, name in enumerate(names)])  # below the explode, which is compiled so
    members = members.select("id", "n", "sketch", F.posexplode(F.array(*names)).alias("way", "name"))
    members = members.where("name is not null")
    own_turn = F.pmod(F.xxhash64("id"), F.lit(WAYS)) == F.col("way")  # so that a class in all groups of a way finds others there
    order = Window.partitionBy("way", "name").orderBy(~own_turn, "id")
    leaders = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
    own, e = members.alias("l"), leaders.alias("e")
    near = own.join(
        e,
        (F.col("l.way") == F.col("e.way")) & (F.col("l.name") == F.col("e.name")) & (F.col("e.id") < F.col("l.id"))
        & _may_match("l", "e", similarity),
    )
    apart = F.bit_count(F.col("l.sketch").bitwiseXOR(F.col("e.sketch")))
    best = near.groupBy(F.col("l.id").alias("late")).agg(F.collect_set(F.struct(apart.alias("apart"), F.col("e.id").alias("early"))).alias("s"))
    return best.select("late", F.explode(F.slice(F.sort_array("s"), 1, 2).getField("early")).alias("early"))


def candidates(classes: DataFrame, settled: DataFrame, similarity: float, scratch: Scratch | None = None, slices: int = SLICES) -> DataFrame:
    """``late, early``: all pairs of classes that share enough words at their fronts to be similar, perhaps, but for settled lates.

    Two sets that must share k words share one among all but the last k - 1 of either, two among all but the last k - 2,
    and so on. Pairs meet on words within the second of these ranges, so a pair takes a row or two, not one for each
    word of the fronts. Further length and positional filter, the bound by parities, and one by how many words are shared up to the last that was met.
    A settled class stays on the early side. The words go in ``slices``, one after the other, so that a part of the fronts is shuffled at a time.
    """
    scratch = scratch or Scratch(classes.sparkSession)
    done = settled.select(F.col("late").alias("id"), F.lit(1).cast("long").alias("done"))
    code = (2 * F.col("id") + F.coalesce("done", F.lit(0))).alias("code")
    coded = scratch.save(classes.join(done, "id", "left").select(code, "n", "sketch", "front"))
    gone = F.col("n") - _least(F.col("n"), similarity) + 1 - F.size("front")
    ln, en, lp, ep = (F.col(c) for c in ("l.n", "e.n", "l.pos", "e.pos"))
    late, early = F.col("l.code"), F.shiftright("e.code", 1)
    beyond = F.greatest(lp - ln, ep - en) + _shared(ln, en, similarity)  # the first range ends at 0
    fits = (
        (F.col("l.word") == F.col("e.word"))
        & (early < F.when(late % 2 == 0, F.shiftright(late, 1)).otherwise(-1))
        & (beyond <= 1)
        & (F.least(lp, ep) + 1 + F.least(ln - lp - 1, en - ep - 1) >= _shared(ln, en, similarity))
        & _may_match("l", "e", similarity)
    )
    pair = ["late", "early", "ln", "en"]
    parts = []
    for k in range(slices):
        entries = coded.select("code", "n", "sketch", gone.alias("gone"), F.posexplode("front").alias("i", "word"))
        entries = entries.where(F.pmod("word", F.lit(slices)) == k).select("code", "n", "sketch", (F.col("gone") + F.col("i")).alias("pos"), "word")
        met = entries.alias("l").join(entries.alias("e"), fits)
        met = met.groupBy(F.shiftright(late, 1).alias("late"), early.alias("early"), ln.alias("ln"), en.alias("en"))
        parts.append(scratch.save(met.agg(F.count(F.lit(1)).alias("met"), F.count_if(beyond <= 0).alias("first"), F.max(lp).alias("lp"), F.max(ep).alias("ep"))))
    scratch.drop(coded)
    met = reduce(DataFrame.union, parts).groupBy(*pair).agg(F.sum("met").alias("met"), F.sum("first").alias("first"), F.max("lp").alias("lp"), F.max("ep").alias("ep"))
    shared = _shared(F.col("ln"), F.col("en"), similarity)
    whole = shared > _least(F.greatest("ln", "en"), similarity)  # the second range lies within both fronts
    behind = F.least(F.col("ln") - F.col("lp"), F.col("en") - F.col("ep")) - 1
    enough = (F.col("first") >= 1) & ((F.col("met") >= 2) | ~whole) & (F.col("met") + behind >= shared)
    pairs = scratch.save(met.where(enough).select("late", "early"))
    for over in parts:
        scratch.drop(over)
    return pairs


def _beside(docs: DataFrame, other: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Documents joined by their key with a table that has one row for each key at most; its columns get two underscores."""
    other = other.toDF(*[f"__{c}" for c in other.columns])
    return docs.join(other, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__body")), how)


def staying_lines(
    docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc, body, stay`` (line numbers from 0) for every document that has lines with words and no match before them.

    A line is the set of its lower-cased words; lines without words always stay and aren't listed. Lines stand in the
    order of (doc, body, number), null documents first; body is a hash of the document's text. Two lines match
    where the Jaccard similarity of their sets is at least ``similarity``; a line goes if it matches any
    earlier one, whether or not that stays. Repeated rows (same id and text) count as one document.

    Equal sets (128 bits of hash) form a class, represented by its first line, so copies make no pairs. One match is
    enough for a line to go. So classes are first held against the leaders of groups they belong to
    (:func:`likely_matches`), which settles the near copies, whose number of pairs would grow with the square of
    their group. The others are joined with all earlier classes on the rare words at the front of their sets
    (:func:`candidates`), which loses no match. Jaccard is computed on 64-bit hashes of all words of both lines.
    """
    scratch = Scratch(docs.sparkSession)
    classes = line_classes(docs, scratch, similarity, id_col, text_col)
    lines = F.split(F.lower(F.col(text_col)), "\n")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("late", "early")).alias("id")).distinct()
        spots = classes.select("id", *KEY, "no").join(wanted, "id")
        spots = spots.groupBy(*KEY).agg(F.collect_list(F.struct("no", "id")).alias("spots"))
        found = _beside(docs.select(id_col, text_col), spots, id_col, text_col, "inner")
        found = found.select(F.explode(F.array(lines)).alias("lines"), "__spots").select("lines", F.explode("__spots").alias("spot"))
        found = found.select("spot.id", F.get("lines", "spot.no").alias("line")).dropDuplicates(["id"])
        whole = scratch.save(found.select("id", F.array_distinct(_hashes(F.col("line"))).alias("set")))
        both = pairs.join(whole.toDF("late", "set"), "late").join(whole.toDF("early", "other"), "early")
        common = F.size(F.array_intersect("set", "other"))
        fits = common >= _least(F.size("set") + F.size("other") - common, similarity)
        matched = scratch.save(both.where(fits).select("late").distinct())
        scratch.drop(whole)
        scratch.drop(pairs)
        return matched

    settled = verified(scratch.save(likely_matches(classes, similarity)))
    rest = verified(candidates(classes, settled, similarity, scratch))
    firsts = classes.select("id", *KEY, "no").join(settled.union(rest).withColumnRenamed("late", "id"), "id", "left_anti")
    stay = scratch.save(firsts.groupBy(*KEY).agg(F.sort_array(F.collect_set("no")).alias("stay")))
    for over in (classes, settled, rest):  # before the texts are shuffled once more
        scratch.drop(over)
    return stay


def with_kept_text(
    docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with matched lines taken out of the text, and ``n_lines`` and ``n_removed``.

    See :func:`staying_lines`. The lines that stay keep their order and are joined by line breaks again; a text
    without removed lines is unchanged, a null text stays null with no lines. An empty table gives an empty one. Other
    columns stay, but for those named n_lines and n_removed, which are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    stay = staying_lines(docs, similarity, id_col, text_col)
    lines = F.split(F.col(text_col), "\n")
    blank = F.transform(lines, lambda line, i: F.when(~line.rlike(WORDS), i))
    places = F.sort_array(F.concat(F.coalesce("__stay", F.array().cast("array<int>")), F.filter(blank, F.isnotnull)))
    seen = _beside(docs.select(*own), stay, id_col, text_col, "left").select(*own, F.size(lines).alias("__all"), places.alias("__places"))
    whole = F.coalesce(F.size("__places") == F.col("__all"), F.lit(True))
    seen = seen.select(*own, "__all", "__places", F.explode(F.array(F.when(~whole, lines))).alias("__lines"))
    kept = F.array_join(F.transform("__places", lambda i: F.get("__lines", i)), "\n")
    return seen.select(
        *[F.when(F.col("__lines").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in own],
        F.greatest("__all", F.lit(0)).alias("n_lines"),
        F.greatest(F.col("__all") - F.size("__places"), F.lit(0)).alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without matched lines; documents of which no line is left go, those that were empty before stay."""
    seen = with_kept_text(docs, similarity, id_col, text_col)
    return seen.where((F.col("n_removed") == 0) | F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False))).select(*docs.columns)
