"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hash_share

NONE = "und"
SHORT, TINY = 256, 64


def _framed(block: bytes, near: bytes) -> bytes:
    """A block, in known text if it is too short to be compressed by itself."""
    if len(block) >= SHORT:
        return block
    if len(block) >= TINY:
        return b" ".join([near, block, b""])
    return b" ".join([near, block, near[:40], block, near[40:80], block, near[80:], b""])


def letters(text: Column) -> Column:
    """Lower-case letters of a text; everything else becomes one blank."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")))


def fit_dictionaries(
    docs: DataFrame, sample: int = 400, chars: int = 600, text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """A raw-content dictionary for each language from a bounded sample of labelled rows.

    The sample is ``sample`` blocks a language (about 240 kB), those least by a hash of their text, of all blocks of ``chars``
    characters into which the whole texts are cut; equal blocks count once. Its draw keeps four times as many by hash share
    before it ranks them, so no language is gathered into one task. The number of languages is taken
    to be small, as that of a label set. Null texts, null languages and texts without letters are skipped; an empty table
    gives no dictionaries. Repeated rows change nothing but a language's share.
    """
    text = F.col(text_col)
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(F.col(lang_col).alias("lang"), text.alias("text"))
    sizes = known.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / chars)).alias("n"))
    share = {r["lang"]: min(1.0, 4.0 * sample / r["n"]) for r in sizes.collect()}
    if not share:
        return {}
    share_of = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    picked = F.filter(cuts, lambda block: hash_share(block, F.lit(2)) < share_of[F.col("lang")])
    blocks = known.select("lang", F.explode(picked).alias("block")).select("lang", letters(F.col("block")).alias("part"))
    drawn = (
        blocks.where("part <> ''")
        .distinct()
        .withColumn("h", F.xxhash64("part"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part")))
        .where(F.col("rank") <= sample)
    )
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.collect():
        parts.setdefault(r["lang"], []).append((r["h"], r["part"]))
    return {lang: " ".join(p for _, p in sorted(own)).encode() for lang, own in sorted(parts.items())}


def classify(text: Column, dictionaries: dict[str, bytes], block: int = 1500, level: int = 6) -> Column:
    """struct(lang, score, margin) of a whole text; lang is null where there are no letters (marks alone are none) or no dictionaries.

    The letters are cut into blocks of ``block`` bytes; each is compressed against each language's dictionary
    and the sizes are added up, so long texts are weighed in full and no block can lean on another. The
    smallest sum wins (ties: the first language by name). Blocks under ``SHORT`` bytes, which the format would
    store as they are, are put behind the last ``SHORT`` bytes of the dictionary itself, which cost next to
    nothing; those under ``TINY`` bytes are set among pieces of it three times over. margin is the share by which it undercuts the
    runner-up; score turns the saved bytes into a number from 0 to 1.
    """
    names = sorted(dictionaries)
    packed = pickle.dumps([dictionaries[n] for n in names])

    @F.pandas_udf("struct<lang:string,score:double,margin:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for raw in pickle.loads(packed):  # bounded: fit_dictionaries
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level)
            coder = zstandard.ZstdCompressor(dict_data=known, level=level, write_checksum=False, write_dict_id=False)
            coders.append((coder, raw[-SHORT:]))

        def one(text: bytes | None) -> tuple[str | None, float, float]:
            if not text or not coders:
                return None, 0.0, 0.0
            cuts = [text[i : i + block] for i in range(0, len(text), block)]
            sizes = np.array(
                [sum(len(c.compress(_framed(x, near))) for x in cuts) for c, near in coders], float
            )
            order = np.argsort(sizes, kind="stable")
            best, second = (sizes[order[0]], sizes[order[1]]) if len(order) > 1 else (sizes[0], sizes[0] * 2 + 1)
            margin = float((second - best) / max(second, 1.0))
            return names[order[0]], float(1 - 0.5 ** (1 + 40 * margin)), margin

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["lang", "score", "margin"])

    return predict(F.when(text.rlike(r"\p{L}"), F.encode(letters(text), "UTF-8")))


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Null texts and texts without a letter get ``und``, score 0, and are rejected. Where the margin is below
    ``min_margin``, lang_pred still names the best language and ``rejected`` is true. Of the columns of docs,
    only those three names are replaced.
    """
    seen = docs.withColumn("__lang", classify(F.col(text_col), dictionaries))
    return seen.withColumns(
        {
            "lang_pred": F.coalesce("__lang.lang", F.lit(NONE)),
            "score": F.col("__lang.score"),
            "rejected": F.col("__lang.lang").isNull() | (F.col("__lang.margin") < min_margin),
        }
    ).drop("__lang")
