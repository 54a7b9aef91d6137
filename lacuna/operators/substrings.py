"""Texts that contain words anywhere inside, for any number of words: a join over q-grams.

Each word is filed under the one of its q-grams that is rarest in the texts. A text's q-grams meet the
filed ones by hash, and what they suggest is checked with ``contains``. Words stay in Spark; only a
filter of FILTER_BITS bits travels with the function that reads the texts, and it drops nearly all of their q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lacuna.sources.tables import stored

#: Length of q-grams; shorter words are filed whole.
Q = 4
FILTER_BITS = 24
#: So many distinct words at most are looked for one by one.
FEW = 16
#: Code points of the texts that are hashed together, about; a longer text is hashed alone.
CHARS = 1 << 18
#: Filed words up to this number travel to the rows; more of them meet the texts by a shuffle.
TRAVEL = 50_000
#: Texts in which the q-grams of words are counted to find the rarest, about. It decides on speed, not on results.
COUNTED = 20_000


def gram_hashes(text: str, q: int) -> np.ndarray:
    """Hashes of the runs of ``q`` code points of a text, one for each place."""
    return _hashed(_codes(text), q)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hashed(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.empty(0, np.int64)
    n = len(codes) - q + 1
    with np.errstate(over="ignore"):
        h = np.full(n, q, np.uint64)
        for k in range(q):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def grams(lengths: list[int], bits: bytes | None = None):
    """A column function from texts to their distinct hashes of q-grams of these lengths, those that pass the filter if there is one."""
    shift = np.uint64(64 - FILTER_BITS)

    def of(texts: list[str], passes: np.ndarray | None) -> list[np.ndarray]:
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        codes = _codes("".join(texts))
        rows, hashes = [], []
        for q in lengths:
            h = _hashed(codes, q)
            inside = owner[: len(h)] == owner[q - 1 : q - 1 + len(h)]  # not over the end of a text
            if passes is not None:
                inside &= passes[(h.view(np.uint64) >> shift).astype(np.int64)]
            rows.append(owner[: len(h)][inside])
            hashes.append(h[inside])
        row, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[first], h[first]
        return np.split(h, np.searchsorted(row, np.arange(1, len(texts))))

    @F.pandas_udf(ArrayType(LongType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        passes = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool) if bits is not None else None
        for texts in batches:
            out, held, size = [], [], 0
            for t in texts:
                held.append(t or "")
                size += len(held[-1])
                if size > CHARS:
                    out += of(held, passes)
                    held, size = [], 0
            yield pd.Series(out + (of(held, passes) if held else []), dtype=object)

    return found


def filter_of(filed: DataFrame) -> bytes:
    """The bits of the upper parts of all hashes ``gram``; what comes to the driver is bounded by 2^FILTER_BITS bits."""
    place = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    words = filed.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 as int))")).alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = words.toPandas()
    bits[got["i"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return bits.tobytes()


def filed_words(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(w, q, gram) of distinct words: the q-gram of each that is rarest in a part of the texts (a column ``hay``).

    Words shorter than Q have one gram, the word itself.
    """
    length = F.least(F.lit(Q), F.char_length("w"))
    own = words.select("w", length.alias("q"))
    each = [own.where(F.col("q") == q).select("w", "q", F.explode(grams([q])(F.col("w"))).alias("gram")) for q in range(1, Q + 1)]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    every = stored(every, "word-grams")
    share = COUNTED / max(1, texts.count())
    part = texts if share >= 1 else texts.where(F.xxhash64("hay") < F.lit(-(1 << 63) + int(share * (1 << 64))).cast("long"))
    seen = part.select(F.explode(grams(list(range(1, Q + 1)), filter_of(every))(F.col("hay"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    ranked = every.join(seen, "gram", "left").groupBy("w", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return ranked


def containing(rows: DataFrame, hay: Column, words: DataFrame) -> DataFrame:
    """Rows joined to the words (a column ``w`` and others) that ``hay`` contains anywhere, once for each row and word row.

    Few words travel to the rows, which are not shuffled; with more than TRAVEL words, texts that repeat are looked through once each. Empty and null words and texts match nothing. Up to FEW
    distinct words are looked for one by one, which takes one pass over the rows and no shuffle of them.
    """
    few = words.select("w").where("w <> ''").distinct().limit(FEW + 1).collect()
    if not few:
        return rows.join(words.where("false"), F.lit(False))
    if len(few) <= FEW:
        inside = F.array(*[F.when(F.contains("__hay", F.lit(r["w"])), F.lit(r["w"])) for r in few])
        found = rows.withColumn("__hay", hay).withColumn("w", F.explode(F.array_compact(inside))).drop("__hay")
        return found.join(words, "w")
    marked = rows.withColumn("__hay", hay).where(F.col("__hay") != "").withColumn("__h", F.xxhash64("__hay"))
    vocabulary = words.select("w").where("w <> ''").distinct()
    texts = marked.select("__h", F.col("__hay").alias("hay"))
    filed = stored(filed_words(vocabulary, texts.select("hay")), "filed-words")
    lengths = sorted(r["q"] for r in filed.select("q").distinct().collect())  # four at most
    if not lengths:
        return marked.drop("__hay", "__h").join(words.where("false"), F.lit(False))
    if filed.count() <= TRAVEL:
        # a word is filed once and a text's grams are distinct, so a row meets a word once, where it is read
        met = marked.withColumn("gram", F.explode(grams(lengths, filter_of(filed))(F.col("__hay")))).join(F.broadcast(filed.select("gram", "w")), "gram")
        return met.where(F.contains("__hay", "w")).drop("gram", "__hay", "__h").join(words, "w")
    # the hash stands for the text until it is checked, so texts are not copied for each gram
    hits = texts.select("__h", F.explode(grams(lengths, filter_of(filed))(F.col("hay"))).alias("gram")).distinct()
    suggested = hits.join(filed.select("gram", "w"), "gram").select("__h", "w").distinct()
    found = marked.join(suggested, "__h").where(F.contains("__hay", "w"))
    return found.join(words, "w").drop("__hay", "__h")
