"""Mixing sources to target weights: a low-discrepancy schedule of slots over shuffled blocks of equal tokens.

All of it is DataFrame functions. A token is a word ``[^\\x20\\x09-\\x0D]+``.

* Targets: sources share ``share`` times all words by weight; none gets more than ``most`` times its
  own size, and what is over goes to the others by weight.
* Schedule: slot t has the golden-ratio point frac((t + 1) / phi), kept as 40 bits; the running sum of
  the targets tells whose slot it is. Slots are ranked per source, by chunks of t.
* Blocks: the documents of a source are shuffled by a hash of their id and laid end to end, the whole
  as often as needed; its r-th slot takes the r-th block of ``block`` words. The last slot takes what is
  left to the target, so every source gets its target to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut
from lacuna.operators.ranks import positions

WORD = r"[^\x20\x09-\x0D]+"
#: 2^40 over the golden ratio, made odd: steps of the point sequence.
BITS, STEP = 40, round((1 << 40) * (math.sqrt(5) - 1) / 2) | 1
BLOCK = 1024
WEIGHTS = (3, 1, 2)
SEED = "mix"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, h): words of each document and its place in the shuffle, 60 bits of a hash of the id."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h"),
    )


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, sid, source_size, target, words, lo) of sized documents, written as a table.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. Below a level L each
    target is L times the weight, or ``most`` times the size if that is less; L rises until the targets
    add up. The driver holds two sums a round. ``words`` is the target rounded, ``lo`` the sum of words before.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = positions(sizes, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    rows = cut(numbered.select("source", (F.col("position") - 1).alias("sid"), "source_size", weight.alias("weight")), "sources")
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, level = share * (total or 0), share * (total or 0) / (all_weights or 1)
    cap = most * F.col("source_size")
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        capped, free = rows.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        above = (goal - (capped or 0)) / free if free else level
        if above <= level:
            break
        level = above
    rows = rows.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
    rows = rows.withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    placed = positions(rows, [], ["sid"], ["words"])
    return cut(placed.select("source", "sid", "source_size", "target", "words", F.col("before_words").alias("lo")), "targets")


def point(t):
    """frac((t + 1) / phi) in 2^-40, without overflow below t = 2^42."""
    t, low = t + 1, 1 << 20
    return ((t % low) * STEP + (((t / low).cast("long") * STEP) % low) * low) % (1 << BITS)


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, turn, take): whose slot each is, the how-manieth of that source, and the words it takes.

    Slots go up in the order of the mix; numbers whose source has reached its target are left out, and
    sources that the sequence leaves short (by a logarithm of the slots at most) take theirs at the end.
    """
    spark = sources.sparkSession
    count, total = sources.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    slots = -(-total // block)
    cells, chunk = 4 * count + 1024, max(1, math.isqrt(slots))
    cell = lambda at: F.floor(at / F.lit(float(max(1, total))) * cells)
    # slots meet the sources of their cell; cells get like numbers of slots, so candidates stay below twice the slots
    owned = sources.where("words > 0").select("sid", "words", "lo", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("lo") + F.col("words")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (point(F.col("id")) / float(1 << BITS) * total).alias("at"))
    of_source = points.withColumn("cell", cell(F.col("at"))).join(owned, "cell").where("at >= lo and at < lo + words").select("slot", "sid", "words")
    ranked = positions(of_source.withColumn("chunk", F.floor(F.col("slot") / chunk)), ["sid"], ["slot"], part="chunk")
    turns = cut(ranked.select("slot", "sid", (F.col("position") - 1).alias("turn"), "words").where(F.col("turn") * block < F.col("words")), "slots")
    short = sources.select("sid", "words").join(turns.groupBy("sid").agg(F.count("*").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.where(F.col("have") * block < F.col("words")).withColumn("turn", F.explode(F.sequence("have", F.floor((F.col("words") - 1) / block))))
    late = short.select((slots + (F.col("turn") - F.col("have")) * count + F.col("sid")).alias("slot"), "sid", "turn", "words")
    return turns.unionByName(late).select("slot", "sid", "turn", F.least(F.lit(block), F.col("words") - F.col("turn") * block).alias("take"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = SEED) -> DataFrame:
    """The mix as pieces: (slot, turn, sid, place, doc_id, size, source, source_size, target, first_word, words).

    Sorted by slot, then place, then first_word, the pieces are the mixed text: words of the document
    from ``first_word`` on. ``place`` numbers the documents of a source in its shuffle. A document
    the mix takes nothing of has one row without slot and words. A null text counts as empty and takes
    nothing; null sources are one source, the last; rows that repeat an id are documents of their own,
    shuffled next to each other by size; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, seed), "sized")
    sources = targets(rows, weights, share, most)
    bits = max(1, rows.count()).bit_length() // 2
    keyed = rows.withColumn("known", F.coalesce("source", F.lit(""))).withColumn("null", F.col("source").isNull())
    of = sources.select(F.coalesce("source", F.lit("")).alias("known"), F.col("source").isNull().alias("null"), "sid", "source_size", "target", F.col("words").alias("want"))
    laid = positions(keyed.join(of, ["known", "null"]).withColumn("part", F.shiftrightunsigned("h", 60 - bits)), ["sid"], ["h", "doc_id", "size"], ["size"], part="part")

    def pieces(round_):
        at = F.col("before_size") + round_ * F.col("source_size")
        stop = F.least(at + F.col("size"), F.col("want"))
        own = F.transform(
            F.sequence(F.floor(at / block), F.floor((stop - 1) / block)),
            lambda turn: F.struct(turn.alias("turn"), (F.greatest(at, turn * block) - at).alias("first_word"), (F.least(stop, (turn + 1) * block) - F.greatest(at, turn * block)).alias("words")),
        )
        return F.when(at < stop, own).otherwise(F.array().cast("array<struct<turn:bigint,first_word:bigint,words:bigint>>"))

    rounds = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), pieces))
    cut_up = laid.select("sid", F.col("position").alias("place"), "doc_id", "size", "source", "source_size", "target", F.explode_outer(rounds).alias("p")).select("*", "p.turn", "p.first_word", "p.words").drop("p")
    return cut_up.join(schedule(sources, block).drop("take"), ["sid", "turn"], "left").select("slot", "turn", "sid", "place", "doc_id", "size", "source", "source_size", "target", "first_word", "words")


def taken(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of a mix: the words that slots take of each document."""
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0)))
    return mixed.groupBy("sid", "place", "doc_id", "size", "source_size", "target").agg(words.alias("taken")).drop("sid", "place")
