"""Order MinHash document fingerprints, by DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import below_share

WORDS = 5
#: Sketches of a fingerprint, a power of two; k-mers of a sketch are two.
SKETCHES = 64
SHIFT = 6
#: Low bits of a hash that carry a k-mer's place in the text.
PLACE = (1 << 28) - 1
#: Documents of a bucket of neighbouring ids, or the square root of their number if that is more.
BUCKET_ROWS = 500
#: Ids that are drawn for each bound between buckets.
DRAWN = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row even where lambdas use it again and again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(tokens: Column, k: int = WORDS) -> Column:
    """Hashes of all runs of k tokens, in text order; fewer tokens count as one run, none gives none."""
    whole = F.when(F.size(tokens) > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<bigint>"))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
    return F.when(F.size(tokens) >= k, let(F.transform(tokens, lambda w: F.xxhash64(w)), runs)).otherwise(whole)


def _mark(value: Column, place: Column) -> Column:
    return value.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("long"))


def _numbered(kmers: Column) -> Column:
    """A hash of each k-mer and its occurrence number, the place in the low bits, when some k-mer repeats.

    Sorting brings equal k-mers together in text order. How many equal ones stand before is
    counted by doubling: a count that has reached 2^j goes on with the count 2^j places before.
    """

    def of_sorted(s):
        same = F.transform(s, lambda x, i: F.when(i == 0, 0).when(x.bitwiseXOR(s[i - 1]).bitwiseAND(F.lit(~PLACE)) == 0, 1).otherwise(0))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(s).cast("double"))).cast("int"))

        def double(counts, j):
            span = F.pow(F.lit(2.0), j).cast("int")
            return F.when(F.array_max(counts) < span, counts).otherwise(F.transform(counts, lambda c, i: F.when(c < span, c).otherwise(c + counts[i - span])))

        count = F.aggregate(steps, same, double)
        return let(count, lambda n: F.transform(s, lambda x, i: _mark(F.xxhash64(kmers[x.bitwiseAND(F.lit(PLACE)).cast("int")], n[i]), x.bitwiseAND(F.lit(PLACE)))))

    return let(F.sort_array(F.transform(kmers, lambda h, i: _mark(h, i))), of_sorted)


def _sketch(kmers: Column) -> Column:
    simple = F.transform(kmers, lambda h, i: _mark(F.xxhash64(h, F.lit(0)), i))
    numbered = F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), simple).otherwise(_numbered(kmers))
    part = lambda x: F.shiftright(x, 64 - SHIFT) + F.lit(SKETCHES // 2).cast("long")
    high = lambda p: F.shiftleft(p.cast("long"), 32)

    def of_ring(ring):
        """The hash ring in order: sketch p takes the first two k-mers from the p-th mark of the ring on."""
        firsts = F.filter(F.transform(ring, lambda x, i: F.when((i == 0) | (part(x) != part(ring[i - 1])), high(part(x)) + i.cast("long")).otherwise(F.lit(-1).cast("long"))), lambda y: y >= 0)

        def of_firsts(st):
            at = lambda p: F.when(F.size(st) == SKETCHES, st[p]).otherwise(F.coalesce(F.array_min(F.filter(st, lambda y: y >= high(p))), st[0]))
            index = F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda p: at(p).bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))

            def tuple_hash(i):
                a = ring[i].bitwiseAND(F.lit(PLACE)).cast("int")
                b = ring[F.pmod(i + 1, F.size(ring))].bitwiseAND(F.lit(PLACE)).cast("int")
                return F.xxhash64(kmers[F.least(a, b)], kmers[F.greatest(a, b)]).bitwiseAND(F.lit((1 << 32) - 1))

            return F.transform(index, tuple_hash)

        return let(firsts, of_firsts)

    return let(F.sort_array(numbered), of_ring)


def order_minhash(text: Column) -> Column:
    """The fingerprint of a text: SKETCHES 32-bit hashes; zeros for a text without words.

    k-mers are runs of five words. Each is numbered among its equals and hashed with its number;
    the hash values form a ring, and sketch p is the permutation that begins at the p-th of
    SKETCHES even marks (one permutation, the densified variant; its likeness is as near to that of
    independent orders as that of 64 such, see the README). Its two smallest k-mers are put in text
    order and hashed as a pair, so moving text changes the fingerprint as editing does.
    """
    empty = F.array_repeat(F.lit(0).cast("long"), SKETCHES)
    return let(shingle_hashes(words(F.coalesce(text, F.lit("")))), lambda k: F.when(F.size(k) == 0, empty).otherwise(let(k, _sketch)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SKETCHES))


def with_next(rows: DataFrame, id_col: str, *columns: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Add next_<column> of the row with the next larger id; the last row is followed by the first.

    Rows go to buckets of neighbouring ids, whose bounds are drawn from the ids by a hash. The
    first rows of a bucket are sent to the bucket before as well, so one shuffle is enough. With n
    rows there are no more bounds than the square root of n, and each row looks its bucket up in
    two steps. Null ids come first; equal ids are ordered by the ``order`` columns.
    """
    ids = rows.select(id_col)
    stats = ids.agg(F.count("*").alias("n"), F.count(id_col).alias("known"), F.min(id_col).alias("least")).first()
    buckets = -(-stats["n"] // max(BUCKET_ROWS, math.isqrt(stats["n"])))
    bounds = []
    if buckets > 1:
        drawn = ids.where(F.col(id_col).isNotNull() & below_share(F.xxhash64(id_col), DRAWN * buckets / stats["n"])).distinct()
        sample = sorted(r[0] for r in drawn.collect())
        bounds = sorted({sample[len(sample) * k // buckets] for k in range(1, buckets)}) if sample else []
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = bounds[step - 1 :: step], [bounds[i : i + step - 1] for i in range(0, len(bounds) + 1, step)]
    longs = lambda xs: f"cast(array({', '.join(f'{x}L' for x in xs)}) as array<bigint>)"
    below = lambda xs: F.coalesce(F.size(F.filter(xs, lambda b: b <= F.col(id_col))), F.lit(0))
    high, own = F.expr(longs(coarse)), F.expr(f"array({', '.join(map(longs, fine))})")[F.col("__c")]
    placed = rows.withColumn("__c", F.when(F.col(id_col).isNull(), 0).otherwise(below(high))).withColumn("__f", F.when(F.col(id_col).isNull(), 0).otherwise(below(own)))
    bound = F.when(F.col("__f") > 0, own[F.col("__f") - 1]).when(F.col("__c") > 0, high[F.col("__c") - 1])
    first = F.col(id_col).isNull() if stats["known"] < stats["n"] else F.col(id_col) == F.lit(stats["least"])
    guests = F.array(
        F.struct(F.col("__b").alias("bucket"), F.lit(0).alias("guest")),
        F.when(bound == F.col(id_col), F.struct((F.col("__b") - 1).alias("bucket"), F.lit(1).alias("guest"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("guest"))),
    )
    sent = placed.withColumn("__b", F.col("__c") * step + F.col("__f")).withColumn("__at", F.explode(F.filter(guests, lambda g: g.isNotNull())))
    near = Window.partitionBy("__at.bucket").orderBy(F.col("__at.guest"), F.col(id_col).asc_nulls_first(), *order)
    nexts = [F.lead(c).over(near).alias(f"next_{c}") for c in columns]
    return sent.select(*rows.columns, F.col("__at.guest").alias("__guest"), *nexts).where("__guest = 0").drop("__guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last half replaced by as much of the next document's beginning. Null
    texts count as empty; two texts without words are alike (1), one without words is unlike any
    other (0). Repeated rows stay; of rows with equal ids the next is the next in text order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    printed = rows.select("doc_id", "text", order_minhash(F.col("text")).alias("fp"))
    pairs = with_next(printed, "doc_id", "text", "fp", order=("text",))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", order_minhash(F.col("edited")).alias("edited_fp"))
