"""SimHash near-duplicates through an inverted index on byte positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import jaccard
from lacuna.llm.common import cut, majority, map_arrow
from lacuna.llm.components import connected_components

MAX_BITS = 2
#: Two bits fall in two bytes at most, so six of the eight positional bytes agree at least.
MIN_SHARED = 8 - MAX_BITS
#: Posting lists are kept by five positional bytes together, the other three being free.
FREE = 3
#: Rows of a posting list that are tallied against the list at a time.
SLICE = 256
#: A longer posting list is divided by a further positional byte first.
LIST_ROWS = 4096


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles: XXH64 with seed 42, strict majority per bit."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return digest(b" ".join(tokens), 42)
    if words == 3:
        spaced = [w + b" " for w in tokens]
        hashes = [digest(a + b + c, 42) for a, b, c in zip(spaced, spaced[1:], tokens[2:])]
    else:
        hashes = [digest(b" ".join(tokens[i : i + words]), 42) for i in range(len(tokens) - words + 1)]
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every text as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t"))
    return rows.transform(map_arrow, run, f"{id_col} long, fp long")


def free_positions() -> list[tuple[int, ...]]:
    """Choices of FREE byte positions such that any two positions lie in one of them.

    The positions where two linked fingerprints differ are two at most, so they lie in some choice
    and the fingerprints agree in all bytes outside it. Greedy: the choice that covers most new pairs.
    """
    missing, out = set(combinations(range(8), MAX_BITS)), []
    while missing:
        best = max(combinations(range(8), FREE), key=lambda c: len(missing & set(combinations(c, MAX_BITS))))
        missing -= set(combinations(best, MAX_BITS))
        out.append(best)
    return out


def _masks() -> list[tuple[int, int]]:
    """The number of each choice of free positions, and the mask of the bytes outside it."""
    out = []
    for n, free in enumerate(free_positions()):
        mask = sum(0xFF << (8 * k) for k in range(8) if k not in free)
        out.append((n, mask - (1 << 64) if mask >= 1 << 63 else mask))
    return out


def shared_bytes(diff: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are equal, from the exclusive-or of two fingerprints."""
    x = diff | (diff >> np.uint64(4))
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def _pairs(fps: np.ndarray, free: tuple[int, ...]):
    """Pairs of one posting list (distinct fingerprints that agree outside ``free``) within MAX_BITS bits.

    Shared bytes are tallied, pairs that reach MIN_SHARED are retained and verified bit by bit. A
    long list is divided by each of its free positions in turn: as long as more than MAX_BITS are
    free, a pair that reaches MIN_SHARED agrees in one of them. With MAX_BITS free bytes a list has
    65,536 members at most.
    """
    if len(fps) > LIST_ROWS and len(free) > MAX_BITS:
        for k in free:
            byte = (fps >> np.uint64(8 * k)) & np.uint64(0xFF)
            order = np.argsort(byte, kind="stable")
            for own in np.split(order, np.nonzero(np.diff(byte[order]))[0] + 1):
                for i, j in _pairs(fps[own], tuple(f for f in free if f != k)) if len(own) > 1 else ():
                    yield own[i], own[j]
        return
    for at in range(0, len(fps) - 1, SLICE):
        diff = fps[at : at + SLICE, None] ^ fps[None, at:]
        left, right = np.nonzero(np.triu(shared_bytes(diff) >= MIN_SHARED, 1))
        near = np.bitwise_count(diff[left, right]) <= MAX_BITS
        yield left[near] + at, right[near] + at


def _links(fps: np.ndarray, slot: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of a posting list."""
    root, out = list(range(len(fps))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in _pairs(fps, _FREE[slot]):
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(fps[j])))
    return out


_FREE = free_positions()


def fingerprint_links(distinct: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Links (a, b) that connect all fingerprints within two bits, one row of each pair or fewer.

    The inverted index files every fingerprint under five positional bytes together, in as many
    ways (eleven) as it takes for each pair with the guaranteed six shared bytes to meet. In a
    posting list the shared bytes of a pair are tallied, pairs below six go, the others are
    verified bit by bit. Of a list's links a spanning forest is kept.
    """

    def run(batches):
        held_key, held = None, np.empty(0, np.uint64)

        def out(links):
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            links: list[tuple[int, int]] = []
            slot, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            ends = np.nonzero((np.diff(slot) != 0) | (np.diff(key) != 0))[0] + 1
            edges = [0, *ends.tolist(), len(fps)]
            first = (int(slot[0]), int(key[0]))
            if held_key is not None and held_key != first:
                links += _links(np.sort(held), held_key[0]) if len(held) > 1 else []
                held = np.empty(0, np.uint64)
            sizes = np.diff(edges)
            for g in np.nonzero(sizes > 1)[0].tolist() if len(sizes) > 2 else []:
                if 0 < g < len(sizes) - 1:
                    links += _links(np.sort(fps[edges[g] : edges[g + 1]]), int(slot[edges[g]]))
            head = np.concatenate([held, fps[: edges[1]]])
            if len(sizes) == 1:
                held = head
            else:
                links += _links(np.sort(head), first[0]) if len(head) > 1 else []
                held = fps[edges[-2] :]
            held_key = (int(slot[-1]), int(key[-1]))
            yield out(links)
        yield out(_links(np.sort(held), held_key[0]) if len(held) > 1 else [])

    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(fp_col).bitwiseAND(F.lit(m).cast("long")).alias("key")) for n, m in _masks()]))
    filed = distinct.select(keys.alias("k"), F.col(fp_col).alias("fp")).select("k.slot", "k.key", "fp")
    return filed.repartition("slot", "key").sortWithinPartitions("slot", "key").transform(map_arrow, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits) and component_id.

    Documents link if their fingerprints differ in two bits or fewer; component_id is the
    smallest id that links reach, the document itself included. A null text counts as empty;
    texts without words have the fingerprint zero and link like any other. Repeated rows and
    equal ids stay as rows. A null id is never a component_id, unless a component has no other.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    labels = connected_components(fingerprint_links(distinct.select("fp")))
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(smallest, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_groups(sets: DataFrame) -> DataFrame:
    """(node, key): shingle sets (node, fp) filed by the component of their fingerprints in the index of two bits."""
    known = sets.where("fp is not null").select("node", "fp")
    labels = connected_components(fingerprint_links(known.select("fp").distinct()))
    labelled = known.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    return labelled.select("node", F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp")).alias("key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id, with all its columns.

    Documents link by their fingerprints, as in ``near_duplicates``; with ``similarity`` they link
    if the Jaccard similarity of their five-word shingles reaches it. Candidates come from the SimHash
    index over five-word fingerprints, and, as no bit limit that an index can guarantee finds all such
    pairs (at 0.8 about 10 of 64 bits differ), from MinHash bands as well; ``jaccard`` verifies the
    candidates of both on whole shingle sets, which alone decide. Rows that repeat an
    id count as one document, of which one row stays. Documents without an id cannot be told apart
    and all stay. Null and empty texts are equal texts; an empty table gives no rows.
    """
    known = docs.where(F.col(id_col).isNotNull())
    if similarity is None:
        found = near_duplicates(known, id_col, text_col)
    else:
        found = jaccard.near_copies(known, id_col, text_col, similarity, fingerprint_groups)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    one = known.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
