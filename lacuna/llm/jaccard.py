"""Near copies by the Jaccard similarity of five-word shingles: MinHash bands, verified on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, majority, map_arrow
from lacuna.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: MinHash rows of a band, and the share of pairs at the least similarity that all bands may miss.
ROWS, MISS = 6, 6e-6
#: Fingerprints of one band key are compared in pairs of blocks of about this size.
BLOCK = 1024


def bands_for(similarity: float) -> int:
    """Bands so that a pair at ``similarity`` shares one but for MISS of the cases: 40 at 0.8."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def _mixers(bands: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.RandomState(42).randint(0, 1 << 32, (2, 2, bands * ROWS, 1), dtype=np.uint64)
    both = seeds[0] << np.uint64(32) | seeds[1]
    return both[0], both[1] | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; fewer words are one shingle, no words none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(np.array([digest(b" ".join(tokens[i : i + WORDS]), 42) for i in range(max(1, len(tokens) - WORDS + 1))], np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def band_keys(shingles: np.ndarray, flip: np.ndarray, times: np.ndarray) -> list[int]:
    """The MinHash key of each band, its number hashed in; an empty set has none."""
    import xxhash

    if not len(shingles):
        return []
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[None, i : i + 512] ^ flip) * times).min(axis=1), out=least)
    rows = least.reshape(-1, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), j) for j, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def forest(keys: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of at least ``similarity`` that connect all sets such links connect."""
    # shared / (one + other - shared) >= p / q, in integers
    part = Fraction(similarity).limit_denominator(10_000)
    weight, least = part.numerator + part.denominator, part.numerator
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(keys[0], keys[1])] if weight * shared >= least * (len(sets[0]) + len(sets[1])) else []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(codes))])
    own = np.split(codes, np.cumsum(sizes)[:-1])
    group, links = np.arange(len(sets)), []
    for i in range(len(sets)):
        if (group == group[i]).all():
            continue
        shared = np.bincount(np.concatenate([holders[starts[c] : starts[c + 1]] for c in own[i]]), minlength=len(sets))
        near = np.nonzero((weight * shared >= least * (sizes + sizes[i])) & (group != group[i]))[0]
        for g, j in zip(*np.unique(group[near], return_index=True)):
            links.append((keys[i], keys[near[j]]))
            group[group == g] = group[i]
    return links


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int) -> DataFrame:
    """(id, node, fp, bands): the key of every text's shingle set, its SimHash (null for the empty set) and its band keys."""
    flip, times = _mixers(bands)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            fps = pa.array([int(np.uint64(majority(s)).view(np.int64)) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s) for s in sets], pa.int64()), fps, pa.array([band_keys(s, flip, times) for s in sets], pa.list_(pa.int64()))], names=[id_col, "node", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t"))
    return rows.transform(map_arrow, run, f"{id_col} long, node long, fp long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of a column of texts; the shingles are the bytes of the sorted set."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return rows.transform(map_arrow, run, "node long, shingles binary")


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links among the rows (key, p, q, node, shingles) of each key and pair of blocks."""

    def run(batches):
        at, nodes, sets = None, [], []
        for b in batches:
            links = []
            for *here, node, shingles in zip(*(c.to_pylist() for c in b.columns)):
                if here != at:
                    links += forest(nodes, sets, similarity) if len(nodes) > 1 else []
                    at, nodes, sets = here, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(shingles, np.uint64))
            yield out(links)
        yield out(forest(nodes, sets, similarity) if len(nodes) > 1 else [])

    def out(links):
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node").transform(map_arrow, run, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a document: id and component_id, the smallest id that links reach.

    Documents link if the Jaccard similarity of their five-word shingles reaches ``similarity``.
    Documents with equal sets are one node. Nodes that share a band key are candidates, as are those that
    share a key of ``groups``, which maps rows (node, fp) to (node, key), such as an index of fingerprints; all
    pairs of them are compared on whole sets, in blocks; keys with equal members are compared once.
    """
    found = cut(signatures(docs, id_col, text_col, bands_for(similarity)), "signatures")
    nodes = found.groupBy("node").agg(F.min(id_col).alias("least"))
    filed = found.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    if groups is not None:
        filed = filed.unionByName(groups(found.select("node", "fp").distinct()))
    filed = cut(filed, "bands")
    alike = filed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    once = alike.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    shared = cut(filed.join(once, "key").select("key", "node", "blocks", block.alias("block")), "candidates")
    wanted = shared.select("node").distinct().join(nodes, "node").select(F.col("least").alias(id_col)).distinct()
    texts = docs.join(wanted, id_col, "left_semi").select(F.col(text_col).cast("binary").alias("t"))
    pairs = shared.select("key", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node")
    labels = connected_components(_links(pairs.join(_sets(texts), "node").select("key", "p", "q", "node", "shingles"), similarity))
    labelled = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return found.select(id_col, "node").join(labelled.join(smallest, "label").select("node", "component_id"), "node").select(id_col, "component_id")
