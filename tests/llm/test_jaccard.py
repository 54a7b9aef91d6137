"""Near copies of the pipeline against brute-force Jaccard over five-word shingles."""

import itertools
import random

import corpus_pipeline
from lacuna.llm import jaccard
from test_operators import find

SF = "/root/testdata/sf0.01"


def brute_shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(texts):
    sets = {d: brute_shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 9 * shared >= 4 * (len(sets[a]) + len(sets[b])) > 0:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return sorted(d for d in parent if find(parent, d) == d)


def kept(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())


def test_table_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert kept(spark, texts) == brute_kept(texts)


def test_group_of_copies_with_edits_and_short_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng, texts = random.Random(5), {0: None, 1: "", 2: "Two words", 3: "two  WORDS", 4: "two other words"}
    base = [f"w{i}" for i in range(150)]
    for d in range(5, 155):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts[d] = " ".join(w)
    expected = brute_kept(texts)
    assert 5 < len(expected) < 150
    assert kept(spark, texts) == expected


def test_the_fingerprint_index_gives_candidates_by_itself(spark, monkeypatch):
    """Without any MinHash band the SimHash index still finds long near copies; whole sets decide."""
    monkeypatch.setattr(jaccard, "bands_for", lambda similarity: 0)
    rng = random.Random(7)
    long = [[f"{t}{rng.random()}" for _ in range(3000)] for t in "ab"]
    texts = {1: " ".join(long[0]), 2: " ".join(long[0][:-1]), 3: " ".join(long[1]), 4: " ".join(long[1] + ["more"]), 5: "", 6: None, 7: "two words"}
    assert kept(spark, texts) == brute_kept(texts) == [1, 3, 5, 7]
