"""Whitening, mixing and fill-in-the-middle against brute force, and their edge cases."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from lacuna.llm import fim, mixing, whitening
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size long, n long, output string, target double, slot long, h string"
LONG = "".join(f"line {i % 37} of many\n" for i in range(40_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\n\t", None), (4, LONG, "b"), (5, "same words\nhere", "a"), (6, "same words\nhere", "a"), (6, "same words\nhere", "a"), (None, "no id\n", ""), (7, "a <S> b\nc", "b"), (8, "é\nß\n漢字\n\U0001f600", "c"), (9, "x" * 200_000, "c")]
    return spark.createDataFrame([(i, t, s, 1, 2, "o", 0.5, 3, "h") for i, t, s in rows], SCHEMA)


# 11


def brute_components(x):
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return y, values[::-1], vectors[:, ::-1], ((n * x - s) ** 2).sum(axis=1)


def test_whitening_equals_a_dense_solver(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    model = whitening.fit(vectors)
    rows = {r["vec_id"]: r for r in whitening.whiten(vectors, model).collect()}
    raw = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    ids = sorted(raw)
    x = np.floor(64 * np.array([raw[i] for i in ids], float)).astype(int) + 1_000_000
    y, values, basis, away = brute_components(x)
    assert [rows[i]["deviation"] for i in ids] == away.tolist()
    assert np.allclose(model.values, values[:32], rtol=1e-12)
    got, want = np.array([rows[i]["whitened"] for i in ids]), y @ basis[:, :32] / np.sqrt(values[:32])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert model.identity_error < 1e-10
    assert np.abs(got.T @ got / len(ids) - np.eye(32)).max() < 1e-9
    first = whitening.by_component(whitening.whiten(vectors, model), model).where("component = 32").first()
    assert first["n"] == len(ids) and math.isclose(first["explained"], values[31] / values.sum(), rel_tol=1e-9)


def test_contour_integration_on_hard_spectra(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    for values in (np.full(48, 3.0), np.r_[[5.0] * 10, [3.0] * 20, [1.0] * 18], np.exp(-np.arange(48) / 3.0), np.r_[[1.0, 1.0 + 1e-9], np.linspace(0, 0.5, 46)], np.arange(48.0), np.r_[7.0, np.zeros(47)]):
        a = q @ np.diag(values) @ q.T
        want = np.sort(values)[::-1]
        want = want[: min(32, int((want > 1e-10 * want[0]).sum()))]
        a = (a + a.T) / 2
        got, vectors = whitening.components(spark, a, 32)
        assert len(got) == len(want) and np.abs(got - want).max() < 1e-12 * want[0]
        assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    shifts = np.linspace(-12, 12, 50)
    values = np.linalg.eigvalsh(a)
    assert whitening.count_below(*whitening.tridiagonal(a), shifts).tolist() == [int((values < s).sum()) for s in shifts]


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (None, [3.0, -1.0]), (6, [0.0, 0.0, 1.0]), (7, []), (8, [1e30, 0.0]), (9, [-2.0, 5.5])]
    df = spark.createDataFrame([(i, v, 1, "w") for i, v in rows], "vec_id long, embedding array<double>, n int, whitened string")
    model = whitening.fit(df)
    got = whitening.by_component(whitening.whiten(df, model), model).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 9: 2}
    assert {r["n"] for r in got} == {4}
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.by_component(whitening.whiten(same, whitening.fit(same)), whitening.fit(same)).count() == 0
    for none in (same.where("false"), df.where("vec_id in (2, 5)")):
        assert whitening.fit(none) is None
        assert whitening.by_component(whitening.whiten(none, None), None).count() == 0


def test_deviations_stay_exact_beyond_long_arithmetic():
    model = whitening.Whitening(3_000_000_000, [3_000_000_001 * 1_000_000, 5], np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[1_000_001, 1], [1_000_000, 1 << 30]])
    want = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    assert model.deviations(x) == [v if v < 2**63 else None for v in want]


# 12


def brute_mix(rows):
    """taken of each (row, size) by walking the repeated, shuffled words of each source to its target."""
    sizes = collections.defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    out = []
    for s in order:
        own = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], -1 if i is None else i, n) for i, t, n in rows if t == s)
        left, taken = math.floor(target[s] + 0.5), [0] * len(own)
        while left and sizes[s]:
            for k, (_, _, n) in enumerate(own):
                taken[k] += min(n, left)
                left -= min(n, left)
        out += [(None if i < 0 else i, n, sizes[s], round(target[s], 6), t) for (_, i, n), t in zip(own, taken)]
    return sorted(out, key=repr)


def of_mix(df, **options):
    got = mixing.taken(mixing.mix(df, **options))
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_takes_what_a_walk_over_shuffled_words_takes(docs, block):
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    assert of_mix(docs, block=block) == brute_mix(rows)


def test_mix_of_odd_documents(odd):
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.collect()]
    assert of_mix(odd, block=64) == brute_mix(rows)
    assert mixing.mix(odd.where("false")).count() == 0
    assert of_mix(odd.where("doc_id in (1, 2)")) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_schedule_is_even_everywhere(docs):
    """In any stretch of slots each source has its share, within a few slots, and slots are full but the last of a source."""
    mixed = mixing.mix(docs, block=16).where("slot is not null")
    rows = mixed.groupBy("slot", "sid").agg(F.sum("words").alias("words")).orderBy("slot").collect()
    total, per = len(rows), collections.Counter(r["sid"] for r in rows)
    assert len({r["slot"] for r in rows}) == total
    assert sum(r["words"] < 16 for r in rows) <= len(per)
    for at in range(0, total - total // 10, total // 10):
        here = collections.Counter(r["sid"] for r in rows[at : at + total // 10])
        assert all(abs(here[s] - per[s] / 10) <= 8 for s in per)


def test_points_are_those_of_the_golden_ratio(spark):
    ids = [0, 1, 2, 1000, 1 << 20, (1 << 41) + 12345]
    df = spark.createDataFrame([(i,) for i in ids], "t long")
    got = {r["t"]: r["p"] for r in df.select("t", mixing.point(F.col("t")).alias("p")).collect()}
    assert all(got[t] == (t + 1) * mixing.STEP % (1 << 40) for t in ids)


def test_many_sources_with_one_that_has_most(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 700)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    rows = [(r["doc_id"], r["source"], len(r["text"].split())) for r in df.collect()]
    assert of_mix(df, block=32) == brute_mix(rows)


# 13


def brute_fim(doc_id, text, spm=50, share=100):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"share": 60, "spm": 10}])
def test_fim_equals_brute_force_and_restores(docs, odd, options):
    for df in (docs, odd):
        got = fim.transform(df, **options).withColumn("back", fim.restore(F.col("output"), F.col("form")))
        texts = collections.Counter((r["doc_id"], r["text"] or "") for r in df.collect())
        rows = got.collect()
        assert len(rows) == sum(texts.values())
        for r in rows:
            text = r["text"] or ""
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fim(r["doc_id"], text, **options)
            assert r["back"] == text
        assert collections.Counter((r["doc_id"], r["text"] or "") for r in rows) == texts
    assert set(fim.transform(odd).columns) == {*odd.columns, "form", "prefix_chars", "middle_chars"}
    assert fim.transform(odd.where("false")).count() == 0


def test_chunks_follow_content_and_are_remembered():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(32, 127, 300_000, np.uint8))
    cut = lambda data: {data[s:e] for s, e in zip([0, *fim.chunk_ends(data)], fim.chunk_ends(data))}
    a, b = shared, b"another beginning\n" * 50 + shared
    assert len(cut(a) & cut(b)) > 0.9 * len(cut(a))
    for data in (a, b, LONG.encode(), b"\n" * 3_000_000, b"y" * 2_500_000, b"", b"z"):
        ends = fim.chunk_ends(data)
        assert (ends or [0])[-1] == len(data) and all(0 < e - s <= fim.MOST for s, e in zip([0, *ends], ends))
    lines = fim.Lines(memory=100_000)
    lines.cuts(a, 1, 2)
    small = fim.Lines()
    small.cuts(a, 1, 2)
    small.cuts(b, 1, 2)
    assert small.hits > 0.9 * len(cut(a)) and lines.held < 100_000 + 2 * fim.MOST * 5
    assert lines.cuts(b, 12345, 99) == small.cuts(b, 12345, 99)


def test_hash_of_a_place_needs_the_last_32_bytes_only():
    data = np.random.default_rng(3).integers(0, 256, 500, np.uint8)
    whole = fim.rolling(data)
    assert all(whole[i] == fim.rolling(data[i - 31 : i + 1])[-1] for i in range(31, 500, 17))
    want = sum(int(fim.GEAR[data[200 - k]]) << k for k in range(32)) % (1 << 32)
    assert int(whole[200]) == want
