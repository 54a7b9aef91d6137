"""Topics and neighbours by the ways that avoid all pairs, against plain loops."""

import numpy as np
import pytest

from lacuna.operators import graph, topics
from lacuna.operators import vectors as E


@pytest.fixture(scope="module")
def clusters(spark):
    """3,000 vectors around 60 centres; group g holds a third of them for g = 0."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    own = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 60, 3000))
    x = centres[own] + 0.2 * rng.standard_normal((3000, 32))
    rows = [(i, int(g), [float(a) for a in v]) for i, (g, v) in enumerate(zip(own, x))]
    return spark.createDataFrame(rows, "id long, g int, embedding array<double>").repartition(4).cache(), x / np.linalg.norm(x, axis=1, keepdims=True), own


def test_probes_are_measured_and_few_on_clusters(clusters):
    df, x, _ = clusters
    cells = E.cell_count(3000)
    probes = E.probes_for(df, E.fit_cells(df, cells), 10, 0.95)
    assert probes / cells < 0.15
    got = {(r["query_id"], r["id"]) for r in E.knn_approx(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), df, 10).collect()}
    want = {(i, int(j)) for i in range(0, 3000, 20) for j in np.argsort(-(x @ x[i]), kind="stable")[:10]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_near_links_connect_what_all_links_connect(clusters):
    df, x, _ = clusters
    found = {r["id"]: r["component"] for r in graph.components(df.select("id"), E.near_links(df, 0.9)).collect()}
    exact = {r["id"]: r["component"] for r in graph.components(df.select("id"), E.neighbour_links(df, 0.9)).collect()}
    assert found == exact
    links = [(r["source"], r["target"]) for r in E.near_links(df, 0.9).collect()]
    assert all(x[a] @ x[b] >= 0.9 - 1e-9 and a != b for a, b in links)


def test_all_cells_are_probed_if_nothing_less_will_do(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(a) for a in rng.standard_normal(16)]) for i in range(300)], "id long, embedding array<double>")
    got = E.knn_approx(df.withColumnRenamed("id", "query_id"), df, 5, cells=10, target=1.0)
    true = E.knn_join(df.withColumnRenamed("id", "query_id"), df, 5)
    assert {tuple(r) for r in got.select("query_id", "id").collect()} == {tuple(r) for r in true.select("query_id", "id").collect()}


def test_one_cluster_gives_way_to_kmeans(spark):
    df = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(12)], "id long, embedding array<double>")
    links = spark.createDataFrame([(i, i + 1) for i in range(11)], "source long, target long")
    found = {r["id"]: r["topic_id"] for r in topics.density_or_kmeans(df, links, max_topics=3).collect()}
    assert len(set(found.values())) == 3
    two = links.where("source <> 5")
    assert len({r["topic_id"] for r in topics.density_or_kmeans(df, two, max_topics=3).collect()}) == 2


def test_few_documents_are_sure(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, embedding array<double>")
    none = spark.createDataFrame([], "source long, target long")
    for n, kinds in ((2, 2), (3, 2)):
        for rows in (topics.discover_topics(df.where(f"id < {n}")).collect(), topics.density_or_kmeans(df.where(f"id < {n}"), none).collect()):
            assert {r["probability"] for r in rows} == {1.0} and len({r["topic_id"] for r in rows}) == kinds


def test_reduced_density_finds_clusters(clusters):
    df, _, own = clusters
    few = df.where("g < 4")
    found = {r["id"]: r["topic_id"] for r in topics.reduced_density(few.select("id", "embedding"), 0.98, 5).collect() if r["topic_id"] != -1}
    groups = {}
    for i, t in found.items():
        groups.setdefault(t, set()).add(int(own[i]))
    assert len(found) > 0.9 * few.count() and all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("block", [7, 8192])
def test_euclidean_silhouette_equals_plain_loops(spark, block):
    rng = np.random.default_rng(3)
    label = [0] * 30 + [1] * 20 + [2] + [-1] * 4
    x = rng.standard_normal((55, 3)) + np.array(label)[:, None]
    df = spark.createDataFrame([(i, t, [float(a) for a in v]) for i, (t, v) in enumerate(zip(label, x))], "id long, topic_id int, embedding array<double>")
    values = []
    for i in range(51):
        mean = {t: np.mean([np.linalg.norm(x[i] - x[j]) for j in range(51) if label[j] == t and j != i]) for t in (0, 1, 2) if any(label[j] == t and j != i for j in range(51))}
        a = mean.pop(label[i], None)
        b = min(mean.values())
        values.append(0.0 if a is None else (b - a) / max(a, b))
    assert abs(topics.euclidean_silhouette(df, block=block).first()[0] - np.mean(values)) < 1e-9
    assert topics.euclidean_silhouette(df.where("topic_id = 0")).first()[0] == 0.0
    assert topics.euclidean_silhouette(df.where("false")).first()[0] == 0.0


def test_refit_is_stable_where_topics_are_clear(spark):
    rng = np.random.default_rng(5)
    words = [["alpha", "beta", "gamma"], ["delta", "epsilon", "zeta"], ["eta", "theta", "iota"]]
    rows = [(i, " ".join(words[i % 3]), [float(a) for a in np.eye(3)[i % 3] * 10 + 0.1 * rng.standard_normal(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    samples = topics.subsamples(df, 5, 0.8)
    sizes = {r["run"]: r["count"] for r in samples.groupBy("run").count().collect()}
    assert sizes == {0: 90} | dict.fromkeys(range(1, 6), 72)
    assert {tuple(r) for r in samples.collect()} == {tuple(r) for r in topics.subsamples(df, 5, 0.8).collect()}
    found = topics.cluster_runs(df, samples, 3).collect()
    for run in range(6):
        kinds = {}
        for r in found:
            if r["run"] == run:
                kinds.setdefault(r["topic_id"], set()).add(r["id"] % 3)
        assert sorted(map(sorted, kinds.values())) == [[0], [1], [2]]
    stable = topics.refit_stability(df.select("id", "text"), df.select("id", "embedding"), 3, top=3, ngrams=1).collect()
    assert [(r["n"], r["stability"]) for r in sorted(stable)] == [(72, 1.0)] * 5
    noise = spark.createDataFrame([(i, " ".join(f"w{a}" for a in rng.integers(0, 60, 8)), [float(a) for a in rng.standard_normal(3)]) for i in range(90)], "id long, text string, embedding array<double>")
    unstable = topics.refit_stability(noise.select("id", "text"), noise.select("id", "embedding"), 5)
    assert 0 < topics.stability_summary(unstable).first()["mean"] < 0.9


def test_term_stability_counts_topics_without_a_match(spark):
    rows = [(0, 0, t) for t in "abc"] + [(0, 1, t) for t in "xyz"] + [(1, 5, t) for t in "abd"] + [(2, 0, "q")]
    found = {r["run"]: r["stability"] for r in topics.term_stability(spark.createDataFrame(rows, "run int, topic_id int, term string")).collect()}
    assert found == {1: (2 / 4 + 0) / 2, 2: 0.0}


def test_no_vectors_are_gathered_to_count_the_distinct_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "id long, embedding array<double>")
    gathered, plain = [], type(df).distinct
    monkeypatch.setattr(type(df), "distinct", lambda self: gathered.append(self.schema) or plain(self))
    found = topics.cluster_runs(df, topics.subsamples(df, 1), 2, starts=2, rounds=3).collect()
    assert gathered and not any(f.dataType.typeName() == "array" for s in gathered for f in s.fields)
    assert len(found) == 60 + 48
