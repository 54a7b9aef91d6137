"""Operators on small inputs with known results, and results that must not depend on partitions or order."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import citations, discourse, gaps, graph, lifecycle, segment, stats, structure, topics, verify
from lacuna.operators import tfidf as R
from lacuna.operators import vectors as E
from lacuna.sources import tables
from lacuna.streaming import buckets, stream


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def sentences(spark, text):
    return one(spark, T.split_sentences(T.clean_text(F.col("t"))), t=text)


# text


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Vaswani et al. (2017) introduced attention, i.e., a weighted sum. Fig. 2 shows gains (e.g., from 12.4% to 8.2%). See Eq. 4 for more.", 3),
        ("We use a rate of 1.5e-4 with beta_1 = 0.9 and beta_2 = 0.999. We observed a p-value of p < 0.01 in all runs.", 2),
        ("Attention has quadratic complexity [1, 2]. In contrast, Linformer [3] is linear.", 2),
        ("Our contributions are threefold:\n1. A new model of text.\n2. A large corpus.\n3. A study of both.", 4),
        ("", 0),
        ("...", 0),
    ],
)
def test_sentences(spark, text, n):
    assert len(sentences(spark, text)) == n


def test_cleaning(spark):
    clean = lambda t: one(spark, T.clean_text(F.col("t")), t=t)
    assert clean("atten-\ntion") == "attention"
    assert clean("é ﬁne​  x\r\n\n\n\ny\n 12 \nz") == "é fine x\n\ny\nz"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.title_case(F.lit("self-attention of 3d nets"))) == "Self-Attention Of 3D Nets"
    assert one(spark, T.slugify(F.lit(" Flash-Attention: v2! "))) == "flash_attention_v2"


def test_papers_become_sentences(spark):
    papers = spark.createDataFrame([(42, None), (43, "Only an abstract. It has two sentences.")], "id long, abstract string")
    secs = spark.createDataFrame([(42, "Intro", 1, 3, 4, "", ["One here. Two here.", "Three here."])], "paper_id long, section_name string, section_order int, page_start int, page_end int, content string, paragraphs array<string>")
    rows = [(r["paper_id"], r["paragraph_id"], r["page_number"], r["sentence_order"], r["section_name"]) for r in segment.segment_papers(papers, secs).orderBy("paper_id", "sentence_order").collect()]
    assert rows == [(42, 0, 3, 1, "Intro"), (42, 0, 3, 2, "Intro"), (42, 1, 4, 3, "Intro"), (43, 0, 1, 1, "Abstract"), (43, 0, 1, 2, "Abstract")]


LABELLED = [
    ("In this paper, we propose a new method for parsing.", "", "OBJECTIVE"),
    ("Our model outperforms all baselines by a wide margin.", "results", "RESULT"),
    ("The validation set is drawn from the same news source.", "", "DATASET"),
    ("A notable limitation is that our method cannot scale to long inputs.", "", "LIMITATION"),
    ("In future work, we plan to extend this to more languages.", "", "FUTURE_WORK"),
    ("Existing approaches struggle with long documents.", "", "PROBLEM"),
    ("The network is trained using AdamW optimizer.", "", "METHOD"),
    ("The sky is blue.", "", "OTHER"),
    ("", "", "OTHER"),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(LABELLED)], "id int, source_text string, section_name string")
    got = [r["label"] for r in discourse.classify(df).orderBy("id").collect()]
    assert got == [k for _, _, k in LABELLED]


@pytest.mark.parametrize(
    ("text", "section", "kind"),
    [
        ("Attention has quadratic complexity in the input length.", "", "computational"),
        ("There is a lack of labeled data in this area.", "", "data_scarcity"),
        ("The model fails to generalize across domains.", "", "generalization"),
        ("Results are sensitive to hyperparameters.", "", "methodological"),
        ("A clear limitation remains in what was done.", "", "generic"),
        ("However, the sample was chosen by hand.", "Limitations", "generic"),
        ("Existing methods fail to capture long range structure.", "", None),
        ("We measure quadratic complexity in all runs.", "", None),
        ("Short", "", None),
    ],
)
def test_limitations(spark, text, section, kind):
    df = spark.createDataFrame([(text, section)], "source_text string, section_name string")
    assert discourse.detect_limitations(df).first()["subtype"] == kind


def test_entities(spark):
    df = spark.createDataFrame([(1, "Here we propose FlashNet and compare BERT on the SQuAD dataset with F1 of 91.2% and Accuracy.")], "id int, source_text string")
    names = lambda f: {r["entity_name"] for r in f(df).collect()}
    assert names(discourse.extract_methods) == {"FlashNet", "BERT"}
    assert any("SQuAD" in n for n in names(discourse.extract_datasets))
    scores = {r["entity_name"]: (r["score_value"], r["confidence"]) for r in discourse.extract_metrics(df).collect()}
    assert scores == {"F1": ("91.2%", 0.92), "Accuracy": (None, 0.86)}


def test_extractions_branch(spark):
    df = spark.createDataFrame([(i, 1, s, n) for i, (s, n, _) in enumerate(LABELLED)], "id long, paper_id long, source_text string, section_name string")
    rows = discourse.extract_all(df).collect()
    lim = [r for r in rows if r["extraction_type"] == "LIMITATION"]
    assert len(lim) == 1 and lim[0]["extraction_method"].startswith("limitation_detector_")
    assert not [r for r in rows if r["extraction_type"] == "OTHER"]


# structure and files


def test_year_doi_headers(spark):
    assert one(spark, structure.detect_year(F.lit("Copyright 2019 by us.\nIn 2001."))) == 2019
    assert one(spark, structure.detect_year(F.lit("Nothing but 2001."), F.lit("D:20240412"))) == 2024
    assert one(spark, structure.detect_doi(F.lit("see 10.1000/xyz-12.3 now"))) == "10.1000/xyz-12.3"
    assert one(spark, structure.section_header(F.lit("3.2. Experimental Setup"))) == "Experimental Setup"
    assert one(spark, structure.section_header(F.lit("Introduction to a long line " + "x" * 60))) is None


def test_files(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"plain"), ("c.txt", b"%PDF-"), ("d.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(body)
    good, bad = tables.validate_files(tables.land_files(spark, str(tmp_path)), most=50)
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["a.pdf"]
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()} == {"b.pdf": "invalid_signature", "c.txt": "invalid_extension", "d.pdf": "file_too_large"}


def test_replace_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    u = spark.createDataFrame([(2, "z")], "k int, v string")
    once = tables.replace_by_key(a, u, "k")
    assert sorted(once.collect()) == sorted(tables.replace_by_key(once, u, "k").collect()) == [(1, "x"), (2, "z")]


def test_saved_vectors_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    tables.save_vectors(df, str(tmp_path / "v"))
    assert tables.load_vectors(spark, str(tmp_path / "v"), 2, 2).count() == 2
    for dim, n in ((3, 2), (2, 5)):
        with pytest.raises(ValueError):
            tables.load_vectors(spark, str(tmp_path / "v"), dim, n)


# retrieval


def test_measures(spark):
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    hits = spark.createDataFrame([("q", i, n) for n, i in enumerate("axbyz", 1)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "c"), ("none", "a")], "query_id string, id string")
    got = {r["query_id"]: (r["precision"], r["recall"], round(r["rr"], 4)) for r in R.query_measures(q, hits, rel, 5).collect()}
    assert got == {"q": (0.2, 0.5, 0.3333), "none": (0.0, 0.0, 0.0)}


def test_embedding_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([(1, "Deep nets learn"), (2, "")], "id long, text string")
    a, b = ({r["id"]: r["embedding"] for r in E.hash_embed(df.repartition(n)).collect()} for n in (1, 5))
    # float vectors; a text without words is the zero vector
    assert a == b and abs(sum(x * x for x in a[1]) - 1) < 1e-6 and set(a[2]) == {0.0}


def test_embedding_equals_plain_loops():
    """Words between blanks with their signs, any script; a pair weighs as its second word."""
    import hashlib

    import numpy as np

    text = "Tiefe Netze, große\u00a0Netze: lernen!\n(2024) à lire"
    tokens, vec = text.lower().split(), np.zeros(384)
    bucket = lambda h, t: int(h(t.encode()).hexdigest()[:8], 16) % 384
    for i, t in enumerate(tokens):
        w = 1 / (1 + 0.05 * i)
        vec[bucket(hashlib.sha256, t)] += 1.5 * w
        if len(t) > 3:
            vec[bucket(hashlib.md5, t[:4])] += 0.75 * w
        if i:
            vec[bucket(hashlib.sha256, f"{tokens[i - 1]}_{t}")] += 2 * w
    got = E.hashing_model()([text])[0]
    assert len(tokens) == 8 and np.allclose(got, vec / np.linalg.norm(vec), atol=1e-6)


def test_plug_in_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in E.embed_with(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_knn_agrees_with_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["id"] for r in E.knn_join(v.where("id < 10").withColumnRenamed("id", "query_id"), v.repartition(7), 4).collect()}
    best = np.argsort(-(u[:10] @ u.T), axis=1)[:, :4]
    assert got == {(i, k + 1): int(best[i, k]) for i in range(10) for k in range(4)}
    near = {(r["query_id"], r["id"]) for r in E.knn_approx(v.where("id < 10").withColumnRenamed("id", "query_id"), v, 4, cells=8, probes=6).collect()}
    assert len(near & {(i, int(x)) for i in range(10) for x in best[i]}) >= 36


@pytest.mark.parametrize(("query_block", "vector_block"), [(4, 16), (1000, 1000)])
def test_joins_in_blocks_agree_with_brute_force(spark, monkeypatch, query_block, vector_block):
    """Null, zero and equal vectors, ties by id; links of a dense group above any number of neighbours."""
    import numpy as np

    monkeypatch.setattr(E, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(E, "VECTOR_BLOCK", vector_block)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 6))
    m[40:] = m[0] + rng.normal(size=(20, 6)) * 0.01  # a dense group
    m[7], m[8] = m[3], 0.0
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(u @ u.T, 12)
    q = v.where("id % 5 = 0 or id = 99").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in E.knn_join(q, v, 5).collect()}
    assert got == {(i, k + 1): int(j) for i in range(0, 60, 5) for k, j in enumerate(np.argsort(-scores[i], kind="stable")[:5])}
    links = [(r["source"], r["target"]) for r in E.neighbour_links(v, 0.9).collect()]
    assert all(scores[a, b] >= 0.9 for a, b in links)

    def groups(pairs):
        label = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(links) == groups([(a, b) for a in range(60) for b in range(60) if a != b and scores[a, b] >= 0.9])


def test_approximate_neighbours_of_the_table(spark):
    """Every vector is filed, and the recall of the registered parameters is measured against all pairs."""
    from lacuna.plans import registry
    from lacuna.plans import retrieval_queries as Q

    sf = "/root/testdata/sf0.01"
    v = Q.vectors(spark, sf)
    exact = {(r["query_id"], r["id"]) for r in E.knn_join(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 5).collect()}
    near = {(r["query_id"], r["id"]) for r in registry.queries()["e21_knn_approx"](spark, sf).collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_kmeans_topics_of_the_table_are_their_nearest_centres(spark):
    import numpy as np

    from lacuna.plans import registry
    from lacuna.plans import retrieval_queries as Q

    sf = "/root/testdata/sf0.001"
    data = {r["id"]: np.array(r["embedding"], float) for r in Q.vectors(spark, sf).collect()}
    rows, centres = topics.kmeans_topics(Q.vectors(spark, sf), 10)
    c = {r["topic_id"]: np.array(r["center"]) for r in centres.collect()}
    own = {r["id"]: r["topic_id"] for r in rows.collect()}
    assert all(own[i] == min(c, key=lambda k: np.linalg.norm(x - c[k])) for i, x in data.items())
    for r in registry.queries()["f6_discover_topics"](spark, sf).collect():
        assert own[r["id"]] == r["topic_id"] and r["probability"] == pytest.approx(1 / (1 + np.linalg.norm(data[r["id"]] - c[r["topic_id"]])), abs=1e-4)
    reduced = topics.reduce_dims(Q.vectors(spark, sf), len(data)).collect()
    m = np.array(list(data.values()))
    got = np.array([r["embedding"] for r in reduced])
    # variance along the five axes is that of the largest principal components
    assert np.allclose(sorted(got.var(axis=0)), sorted(np.linalg.eigvalsh(np.cov(m.T, bias=True))[-5:]), rtol=1e-6)


def test_topics_fall_back_to_kmeans(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(9)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    no_links = spark.createDataFrame([], "source long, target long")
    found = topics.density_or_kmeans(v, no_links).collect()
    assert len(found) == 9 and len({r["topic_id"] for r in found}) == 3 and all(r["topic_id"] >= 0 for r in found)
    # two clusters are asked for; with one, k-means takes over as well
    links = spark.createDataFrame([(0, 1), (1, 2)], "source long, target long")
    assert {r["topic_id"] for r in topics.density_or_kmeans(v, links, 3).collect()} == {0, 1, 2}
    links = spark.createDataFrame([(0, 1), (1, 2), (4, 5), (5, 6)], "source long, target long")
    kept = {r["id"]: r["topic_id"] for r in topics.density_or_kmeans(v, links, 3).collect()}
    assert kept == {i: 0 if i < 3 else 4 if 4 <= i <= 6 else -1 for i in range(9)}


def test_aliases_of_a_node_are_united_once_each(spark):
    n = spark.createDataFrame([("m", "B", "Method", ["x", "y"], 2), ("m", "A", "Method", ["y", "z"], 1), ("m", "C", "Method", [], 3), ("t", "T", "Topic", [], 1), ("u", "U", "Topic", None, 1)], "id string, label string, type string, aliases array<string>, seq long").withColumn("properties", F.create_map(F.lit("k"), F.lit("v")))
    got = {r["id"]: (r["label"], r["aliases"], r["seq"]) for r in graph.merge_nodes(n).collect()}
    assert got == {"m": ("A", ["x", "y", "z"], 1), "t": ("T", [], 1), "u": ("U", [], 1)}


def test_cypher_escapes_and_sets_all_properties(spark):
    n = spark.createDataFrame([("paper:o'1", "A \\ B", "Paper", {"title": "it's\nso", "my key": "v", "none": None}), ("t", "L'x", "Topic", {})], "id string, label string, type string, properties map<string,string>")
    e = spark.createDataFrame([("e", "paper:o'1", "t", "belongs_to", 0.8)], "id string, source string, target string, relationship string, confidence double")
    assert sorted(r["statement"] for r in graph.export_cypher(n, e).collect()) == sorted([
        "MERGE (n:Paper {id: 'paper:o\\'1'}) SET n += {`my key`: 'v', title: 'it\\'s\\nso'};",
        "MERGE (n:Topic {id: 't'}) SET n += {label: 'L\\'x'};",
        "MATCH (a {id: 'paper:o\\'1'}), (b {id: 't'}) MERGE (a)-[r:BELONGS_TO {confidence: 0.8}]->(b);",
    ])


# topics


@pytest.mark.parametrize(
    ("topic", "counts", "state"),
    [
        (1, {"2021": 1, "2022": 2, "2023": 6, "2024": 12, "2025": 20}, "EMERGING"),
        (1, {"2019": 10, "2020": 15, "2021": 8, "2024": 1, "2025": 0}, "DECLINING"),
        (1, {"2021": 5, "2022": 5, "2023": 6, "2024": 5, "2025": 5}, "PERSISTENT"),
        (-1, {"2021": 5}, "OUTLIER"),
        (1, {"2024": 1}, "EMERGING"),
        (1, {"2020": 9}, "PERSISTENT"),
        (1, {"Unknown": 4}, "PERSISTENT"),
    ],
)
def test_trajectory(spark, topic, counts, state):
    df = spark.createDataFrame([(topic, y, n) for y, n in counts.items()], "topic_id int, year string, n long")
    assert topics.trajectory(df).first()["trajectory"] == state


def test_years_and_trends(spark):
    rows = spark.createDataFrame([(1, y) for y in (2021, 2022, 2022, 2024, None, 2024, 2024, -3)], "topic_id int, year int")
    dist = topics.yearly_distribution(rows)
    assert topics.year_map(dist).first()["temporal_distribution"] == {"2021": 1, "2022": 2, "2024": 3, "Unknown": 2}
    own = spark.createDataFrame([(1, "2022", 5), (1, "2023", 10), (1, "Unknown", 2)], "topic_id int, year string, n long")
    total = spark.createDataFrame([("2022", 20), ("2023", 25)], "year string, n long")
    assert sorted((r["year"], r["n"], r["percentage"]) for r in topics.trend_points(own, total).collect()) == [(2022, 5, 25.0), (2023, 10, 40.0)]


def test_few_documents(spark):
    v = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(3)], "id long, embedding array<double>")
    assert topics.discover_topics(v.where("false")).count() == 0
    assert [(r["topic_id"], r["probability"]) for r in topics.discover_topics(v.limit(1)).collect()] == [(0, 1.0)]
    assert len({r["topic_id"] for r in topics.discover_topics(v).collect()}) == 2


# graph


def edges(spark, rows):
    return spark.createDataFrame([(f"{s}->{r}->{t}", s, t, r, c, None, None, n) for n, (s, t, r, c) in enumerate(rows)], "id string, source string, target string, relationship string, confidence double, paper_id long, source_text string, seq long")


def test_edge_fold(spark):
    e = edges(spark, [("a", "b", "uses", 0.9), ("a", "b", "uses", 0.8), ("a", "b", "extends", 0.7), ("a", "b", "uses", 0.6), ("c", "d", "uses", 0.5), ("c", "d", "uses", 0.8), ("c", "d", "uses", 0.8)])
    for n in (1, 6):
        got = {(r["source"], r["relationship"], r["confidence"], r["seq"]) for r in graph.merge_edges(e.repartition(n)).collect()}
        assert got == {("a", "uses", 0.6, 3), ("c", "uses", 0.8, 5)}


def test_components_and_walks(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", "r", 1.0) for i in range(25)] + [("x", "y", "r", 1.0)]
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(26)] + [("x",), ("y",), ("alone",)], "id string")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges(spark, chain)).collect()}
    assert {got[f"n{i:02d}"] for i in range(26)} == {"n00"} and (got["y"], got["alone"]) == ("x", "alone")
    hops = {r["id"]: r["hop"] for r in graph.ego(edges(spark, chain), nodes.where("id = 'n05'"), 2).collect()}
    assert hops == {"n05": 0, "n04": 1, "n06": 1, "n03": 2, "n07": 2}


def test_canonical_names(spark):
    name = lambda t: tuple(one(spark, graph.canonical_name(F.lit(t))))
    assert name("flash-attention") == ("FlashAttention", 0.95) and name("MIMIC-III") == ("MIMIC-III", 0.95)
    assert name("gcn") == ("GCN", 0.80) and name("graph-based  parsing") == ("Graph-Based Parsing", 0.80)


# gaps, lifecycle, verification


def test_signals(spark):
    v = lambda c: one(spark, c)
    lit = F.lit
    assert v(gaps.sig_underexplored(lit(1), lit(5.0))) == 0.8133 and v(gaps.sig_underexplored(lit(6), lit(4.0))) == 0
    assert v(gaps.sig_repeated(lit(3), lit(4))) == 0.83 and v(gaps.sig_repeated(lit(1), lit(4))) == 0
    assert v(gaps.sig_temporal(lit(2022), lit(2025), lit(False))) == 0.95 and v(gaps.sig_temporal(lit(2022), lit(2025), lit(True))) == 0
    assert v(gaps.sig_cross_domain(lit(1))) == 0.85 and v(gaps.sig_cross_domain(lit(3))) == 0
    assert v(gaps.sig_conflict(lit(2), lit(2))) == 0.85 and v(gaps.sig_conflict(lit(0), lit(2))) == 0
    assert v(gaps.priority(gaps.signals_map(repeated_limitation=lit(0.83), temporal_opportunity=lit(0.95)))) == 0.35
    c = spark.createDataFrame([("m", "BERT", 8), ("m", "Transformer", 1), ("m", "LSTM", 1), ("e", "a", 1), ("e", "b", 1), ("e", "c", 1), ("e", "d", 1)], "g string, name string, n long")
    got = {r["g"]: (round(r["hhi"], 4), r["signal"], r["top"]) for r in gaps.sig_concentration(c, ["g"]).collect()}
    assert got == {"m": (0.66, 0.4333, "BERT"), "e": (0.25, 0.0, "a")}


def test_limitation_keys(spark):
    key = lambda t: one(spark, gaps.limitation_key(F.lit(t)))
    assert key("Quadratic memory use") == "computational memory overhead"
    assert key("Too few samples") == "annotated data scarcity"
    assert key("This approach scales badly outdoors") == "this scales badly" and key("a b c") == "unspecified limitation"


def timeline(spark, rows):
    return spark.createDataFrame([("g", p, y, k, c, n) for n, (p, y, k, c) in enumerate(rows)], "gap_id string, paper_id long, year int, event_type string, confidence double, seq long")


L, P, A, H, O = "limitation_identified", "limitation_persists", "attempted_solution", "partial_solution", "reopened_limitation"


@pytest.mark.parametrize(
    ("rows", "state"),
    [
        ([(1, 2024, L, 0.9), (2, 2025, L, 0.9)], "EMERGING"),
        ([(1, 2024, L, 0.9), (1, 2025, L, 0.9)], "UNCERTAIN"),
        ([(1, 2020, L, 0.9), (2, 2024, P, 0.9)], "PERSISTENT"),
        ([(1, 2020, L, 0.9), (2, 2022, A, 0.9)], "ADDRESSED"),
        ([(1, 2020, L, 0.9), (2, 2022, A, 0.7)], "PARTIALLY_ADDRESSED"),
        ([(1, 2020, L, 0.9), (2, 2022, A, 0.9), (3, 2023, P, 0.9)], "REOPENED"),
        ([(1, 2020, L, 0.9), (2, 2022, A, 0.9), (3, 2021, O, 0.9)], "REOPENED"),
        ([(1, 2020, L, 0.9), (2, 2022, H, 0.9)], "PARTIALLY_ADDRESSED"),
        ([(1, 2020, L, 0.9), (2, 2022, A, 0.9), (3, 2022, P, 0.9)], "PARTIALLY_ADDRESSED"),
        ([(1, 2020, L, 0.9), (2, 2022, A, 0.9), (2, 2022, P, 0.9)], "ADDRESSED"),
    ],
)
def test_lifecycle(spark, rows, state):
    assert lifecycle.lifecycle(timeline(spark, rows)).first()["status"] == state


def test_timeline_steps(spark):
    t = timeline(spark, [(1, 2021, L, 0.9), (2, None, A, 0.9), (3, 2024, P, 0.9)])
    filled = lifecycle.impute_years(t).orderBy("seq").collect()
    assert [r["year"] for r in filled] == [2021, 2024, 2024]
    gone = spark.createDataFrame([("g", 1, "same text", 0.9, n) for n in range(2)] + [("g", 1, "Other remains open", 0.9, 2)], "gap_id string, paper_id long, source_text string, confidence double, seq long")
    events = lifecycle.dedupe_events(lifecycle.classify_events(gone))
    assert {r["event_type"] for r in events.collect()} == {L, P} and events.count() == 2


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The problem is still open.", P),
        ("It persists but is partially solved.", H),
        ("The issue may re-emerge again.", O),
        ("We propose a fix.", A),
        ("A partial solution is given.", H),
        ("Memory is large.", L),
    ],
)
def test_event_types(spark, text, kind):
    assert one(spark, lifecycle.event_type(F.lit(text))) == kind


def evidence(spark, rows):
    return spark.createDataFrame([("g", p, k, y, c) for p, k, y, c in rows], "gap_id string, paper_id long, category string, year int, confidence double")


@pytest.mark.parametrize(
    ("rows", "state", "sure"),
    [
        ([(1, "SUPPORTING", 2022, 0.92), (2, "SUPPORTING", 2024, 0.90)], "VERIFIED_OPEN", 0.7845),
        ([(1, "SUPPORTING", 2018, 0.92), (2, "SUPPORTING", 2019, 0.90)], "OUTDATED", 0.70),
        ([(1, "SUPPORTING", 2024, 0.92)], "UNCERTAIN", 0.35),
        ([(1, "SUPPORTING", 2024, 0.9), (2, "SUPPORTING", 2024, 0.9), (3, "COUNTER", 2024, 0.9)], "REFUTED", 0.2),
        ([(1, "SUPPORTING", 2024, 0.9), (2, "SUPPORTING", 2024, 0.9), (3, "CONTRADICTORY", 2024, 0.9)], "UNCERTAIN", 0.5),
        ([(1, "SUPPORTING", 2023, 0.9), (2, "SUPPORTING", 2024, 0.9), (3, "ADDRESSED_BY", 2024, 0.9)], "ADDRESSED", 0.88),
        ([(1, "SUPPORTING", 2023, 0.9), (2, "SUPPORTING", 2024, 0.9), (3, "ADDRESSED_BY", 2025, 0.7)], "PARTIALLY_ADDRESSED", 0.75),
    ],
)
def test_verification(spark, rows, state, sure):
    r = verify.verify(evidence(spark, rows), 2026).first()
    assert (r["status"], r["confidence"]) == (state, pytest.approx(sure))


# citations


def test_claims(spark):
    src = spark.createDataFrame([(1, "E1", "Quadratic memory overhead limits context")], "doc_id long, citation_id string, sentence_text string")
    text = "Quadratic memory limits scaling [E1]. Quadratic memory limits scaling [E99].\n- This is a claim without a tag.\nCompletely unlike words appear here [e1]."
    claims = citations.split_claims(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = {r["claim_text"]: (r["status"], r["support_score"]) for r in citations.validate_claims(claims, src).collect()}
    assert got == {
        "Quadratic memory limits scaling [E1].": ("SUPPORTED", 0.8),
        "Quadratic memory limits scaling [E99].": ("HALLUCINATED_CITATION", 0.0),
        "This is a claim without a tag.": ("INSUFFICIENT_EVIDENCE", 0.0),
        "Completely unlike words appear here [e1].": ("UNSUPPORTED", 0.0),
    }


def test_responses(spark):
    rows = [(1, '```json\n{"executive_summary": "x", "confidence": 0.4}\n```'), (2, "none"), (3, 'text {"problem_statement": "p"} more'), (4, None)]
    good, bad = citations.parse_responses(spark.createDataFrame(rows, "id int, response string"))
    assert {r["id"]: r["executive_summary"] or r["problem_statement"] for r in good.collect()} == {1: "x", 3: "p"}
    assert {r["id"] for r in bad.collect()} == {2, 4}


# statistics


def test_tails():
    assert stats.t_tail(2.3236, 9) == pytest.approx(0.0452, abs=2e-4)
    assert stats.t_quantile(0.975, 9) == pytest.approx(2.2622, abs=1e-4)
    assert stats._erfc_chi(3.841458820694124) == pytest.approx(0.05, abs=1e-9)


def test_fisher_and_mcnemar(spark):
    rows = [(1, 1)] * 8 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(0, 0)] * 5
    df = spark.createDataFrame([("g", a, b) for a, b in rows], "g string, gold int, pred int")
    assert stats.fisher(df, ["g"]).first()["p_value"] == pytest.approx(0.03497, abs=1e-4)
    pairs = spark.createDataFrame([("g", True, False)] * 10 + [("g", False, True)] * 2 + [("g", True, True)] * 5, "g string, right_a boolean, right_b boolean")
    r = stats.mcnemar(pairs, ["g"]).first()
    assert r["statistic"] == pytest.approx(49 / 12) and r["p_value"] == pytest.approx(0.0433, abs=1e-3)


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", i, float(i % 2)) for i in range(400)], "g string, row long, v double")
    r = stats.bootstrap_ci(df, "v", ["g"], 300).first()
    assert 0.43 < r["low"] < 0.47 and 0.53 < r["high"] < 0.57


# streams


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "Introduction", "Our model outperforms it. The sky is blue here.") for i in range(20)], "paper_id long, section_name string, paragraph string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.upsert_batches(stream.extract(read), str(tmp_path / "out"), "paper_id", str(tmp_path / "state")).start().awaitTermination()
    want = stream.extract(rows)
    got = buckets.read(spark, str(tmp_path / "out"), want.schema)
    key = lambda df: sorted((r["paper_id"], r["part"], r["label"]) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) == 40


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = spark.createDataFrame([(i, f"a{i}") for i in range(200)] + [(3, "twice")], schema)
    assert len(buckets.upsert(first, path, "k", 0, 16)) == 16
    second = spark.createDataFrame([(3, "b3"), (None, "no key"), (900, "new")], schema)
    touched = buckets.upsert(second, path, "k", 1, 99)
    assert 1 <= len(touched) <= 3
    state = buckets.states(spark, path)[-1]
    assert {b for b, v in state.at.items() if v == 2} == set(touched) and state.buckets == 16
    want = sorted([(i, f"a{i}") for i in range(200) if i != 3] + [(3, "b3"), (900, "new")])
    assert rows(buckets.read(spark, path, schema).where("k is not null")) == want
    files = sorted(str(f) for f in (tmp_path / "t").rglob("*.parquet"))
    assert buckets.upsert(second, path, "k", 1, 16) == [] and files == sorted(str(f) for f in (tmp_path / "t").rglob("*.parquet"))
    assert buckets.upsert(first.where("false"), path, "k", 2) == []
    kept = buckets.upsert(spark.createDataFrame([(3, "c3"), (901, "newer")], schema), path, "k", 3, keep=True)
    assert rows(buckets.read(spark, path, schema).where("k is not null")) == [*want, (901, "newer")]
    for n in range(4, 8):
        buckets.upsert(second, path, "k", n)
    assert rows(buckets.read(spark, path, schema).where("k is not null")) == [*want, (901, "newer")]
    assert len(buckets.states(spark, path)) == 2 and len(kept) <= 2
    current = {f"version={v}/bucket={b}" for s in buckets.states(spark, path) for b, v in s.at.items()}
    there = {str(p.relative_to(tmp_path / "t" / "data")) for p in (tmp_path / "t" / "data").glob("version=*/bucket=*")}
    assert there == current


def test_a_bucket_is_dealt_to_as_many_tasks_as_its_rows_fill(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_ROWS", 20)
    path, schema = str(tmp_path / "t"), "k long, v long, m map<string,long>"
    made = lambda keys, v: spark.createDataFrame([(k, v, {"a": 1}) for k in keys], schema)
    for n, (keys, v) in enumerate([(range(200), 1), (range(150, 250), 2)]):
        assert buckets.upsert(made(keys, v), path, "k", n, 1) == [0]
        files = list((tmp_path / "t" / "data" / f"version={n + 1}" / "bucket=0").glob("*.parquet"))
        assert len(files) > 4 and max(spark.read.parquet(str(f)).count() for f in files) < 100
    got = sorted((r["k"], r["v"]) for r in buckets.read(spark, path, schema).collect())
    assert got == [(k, 1) for k in range(150)] + [(k, 2) for k in range(150, 250)]


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    """Data without a manifest are not seen, and the batch that left them replaces them."""
    path, schema = str(tmp_path / "t"), "k long, v string"
    buckets.upsert(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, "k", 0, 4)
    spark.createDataFrame([(1, "half", 0)], schema + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/version=2")
    assert sorted(map(tuple, buckets.read(spark, path, schema).collect())) == [(1, "a"), (2, "b")]
    buckets.upsert(spark.createDataFrame([(1, "whole")], schema), path, "k", 1)
    assert sorted(map(tuple, buckets.read(spark, path, schema).collect())) == [(1, "whole"), (2, "b")]


def test_pairs_of_a_title_come_block_by_block(spark, monkeypatch):
    """A task listed all papers of a title after each reference to it, and buffered them; files of such pairs kept every value in full."""
    monkeypatch.setattr(graph, "TITLE_BLOCK", 16)
    papers = spark.createDataFrame([(i, " The Title" if i < 400 else f"Other {i % 30}") for i in range(500)] + [(-1, None), (-2, " ")], "id long, title string")
    refs = spark.createDataFrame([(i, 0, "the title " if i % 2 else f"OTHER {i % 30}") for i in range(0, 300)] + [(-1, 0, None), (-2, 0, "")], "paper_id long, ref_index int, title string")
    found = graph.citation_edges(refs, papers).select("source", "target").collect()
    title = lambda i: "t" if i < 400 else i % 30
    want = {(f"paper:{a}", f"paper:{b}") for a in range(300) for b in range(500) if a != b and title(b) == ("t" if a % 2 else a % 30)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    runs, last, size = [], None, 0
    for r in found:
        size = size + 1 if r["source"] == last else 1
        last = r["source"]
        runs.append(size)
    assert max(runs) < 60


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rows_that_work_makes_are_not_shuffled_or_cached(spark, tmp_path, monkeypatch):
    """Rows of 19 MB that two batches make from a few hundred short ones; they went through a cache and up to three shuffles."""
    monkeypatch.setattr(buckets, "KEYS", 40)
    path, table = str(tmp_path / "t"), "k long, v long, i int, noise array<double>, task int"
    made = lambda df: df.select("k", "v", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i")).withColumn("noise", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda x: F.rand())).withColumn("task", F.spark_partition_id())
    had = shuffled(spark)
    for n, (keys, v) in enumerate([(range(400), 1), (range(0, 600, 3), 2)]):
        batch = spark.createDataFrame([(k, v) for k in keys], "k long, v long")
        assert len(buckets.upsert(batch, path, "k", n, 8, work=made, task_rows=10)) == 8
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    assert shuffled(spark) - had < 200_000
    got = buckets.read(spark, path, table)
    assert sorted(tuple(r) for r in got.groupBy("k", "v").count().collect()) == sorted([(k, 1, 20) for k in range(400) if k % 3] + [(k, 2, 20) for k in range(0, 600, 3)])
    tasks = got.where("v = 2").groupBy("task").agg(F.count("*"), F.countDistinct(F.pmod(F.xxhash64("k"), F.lit(8)))).collect()
    assert len(tasks) > 16 and max(r[1] for r in tasks) <= 20 * 25 and {r[2] for r in tasks} == {1}


def test_keys_whose_work_gives_nothing_lose_their_rows(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    made = lambda df: df.where("v is not null")
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(1, None), (3, "c")], [(2, None)]]):
        buckets.upsert(spark.createDataFrame(rows, schema), path, "k", n, 4, work=made)
    assert [tuple(r) for r in buckets.read(spark, path, schema).collect()] == [(3, "c")]


def test_hashed_pairs_are_the_embedding_without_its_zeros(spark):
    import numpy as np

    texts = ["one two two three", "", None, "Größe des Netzes"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    for r in E.hashed_pairs(rows, "text").collect():
        own = np.zeros(384)
        own[r["embedding"]["place"]] = r["embedding"]["weight"]
        assert np.array_equal((own / r["embedding"]["length"]).astype(np.float32), E.hashing_model()([texts[r["n"]]])[0])


def test_landing_turns_away_all_repeats(spark, tmp_path):
    """Repeats in a batch, of an earlier batch after a restart, of stored hashes, and of what a new stream knows nothing of."""
    import hashlib

    def arrive(wave, *bodies):
        (tmp_path / "in" / wave).mkdir(parents=True)
        for n, body in enumerate(bodies):
            (tmp_path / "in" / wave / f"{n}.bin").write_bytes(body)

    def run(state):
        source = stream.landed(spark, str(tmp_path / "in" / "*"), stored)
        stream.land(source, str(tmp_path / "out"), str(tmp_path / state), buckets=4).start().awaitTermination()
        return sorted(r["path"][-8:] for r in buckets.read(spark, str(tmp_path / "out"), "path string, file_hash string").collect())

    stored = spark.createDataFrame([(hashlib.sha256(b"old").hexdigest(),)], "file_hash string")
    arrive("a", b"x", b"y", b"x", b"old")
    assert run("s") == ["/a/0.bin", "/a/1.bin"]
    arrive("b", b"y", b"z", b"old")
    assert run("s") == ["/a/0.bin", "/a/1.bin", "/b/1.bin"]
    arrive("c", b"w")
    stored = stored.where("false")
    assert run("new") == ["/a/0.bin", "/a/1.bin", "/a/3.bin", "/b/1.bin", "/c/0.bin"]  # what the table holds stays as it came


def test_the_first_of_each_key_is_kept_by_spark_itself(spark, tmp_path, monkeypatch):
    """A Python processor was asked about each key, which took 10 ms; and each file was looked up in a task of its own."""
    import pyarrow as pa

    rows = spark.range(30_000).select(F.col("id"), (F.col("id") * 7919 % 10_000).cast("string").alias("k"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stored = rows.select("k").where("k < '2'")
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    firsts = stream.first_of_key(read, "k", "id", stored)
    q = firsts.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert {p["stateOperators"][0]["operatorName"] for p in q.recentProgress if p["stateOperators"]} == {"dedupe"}
    got, want = spark.table("firsts"), rows.where("k >= '2'")
    assert got.count() == got.select("k").distinct().count() == want.select("k").distinct().count()
    assert got.join(rows, ["id", "k"], "left_anti").count() == 0

    monkeypatch.setattr(stream, "GATHERED", 10)
    made = [(key, n, new) for n in range(40) for key in ("a", None, f"own {n % 13}") for new in ([True, False] if key == "own 3" else [True])]
    batches = [pa.RecordBatch.from_pylist([dict(k=k, order=100 - n, __new=new) for k, n, new in made[i : i + 7]]) for i in range(0, len(made), 7)]
    found = {r["k"]: (r["order"], r["__new"]) for b in stream._first_rows("k", "order")(batches) for r in b.to_pylist()}
    assert found == {k: min((new, 100 - n) for key, n, new in made if key == k)[::-1] for k in {m[0] for m in made}}
    stream.landed(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 8 * spark.sparkContext.defaultParallelism


def test_landing_stream_drops_copies(spark, tmp_path):
    for n, body in enumerate((b"a", b"b", b"a")):
        (tmp_path / f"{n}.bin").write_bytes(body)
    q = stream.landed(spark, str(tmp_path)).writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert spark.table("landed").count() == 2


def test_rank_statistics_agree_with_plain_loops(spark):
    """Kendall with ties and weights, exact and normal signed-rank tails, Poisson draws."""
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(g, int(rng.integers(6)) / 2, int(rng.integers(9)) / 3) for g in ("a", "b") for _ in range(80)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["tau"] for r in stats.kendall(df, ["g"]).collect()}
    for g in ("a", "b"):
        own = [(x, y) for k, x, y in rows if k == g]
        sign = lambda v: (v > 0) - (v < 0)
        s = nx = ny = 0
        for (a, b), (c, d) in itertools.combinations(own, 2):
            s, nx, ny = s + sign(a - c) * sign(b - d), nx + (a != c), ny + (b != d)
        assert got[g] == pytest.approx(s / math.sqrt(nx * ny))
    assert got["c"] is None
    # five values, all positive: both tails are 2 / 2^5; four of them 0.125
    for n, p in ((5, 0.0625), (4, 0.125)):
        d = spark.createDataFrame([("k", float(i + 1), 0.0) for i in range(n)], "g string, x double, y double")
        r = stats.wilcoxon(d, ["g"]).first()
        assert (r["n"], r["statistic"]) == (n, 0.0) and r["p_value"] == pytest.approx(p)
    t = stats.poisson_draws(rng.integers(-(1 << 62), 1 << 62, 2000), 50)
    assert abs(t.mean() - 1) < 0.01 and abs(t.var() - 1) < 0.03


def test_frequent_words_join_no_rows(spark):
    """Pairs that share two words are found, also where all sentences share the most frequent one."""
    import itertools
    import random

    rnd = random.Random(2)
    vocabulary = ["common"] + [f"word{chr(97 + i)}" for i in range(12)]
    text = lambda: " ".join(["common"] + rnd.sample(vocabulary[1:], 3))
    sentences = spark.createDataFrame([(i, i % 7, "we solve " + text()) for i in range(60)], "id long, paper_id long, source_text string")
    limits = spark.createDataFrame([(i, i % 5, text()) for i in range(100, 160)], "id long, paper_id long, extracted_text string")
    got = {(r["seq"], r["target"]) for r in graph.address_edges(sentences, limits).collect()}
    long = lambda t: {w for w in t.split() if len(w) > 3}
    expected = {
        (a["id"], f"limitation:{b['id']}")
        for a, b in itertools.product(sentences.collect(), limits.collect())
        if a["paper_id"] != b["paper_id"] and len(long(a["source_text"]) & long(b["extracted_text"])) >= 2
    }
    assert got == expected and expected
