"""Queries over the order graph: building, views, walks and fixed look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import graph as G
from lacuna.operators import graph_lookups as L
from lacuna.plans import views as V
from lacuna.plans.registry import query
from lacuna.functions.text import slugify


def merged(spark, sf):
    return G.merge_edges(V.graph_edges(spark, sf))


@query("g1_slugify", r"SELECT doc_id, substr(regexp_replace(regexp_replace(trim(lower(split_part(text, chr(10), 1)), ' '), '[^\p{L}\p{N}_\s\p{Z}-]', '', 'g'), '[-\s\p{Z}]+', '_', 'g'), 1, 64) AS slug FROM documents")
def g1(spark, sf):
    return V.papers(spark, sf).select(F.col("id").alias("doc_id"), slugify(F.col("title")).alias("slug"))


_TABLE = {"is": "Is-Name", "of the": "Of-The"}


@query("g2_canonicalize", r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS raw FROM documents) SELECT raw, CASE WHEN lower(raw) = 'is' THEN 'Is-Name' WHEN length(raw) <= 5 THEN upper(raw) ELSE upper(raw[1]) || lower(substr(raw, 2)) END AS name, CASE WHEN lower(raw) = 'is' THEN 0.95::DOUBLE ELSE 0.80::DOUBLE END AS confidence FROM w")
def g2(spark, sf):
    w = V.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("raw")).distinct()
    return w.select("raw", G.canonical_name(F.col("raw"), _TABLE).alias("c")).select("raw", "c.name", "c.confidence")


@query("g3_paper_nodes", f"WITH {V.PAPERS} SELECT 'paper:' || id AS id, title AS label, 'Paper' AS type, publication_year::VARCHAR AS year FROM papers")
def g3(spark, sf):
    return G.paper_nodes(V.papers(spark, sf)).select("id", "label", "type", F.col("properties")["publication_year"].alias("year"))


def _authored(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.array("c_name", F.concat(F.lit("Clerk "), F.col("o_orderkey") % 100)).alias("authors"))


@query("g4_author_nodes", "SELECT 'author:' || regexp_replace(lower(replace(c_name, '#', '')), '[-\\s]+', '_', 'g') AS source, 'paper:' || o_orderkey AS target, 0.98::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'author:clerk_' || (o_orderkey % 100), 'paper:' || o_orderkey, 0.98 FROM orders JOIN customer ON o_custkey = c_custkey")
def g4(spark, sf):
    return G.author_nodes(_authored(spark, sf))[1].select("source", "target", "confidence")


@query("g5_entity_nodes", "SELECT DISTINCT 'method:' || regexp_replace(lower(replace(p_brand, '#', '')), '[-\\s]+', '_', 'g') AS id FROM part")
def g5(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("extracted_text"))
    return G.merge_nodes(G.entity_nodes(p, "Method")).select("id")


@query("g6_statement_nodes", f"WITH {V.SENTENCES} SELECT 'limitation:' || id AS id, CASE WHEN length(source_text) > 80 THEN substr(source_text, 1, 80) || '...' ELSE source_text END AS label FROM sentences")
def g6(spark, sf):
    s = V.sentences(spark, sf).select("id", "paper_id", F.col("source_text").alias("extracted_text"))
    return G.statement_nodes(s, "Limitation", "limitation").select("id", "label")


@query("g7_topic_nodes", "SELECT DISTINCT 'topic:' || label AS id, 'Topic' AS type FROM embeddings")
def g7(spark, sf):
    t = V.table(spark, sf, "embeddings").select(F.col("label").alias("topic_id"), F.concat(F.lit("Topic "), "label").alias("topic_name"), F.lit("PERSISTENT").alias("status"), F.lit(1).alias("paper_count")).distinct()
    return G.topic_nodes(t).select("id", "type")


@query("g8_merge_nodes", "SELECT 'part:' || lower(p_brand) AS id, arg_min(p_name, p_partkey) AS label, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS aliases FROM part GROUP BY 1")
def g8(spark, sf):
    p = V.table(spark, sf, "part")
    n = G.node(p, F.concat(F.lit("part:"), F.lower("p_brand")), F.col("p_name"), "Method", aliases=F.array("p_type"), seq=F.col("p_partkey"))
    return G.merge_nodes(n).select("id", "label", F.array_join("aliases", "|").alias("aliases"))


@query("g9_make_edges", "SELECT 'paper:' || l_orderkey || '->uses->part:' || l_partkey AS id, round(least(greatest(l_tax * 20, 0.0), 1.0), 4) AS confidence FROM lineitem")
def g9(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return G.edge(li, F.concat(F.lit("paper:"), "l_orderkey"), F.concat(F.lit("part:"), "l_partkey"), F.lit("uses"), F.col("l_tax") * 20, F.col("l_orderkey")).select("id", "confidence")


@query("g10_valid_edges", f"WITH {V.GRAPH_EDGES} SELECT source, target, relationship, seq FROM edges WHERE paper_id % 3 = 0 AND target LIKE 'method:%'")
def g10(spark, sf):
    n = V.graph_nodes(spark, sf).where("type = 'method' or (type = 'paper' and cast(label as bigint) % 3 = 0)")
    return G.valid_edges(V.graph_edges(spark, sf), n).select("source", "target", "relationship", "seq")


@query("g11_merge_edges", f"WITH {V.MERGED_EDGES} SELECT source, target, relationship, confidence, seq FROM merged")
def g11(spark, sf):
    return merged(spark, sf).select("source", "target", "relationship", "confidence", "seq")


@query("g12_citation_edges", f"WITH {V.PAPERS}, r AS (SELECT id AS paper_id, '  ' || lower(title) || ' ' AS t FROM papers) SELECT 'paper:' || paper_id AS source, 'paper:' || id AS target FROM r JOIN papers ON lower(trim(t)) = lower(trim(title)) WHERE paper_id <> id AND length(trim(title)) > 0")
def g12(spark, sf):
    p = V.papers(spark, sf)
    refs = p.select(F.col("id").alias("paper_id"), F.lit(0).alias("ref_index"), F.concat(F.lit("  "), F.lower("title"), F.lit(" ")).alias("title"))
    return G.citation_edges(refs, p).select("source", "target")


_CUE = lambda w: f"replace(' ' || text, ' {w} ', ' {{}} ')"


@query("g13_method_relation", "SELECT doc_id, CASE WHEN contains(text, ' of ') THEN 'proposes' WHEN contains(text, ' the ') THEN 'extends' WHEN contains(text, ' de ') THEN 'compares' ELSE 'uses' END AS relationship, CASE WHEN contains(text, ' of ') THEN 0.95::DOUBLE WHEN contains(text, ' the ') THEN 0.90 WHEN contains(text, ' de ') THEN 0.85 ELSE 0.75 END AS confidence FROM documents")
def g13(spark, sf):
    t = F.col("text")
    for w, cue in (("of", "we propose"), ("the", "building upon"), ("de", "compared with")):
        t = F.replace(t, F.lit(f" {w} "), F.lit(f" {cue} "))
    d = V.table(spark, sf, "documents").withColumn("r", G.method_relation(t))
    return d.select("doc_id", "r.relationship", "r.confidence")


def _extractions(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["DATASET", "LIMITATION", "OBJECTIVE", "RESULT", "FUTURE_WORK"])), (F.col("part") % 5 + 1).cast("int"))
    return V.sentences(spark, sf).select("id", "paper_id", F.col("id").alias("sentence_id"), kind.alias("extraction_type"), F.when(F.col("part") % 5 == 0, F.lit("squad")).otherwise(F.col("source_text")).alias("extracted_text"), "source_text")


@query("g14_extraction_edges", f"WITH {V.SENTENCES} SELECT 'paper:' || paper_id AS source, CASE part % 5 WHEN 0 THEN 'dataset:squad' WHEN 1 THEN 'limitation:' || id WHEN 2 THEN 'claim:' || id WHEN 3 THEN 'finding:' || id ELSE 'direction:' || id END AS target, CASE part % 5 WHEN 0 THEN 'uses' WHEN 1 THEN 'limited_by' ELSE 'proposes' END AS relationship, CASE part % 5 WHEN 0 THEN 0.90::DOUBLE WHEN 1 THEN 0.92 WHEN 2 THEN 0.88 WHEN 3 THEN 0.90 ELSE 0.85 END AS confidence FROM sentences")
def g14(spark, sf):
    e = _extractions(spark, sf)
    return G.extraction_edges(e.drop("source_text"), V.sentences(spark, sf), V.papers(spark, sf)).select("source", "target", "relationship", "confidence")


@query("g15_membership_edges", "SELECT 'paper:' || vec_id AS source, 'topic:' || label AS target, greatest(0.60, least(1.0, vec_id % 100 / 100)) AS confidence FROM embeddings WHERE label < 5")
def g15(spark, sf):
    a = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").alias("topic_id"), (F.col("vec_id") % 100 / 100).alias("probability"))
    return G.membership_edges(a, a.where("topic_id < 5").select("topic_id").distinct()).select("source", "target", "confidence")


_SOLVE, _LIMIT = V.word("erat"), V.word("onor")


_LONG = r"regexp_extract_all(lower(source_text), '[\p{L}\p{N}_]{4,}')"


@query("g16_address_edges", f"WITH {V.SENTENCES}, a AS (SELECT DISTINCT id, paper_id, unnest({_LONG}) AS w FROM sentences WHERE {V.hit('source_text', _SOLVE)}), b AS (SELECT DISTINCT id AS lim, paper_id AS lp, unnest({_LONG}) AS w FROM sentences WHERE {V.hit('source_text', _LIMIT)}) SELECT 'paper:' || paper_id AS source, 'limitation:' || lim AS target, id AS seq FROM a JOIN b USING (w) WHERE paper_id <> lp GROUP BY id, paper_id, lim HAVING count(*) >= 2")
def g16(spark, sf):
    s = V.sentences(spark, sf)
    lims = s.where(F.col("source_text").rlike("(?i)" + _LIMIT)).select("id", "paper_id", F.col("source_text").alias("extracted_text"))
    return G.address_edges(s, lims, _SOLVE, with_text=False).select("source", "target", "seq")


@query("g17_align_claims", f"WITH {V.PAPERS} SELECT 'claim:' || id AS source, 'claim:' || (id + 1) AS target, CASE WHEN contains(text, ' of ') THEN 'contradicts' ELSE 'supports' END AS relationship, round(CASE WHEN contains(text, ' of ') THEN least(0.95, s + 0.1) ELSE least(0.95, s) END, 4) AS confidence FROM (SELECT *, (id % 100) / 100 AS s FROM papers) WHERE contains(text, ' of ') OR s >= 0.75 ".replace("THEN least(0.95, s + 0.1)", "THEN CASE WHEN s > 0 THEN least(0.95, s + 0.1) ELSE 0.85 END"))
def g17(spark, sf):
    p = V.papers(spark, sf)
    cue = F.when(F.col("text").contains(" of "), "this contradicts it").otherwise("plain")
    pairs = p.select(F.concat(F.lit("claim:"), "id").alias("source"), F.concat(F.lit("claim:"), F.col("id") + 1).alias("target"), cue.alias("source_text"), F.lit("other").alias("target_text"), (F.col("id") % 100 / 100).alias("similarity"))
    return G.align_claims(pairs).select("source", "target", "relationship", "confidence")


@query("g18_build_graph", f"WITH {V.MERGED_EDGES} SELECT relationship, count(*) AS n, round(sum(confidence), 4) AS total FROM merged GROUP BY 1")
def g18(spark, sf):
    n = V.graph_nodes(spark, sf).select("id", "label", "type", F.create_map().cast("map<string,string>").alias("properties"), F.array().cast("array<string>").alias("aliases"), F.lit(0).cast("long").alias("seq"))
    e = V.graph_edges(spark, sf)
    edges = G.build_graph([n], [e])[1]
    return edges.groupBy("relationship").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


def _ordered(spark, sf):
    """Orders and their customers, a graph of many components."""
    o = V.table(spark, sf, "orders")
    e = o.select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), F.col("o_custkey")).alias("target"), F.lit("by").alias("relationship"), F.lit(1.0).alias("confidence"), F.col("o_orderkey").alias("paper_id"), F.lit(None).cast("string").alias("source_text"), F.lit(0).cast("long").alias("seq")).withColumn("id", F.concat("source", "target"))
    ids = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return ids.select("id", F.col("id").alias("label"), F.substring("id", 1, 1).alias("type")), e


@query("g19_components", "WITH o AS (SELECT 'o' || o_orderkey AS s, 'c' || o_custkey AS t FROM orders), m AS (SELECT t, least(t, min(s)) AS c FROM o GROUP BY t) SELECT s AS id, c AS component FROM o JOIN m USING (t) UNION SELECT t, c FROM m")
def g19(spark, sf):
    return G.components(*_ordered(spark, sf))


@query("g20_overview", f"WITH {V.GRAPH_EDGES}, {V.GRAPH_NODES}, a AS (SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY ALL) SELECT * FROM a UNION ALL SELECT kind, 'total', sum(n)::BIGINT FROM a GROUP BY kind")
def g20(spark, sf):
    return G.overview(V.graph_nodes(spark, sf), V.graph_edges(spark, sf))


@query("g20_density", f"WITH {V.MERGED_EDGES}, {V.GRAPH_NODES} SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM merged) AS m, round((SELECT count(*) FROM merged) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS density")
def g20d(spark, sf):
    return G.density(V.graph_nodes(spark, sf), merged(spark, sf))


_UND = "u AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)"


@query("g21_ego", f"WITH {V.GRAPH_EDGES}, {_UND}, h1 AS (SELECT DISTINCT b AS id FROM u WHERE a = 'paper:1'), h2 AS (SELECT DISTINCT b AS id FROM u JOIN h1 ON a = h1.id WHERE b <> 'paper:1' AND b NOT IN (SELECT id FROM h1)) SELECT 'paper:1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2")
def g21(spark, sf):
    seed = V.graph_nodes(spark, sf).where("id = 'paper:1'")
    return G.ego(V.graph_edges(spark, sf), seed, 2)


@query("g22_induced", f"WITH {V.GRAPH_EDGES} SELECT source, target, relationship, seq FROM edges WHERE paper_id % 7 = 0 AND target LIKE 'topic:%'")
def g22(spark, sf):
    n = V.graph_nodes(spark, sf)
    return G.induced(n, V.graph_edges(spark, sf), n.where("type = 'topic' or (type = 'paper' and cast(label as bigint) % 7 = 0)"))[1].select("source", "target", "relationship", "seq")


@query("g23_filter_graph", f"WITH {V.GRAPH_EDGES}, {V.GRAPH_NODES} SELECT id FROM nodes WHERE type = 'method' AND (contains(lower(label), 'brand#1') OR contains(lower(type), 'brand#1'))")
def g23(spark, sf):
    return G.filter_graph(V.graph_nodes(spark, sf), V.graph_edges(spark, sf), "method", "Brand#1")[0].select("id")


@query("g24_merge_egos", f"WITH {V.GRAPH_EDGES}, {_UND} SELECT DISTINCT b AS id FROM u WHERE a IN ('paper:1', 'paper:2', 'paper:3') UNION SELECT unnest(['paper:1', 'paper:2', 'paper:3'])")
def g24(spark, sf):
    n, e = V.graph_nodes(spark, sf), V.graph_edges(spark, sf)
    return G.merge_egos([G.induced(n, e, G.ego(e, n.where(F.col("id") == f"paper:{k}"), 1)) for k in (1, 2, 3)])[0].select("id")


_RANK = "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS rank FROM ids)" + "".join(
    f", f{k} AS MATERIALIZED (SELECT target AS id, sum(rank / deg) AS got FROM links JOIN r{k - 1} ON id = source GROUP BY 1), r{k} AS MATERIALIZED (SELECT ids.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT source FROM deg)) / (SELECT count(*) FROM ids) + 0.85 * coalesce(got, 0) AS rank FROM ids LEFT JOIN f{k} USING (id))"
    for k in range(1, 11)
)


@query("g25_pagerank", f"WITH e AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target FROM orders), ids AS (SELECT source AS id FROM e UNION SELECT target FROM e), deg AS (SELECT source, count(*) AS deg FROM e GROUP BY 1), links AS (SELECT * FROM e JOIN deg USING (source)), {_RANK} SELECT id, round(rank, 9) AS rank FROM r10")
def g25(spark, sf):
    return G.pagerank(*_ordered(spark, sf), rounds=10).withColumn("rank", F.round("rank", 9))


_E = f"WITH {V.GRAPH_EDGES}"


@query("g26_addressing", f"{_E} SELECT paper_id, confidence, seq FROM edges WHERE relationship = 'belongs_to' AND target = 'topic:building'")
def g26(spark, sf):
    return L.papers_by_relation(V.graph_edges(spark, sf), "belongs_to", "topic:building").select("paper_id", "confidence", "seq")


@query("g27_extending", f"{_E} SELECT paper_id, confidence, seq FROM edges WHERE relationship = 'extends' AND target = 'method:brand#11'")
def g27(spark, sf):
    return L.papers_by_relation(V.graph_edges(spark, sf), "extends", "method:brand#11").select("paper_id", "confidence", "seq")


@query("g28_methods_for_dataset", f"{_E} SELECT DISTINCT m.target AS method FROM edges d JOIN edges m ON m.source = d.source WHERE d.target = (SELECT min(target) FROM edges WHERE target LIKE 'dataset:%') AND m.target LIKE 'method:%'")
def g28(spark, sf):
    e = V.graph_edges(spark, sf)
    ds = e.where("target like 'dataset:%'").agg(F.min("target")).first()[0]
    return L.methods_for_dataset(e, ds)


@query("g29_supporting", f"{_E} SELECT source, confidence, seq FROM edges WHERE relationship = 'uses' AND target = 'method:brand#12'")
def g29(spark, sf):
    return L.claims_by_relation(V.graph_edges(spark, sf), "uses", "method:brand#12").select("source", "confidence", "seq")


@query("g30_contradicting", f"{_E} SELECT source, confidence, seq FROM edges WHERE relationship = 'extends' AND target = 'method:brand#21'")
def g30(spark, sf):
    return L.claims_by_relation(V.graph_edges(spark, sf), "extends", "method:brand#21").select("source", "confidence", "seq")


@query("g31_topic_papers", f"{_E}, {V.GRAPH_NODES} SELECT e.source AS id, n.label, e.confidence FROM edges e JOIN nodes n ON n.id = e.source WHERE target = 'topic:machinery'")
def g31(spark, sf):
    return L.topic_papers(V.graph_nodes(spark, sf), V.graph_edges(spark, sf), "machinery").select("id", "label", "confidence")


@query("g32_limitation_papers", f"{_E} SELECT relationship AS role, paper_id, seq FROM edges WHERE target = 'method:brand#13' AND relationship IN ('uses', 'extends')")
def g32(spark, sf):
    return L.limitation_papers(V.graph_edges(spark, sf), "method:brand#13", ("uses", "extends")).select("role", "paper_id", "seq")


@query("g33_directions", f"{_E} SELECT target AS direction, 'direct' AS link FROM edges WHERE source = 'paper:5' AND relationship = 'belongs_to' UNION ALL SELECT b.target, 'same_paper' FROM edges a JOIN edges b ON a.source = b.source WHERE a.target = 'method:brand#14' AND b.target LIKE 'dataset:%'")
def g33(spark, sf):
    e = V.graph_edges(spark, sf)
    return L.directions(e, "paper:5", "belongs_to", "method:brand#14", "dataset:")


@query("g34_find_nodes", f"{_E}, {V.GRAPH_NODES} SELECT id FROM nodes WHERE id LIKE '%brand#15' OR contains(lower(label), 'brand#15')")
def g34(spark, sf):
    n = V.graph_nodes(spark, sf).withColumn("aliases", F.array().cast("array<string>"))
    return L.find_nodes(n, "brand#15").select("id")


@query("g35_context", f"{_E} SELECT relationship AS role, count(*) AS n, count(DISTINCT paper_id) AS papers FROM edges WHERE target = 'method:brand#22' GROUP BY 1")
def g35(spark, sf):
    c = L.method_context(V.graph_edges(spark, sf), "method:brand#22", ("uses", "extends"))
    return c.select("role", "n", F.size("papers").cast("long").alias("papers"))


@query("g36_provenance", f"WITH {V.SENTENCES} SELECT id, 'Paper ' || paper_id || ', ' || section_name || ', p. 1' AS citation FROM sentences")
def g36(spark, sf):
    s = V.sentences(spark, sf)
    p = G.provenance(F.col("paper_id"), F.concat(F.lit("Paper "), "paper_id"), F.col("id"), F.col("section_name"), F.lit(None).cast("int"), F.col("source_text"), F.lit(1.2), F.lit("rule"))
    rows = s.withColumn("provenance", p)
    # nothing lacks its origin here, so the rows of provenance_gaps add none
    whole = rows.join(G.provenance_gaps(rows).select("id"), "id", "left_anti")
    return whole.select("id", G.cite(F.col("provenance.paper_title"), F.col("provenance.section_name"), F.col("provenance.page_number")).alias("citation"))


_TEXT = "replace(replace({}, chr(92), chr(92) || chr(92)), '''', chr(92) || '''')"
_NODE = f"'MERGE (n:' || upper(type[1]) || substr(type, 2) || ' {{id: ''' || {_TEXT.format('id')} || '''}}) SET n += {{label: ''' || {_TEXT.format('label')} || ''', name: ''it' || chr(92) || '''s ' || {_TEXT.format('label')} || '''}};'"
_LINK = f"'MATCH (a {{id: ''' || {_TEXT.format('source')} || '''}}), (b {{id: ''' || {_TEXT.format('target')} || '''}}) MERGE (a)-[r:' || upper(relationship) || ' {{confidence: ' || CASE WHEN confidence = 1 THEN '1.0' ELSE confidence::VARCHAR END || '}}]->(b);'"


@query("a14_export_cypher", f"{_E}, {V.GRAPH_NODES} SELECT {_NODE} AS statement FROM nodes UNION ALL SELECT {_LINK} FROM edges".replace("{{", "{").replace("}}", "}"))
def a14(spark, sf):
    n = V.graph_nodes(spark, sf).withColumn("type", F.initcap("type"))
    n = n.withColumn("properties", F.create_map(F.lit("label"), F.col("label"), F.lit("name"), F.concat(F.lit("it's "), "label")))
    return G.export_cypher(n, V.graph_edges(spark, sf)).select("statement")
