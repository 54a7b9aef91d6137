"""Queries over gaps: signals, candidates, timelines, verification, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.text import token_overlap
from lacuna.operators import citations as K
from lacuna.operators import gaps as H
from lacuna.operators import lifecycle as I
from lacuna.operators import verify as J
from lacuna.plans import views as V
from lacuna.plans.registry import query


def _use(spark, sf):
    li, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey)


_SUPP = "c AS (SELECT l_suppkey AS k, count(DISTINCT l_orderkey) AS papers, count(*) AS n, count(DISTINCT l_returnflag) AS flags, min(year(l_shipdate)) AS first, max(year(l_shipdate)) AS last, bool_or(l_quantity >= 50 AND l_suppkey % 3 = 0) AS solved FROM lineitem GROUP BY 1)"


def _supp(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("k")).agg(F.count_distinct("l_orderkey").alias("papers"), F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("flags"), F.min(F.year("l_shipdate")).alias("first"), F.max(F.year("l_shipdate")).alias("last"), F.bool_or((F.col("l_quantity") >= 50) & (F.col("l_suppkey") % 3 == 0)).alias("solved"))


@query("h1_underexplored", "WITH c AS (SELECT p_brand AS k, p_type AS t, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT avg(n) AS m FROM c) SELECT k, t, CASE WHEN n / m < 0.75 THEN round(greatest(0.0, least(1.0, 1 - n / m / 0.75 * 0.7)), 4) ELSE 0.0 END AS signal FROM c, m")
def h1(spark, sf):
    c = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_type").alias("t")).agg(F.count("*").alias("n"))
    m = c.agg(F.avg("n").alias("m"))
    return c.crossJoin(F.broadcast(m)).select("k", "t", H.sig_underexplored(F.col("n"), F.col("m")).alias("signal"))  # one row


@query("h2_repeated", f"WITH {_SUPP} SELECT k, CASE WHEN papers >= 600 THEN round(least(1.0, 0.60 + 0.15 * (papers - 600) / 100.0 + least(0.10, 0.02 * n)), 4)::DOUBLE ELSE 0 END AS signal FROM c")
def h2(spark, sf):
    return _supp(spark, sf).select("k", H.sig_repeated(2 + (F.col("papers") - 600) / 100.0, F.col("n")).alias("signal"))


_CONC = "WITH c AS (SELECT {by} AS g, {name} AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT g, sum(n) AS total FROM c GROUP BY 1), h AS (SELECT g, any_value(total)::BIGINT AS total, sum((n / total) * (n / total)) AS hhi, arg_min(name, lpad((1000000 - n)::VARCHAR, 8, '0') || name) AS top, max(n) / any_value(total) AS top_share FROM c JOIN t USING (g) GROUP BY 1) SELECT g, total, round(hhi, 6) AS hhi, top, round(top_share, 6) AS top_share, CASE WHEN total > 1 AND hhi >= 0.5 THEN round(least(1.0, (hhi - 0.40) / 0.60), 4) ELSE 0.0 END AS signal FROM h"


def _conc(spark, sf, by, name):
    counts = _use(spark, sf).groupBy(F.col(by).alias("g"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return H.sig_concentration(counts, ["g"]).select("g", "total", F.round("hhi", 6).alias("hhi"), "top", F.round("top_share", 6).alias("top_share"), "signal")


@query("h3_method_concentration", _CONC.format(by="l_orderkey", name="p_brand"))
def h3(spark, sf):
    return _conc(spark, sf, "l_orderkey", "p_brand")


@query("h4_dataset_concentration", _CONC.format(by="l_orderkey", name="p_type"))
def h4(spark, sf):
    return _conc(spark, sf, "l_orderkey", "p_type")


@query("h5_temporal", f"WITH {_SUPP} SELECT k, CASE WHEN NOT solved AND last - first >= 1 THEN round(least(1.0, 0.50 + 0.15 * (last - first)), 4)::DOUBLE ELSE 0 END AS signal FROM c")
def h5(spark, sf):
    return _supp(spark, sf).select("k", H.sig_temporal(F.col("first"), F.col("last"), F.col("solved")).alias("signal"))


@query("h6_cross_domain", "SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_returnflag) <= 1 THEN 0.85::DOUBLE ELSE 0 END AS signal FROM lineitem GROUP BY 1")
def h6(spark, sf):
    c = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_returnflag").alias("d"))
    return c.select("k", H.sig_cross_domain(F.col("d")).alias("signal"))


@query("h7_conflict", "SELECT l_orderkey AS k, CASE WHEN sum((l_returnflag = 'R')::INT) >= 1 AND count(DISTINCT l_suppkey) >= 2 THEN round(least(1.0, 0.75 + 0.10 * (sum((l_returnflag = 'R')::INT) - 1)), 4)::DOUBLE ELSE 0 END AS signal FROM lineitem GROUP BY 1")
def h7(spark, sf):
    c = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("c"), F.count_distinct("l_suppkey").alias("p"))
    return c.select("k", H.sig_conflict(F.col("c"), F.col("p")).alias("signal"))


_KEYS = [(V.word("thon"), "key one"), (V.word("the"), "key two")]
def key_sql(rules) -> str:
    """SQL of ``limitation_key`` under the rules."""
    known = " ".join(f"WHEN {V.hit('source_text', p)} THEN '{name}'" for p, name in rules)
    plain = f"list_filter(regexp_extract_all(lower(source_text), '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda x: x NOT IN ({', '.join(chr(39) + w + chr(39) for w in lexicon.NO_KEY_WORDS)}))"
    return f"CASE {known} ELSE coalesce(nullif(array_to_string({plain}[1:3], ' '), ''), 'unspecified limitation') END"


def _limits(spark, sf):
    p = V.papers(spark, sf).select(F.col("id").alias("paper_id"), F.col("publication_year").alias("year"))
    return V.sentences(spark, sf).join(p, "paper_id")


@query("h8_limitation_key", f"WITH {V.SENTENCES} SELECT id, {key_sql(_KEYS)} AS key FROM sentences")
def h8(spark, sf):
    return _limits(spark, sf).select("id", H.limitation_key(F.col("source_text"), _KEYS).alias("key"))


_SLUG = r"substr(regexp_replace(regexp_replace(trim(lower(key), ' '), '[^\p{L}\p{N}_\s\p{Z}-]', '', 'g'), '[-\s\p{Z}]+', '-', 'g'), 1, 32)"


@query("h9_limitation_gaps", f"WITH {V.SENTENCES}, {V.PAPERS}, s AS (SELECT s.id, paper_id, publication_year AS year, {key_sql(lexicon.LIMITATION_KEYS)} AS key FROM sentences s JOIN papers p ON p.id = s.paper_id), g AS (SELECT key, count(DISTINCT paper_id) AS p, count(*) AS n, min(year) AS a, max(year) AS b, bool_or(id % 5 = 0) AS solved FROM s GROUP BY 1) SELECT 'gap-limitation-' || {_SLUG} AS gap_id, p AS n_papers, n AS n_evidence, CASE WHEN p >= 2 THEN round(least(1.0, 0.60 + 0.15 * (p - 2) + least(0.10, 0.02 * n)), 4)::DOUBLE ELSE 0 END AS rep, CASE WHEN a IS NOT NULL AND NOT solved AND b - a >= 1 THEN round(least(1.0, 0.5 + 0.15 * (b - a)), 4)::DOUBLE ELSE 0 END AS temporal FROM g")
def h9(spark, sf):
    s = _limits(spark, sf).withColumn("confidence", F.lit(0.9))
    g = H.limitation_gaps(s.select("id", "paper_id", "year", F.col("source_text").alias("text"), "confidence"), s.where("id % 5 = 0").select("id"))
    m = F.col("signals")
    return g.select("gap_id", "n_papers", "n_evidence", m["repeated_limitation"].alias("rep"), m["temporal_opportunity"].alias("temporal"))


@query("h10_topic_gaps", "WITH m AS (SELECT p_brand AS t, p_partkey AS p FROM part WHERE p_size > 10 OR p_brand < 'Brand#3'), c AS (SELECT b.t, count(DISTINCT p) AS n FROM (SELECT DISTINCT p_brand AS t FROM part) b LEFT JOIN m USING (t) GROUP BY 1), a AS (SELECT avg(n) AS a FROM c) SELECT 'gap-topic-' || t AS gap_id, n AS n_papers, round(CASE WHEN n / a < 0.75 THEN round(greatest(0.0, least(1.0, 1 - n / a / 0.75 * 0.7)), 4) * 0.2 ELSE 0 END, 4) + 0.1275 AS priority FROM c, a WHERE n > 0")
def h10(spark, sf):
    p = V.table(spark, sf, "part")
    topics = p.select(F.col("p_brand").alias("topic_id"), F.col("p_brand").alias("topic_name")).distinct()
    members = p.where("p_size > 10 or p_brand < 'Brand#3'").select(F.col("p_brand").alias("topic_id"), F.col("p_partkey").alias("paper_id"))
    return H.topic_gaps(topics, members).select("gap_id", "n_papers", F.col("gap_priority_score").alias("priority"))


@query("h11_concentration_gaps", "WITH c AS (SELECT CASE WHEN l_quantity > 10 THEN 'Alpha' ELSE 'Beta ' || l_linenumber END AS name, l_orderkey AS p FROM lineitem), n AS (SELECT name, count(*) AS n FROM c GROUP BY 1), h AS (SELECT sum((n / (SELECT count(*) FROM c)) * (n / (SELECT count(*) FROM c))) AS h FROM n) SELECT 'gap-method-alpha' AS gap_id, count(DISTINCT p) AS n_papers, count(*) AS n_evidence, round(round(least(1.0, ((SELECT h FROM h) - 0.40) / 0.60), 4) * 0.08, 4) AS priority FROM c WHERE name = 'Alpha' AND (SELECT h FROM h) >= 0.5")
def h11(spark, sf):
    li = V.table(spark, sf, "lineitem")
    name = F.when(F.col("l_quantity") > 10, F.lit("Alpha")).otherwise(F.concat(F.lit("Beta "), "l_linenumber"))
    return H.concentration_gaps(li.select(name.alias("name"), F.col("l_orderkey").alias("paper_id")), "method").select("gap_id", "n_papers", "n_evidence", F.col("gap_priority_score").alias("priority"))


@query("h12_conflict_gaps", "SELECT 'gap-conflict' AS gap_id, count(DISTINCT l_orderkey) AS n_papers, count(*) AS n_evidence, 1.0::DOUBLE AS signal FROM lineitem WHERE l_returnflag = 'R'")
def h12(spark, sf):
    e = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.lit("contradicts").alias("relationship"), F.col("l_orderkey").alias("paper_id"))
    return H.conflict_gaps(e).select("gap_id", "n_papers", "n_evidence", F.col("signals")["conflicting_evidence"].alias("signal"))


_SIG = list(lexicon.SIGNAL_WEIGHTS.items())
_VALS = ", ".join(f"((p_partkey * {i + 3}) % 10) / 10 AS v{i}" for i in range(len(_SIG)))
_PRIO = "round(least(greatest(" + " + ".join(f"round(v{i} * {w}::DOUBLE, 4)" for i, (_, w) in enumerate(_SIG)) + ", 0.0), 1.0), 4)"


def candidates(spark, sf):
    p = V.table(spark, sf, "part")
    signals = H.signals_map(**{k: (F.col("p_partkey") * (i + 3)) % 10 / 10 for i, (k, _) in enumerate(_SIG)})
    c = p.select(F.concat(F.lit("gap-"), "p_partkey").alias("gap_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "repeated_limitation").otherwise("underexplored_area").alias("gap_type"), signals.alias("signals"), (F.col("p_size") / 50).alias("confidence"))
    return c.withColumn("gap_priority_score", H.priority(F.col("signals")))


_CAND = f"v AS (SELECT p_partkey, p_name, p_size, {_VALS} FROM part), cand AS (SELECT 'gap-' || p_partkey AS gap_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'repeated_limitation' ELSE 'underexplored_area' END AS gap_type, p_size / 50 AS confidence, {_PRIO} AS priority, * FROM v)"


@query("h14_priority", f"WITH {_CAND} SELECT gap_id, priority FROM cand")
def h14(spark, sf):
    return candidates(spark, sf).select("gap_id", F.col("gap_priority_score").alias("priority"))


@query("h13_evidence_rule", f"WITH {_SUPP} SELECT k FROM c WHERE papers > 0 AND n > 0 AND k % 3 <> 0")
def h13(spark, sf):
    c = _supp(spark, sf).withColumns({"n_papers": F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("papers")), "n_evidence": F.col("n")})
    kept = H._candidate(c, F.col("k").cast("string"), F.lit("t"), F.lit("x"), H.signals_map(conflicting_evidence=F.lit(0.5)), F.lit(0.9))
    return kept.select(F.col("gap_id").cast("long").alias("k"))


@query("h15_breakdown", f"WITH {_CAND} SELECT gap_id, s AS signal, round(v, 6) AS value, round(v * w, 4) AS contribution FROM (SELECT gap_id, unnest([{', '.join(chr(39) + k + chr(39) for k, _ in _SIG)}]) AS s, unnest([{', '.join(f'v{i}' for i in range(len(_SIG)))}]) AS v, unnest([{', '.join(f'{w}::DOUBLE' for _, w in _SIG)}]) AS w FROM cand)")
def h15(spark, sf):
    return H.breakdown(candidates(spark, sf)).select("gap_id", "signal", F.round("value", 6).alias("value"), "contribution")


_PARTS = f"parts AS (SELECT gap_id, s, v, round(v * w, 4) AS c FROM (SELECT gap_id, unnest([{', '.join(chr(39) + k + chr(39) for k, _ in _SIG)}]) AS s, unnest([{', '.join(f'v{i}' for i in range(len(_SIG)))}]) AS v, unnest([{', '.join(f'{w}::DOUBLE' for _, w in _SIG)}]) AS w FROM cand) WHERE v > 0)"


@query("h15_narrative", f"WITH {_CAND}, {_PARTS} SELECT gap_id, string_agg(s || ' (' || format('{{:.2f}}', round(v, 2)) || ')', '; ' ORDER BY c DESC, s) AS narrative FROM parts GROUP BY 1")
def h15n(spark, sf):
    return H.narrative(H.breakdown(candidates(spark, sf)))


@query("h16_generate_candidates", f"WITH {_CAND} SELECT gap_id, priority FROM cand WHERE priority >= 0.3 AND confidence >= 0.5")
def h16(spark, sf):
    c = candidates(spark, sf)
    return H.generate_candidates([c, c.withColumn("title", F.lit("again"))], 0.3).select("gap_id", F.col("gap_priority_score").alias("priority"))


@query("h17_list_candidates", f"WITH {_CAND} SELECT gap_id, priority FROM cand WHERE gap_type = 'repeated_limitation' AND confidence >= 0.5 AND priority >= 0.2 ORDER BY priority DESC, gap_id LIMIT 50")
def h17(spark, sf):
    return H.list_candidates(candidates(spark, sf), "repeated_limitation", 0.2).select("gap_id", F.col("gap_priority_score").alias("priority"))


@query("h17_find_candidate", f"WITH {_CAND} SELECT gap_id FROM cand WHERE gap_id LIKE '%77'")
def h17f(spark, sf):
    return H.find_candidate(candidates(spark, sf), "77").select("gap_id")


@query("h18_dashboard", f"WITH {_CAND} SELECT 'papers' AS name, count(*) AS n FROM orders UNION ALL SELECT 'topics', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'emerging', count(DISTINCT label) FROM embeddings WHERE label < 3 UNION ALL SELECT 'gaps', count(*) FROM cand UNION ALL SELECT 'conflicts', count(*) FROM cand WHERE v{[k for k, _ in _SIG].index('conflicting_evidence')} > 0")
def h18(spark, sf):
    t = V.table(spark, sf, "embeddings").select(F.when(F.col("label") < 3, "EMERGING").otherwise("PERSISTENT").alias("trajectory"), "label").distinct()
    return H.dashboard(V.table(spark, sf, "orders"), t, candidates(spark, sf))


_GOLD = "gold AS (SELECT * FROM (VALUES ('g1', ['part', '1'], 'repeated_limitation'), ('g2', ['7', '5'], 'underexplored_area')) t(gt_id, keywords, gold_type))"
_MATCH = f"WITH {_CAND}, {_GOLD}, r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, gap_id) AS rank FROM cand), h AS (SELECT r.gap_id, gt_id, len(list_filter(keywords, lambda k: contains(lower(title), k))) AS n, gap_type = gold_type AS same FROM r, gold), f AS (SELECT gap_id, min(gt_id) AS gt_id FROM h WHERE n >= 2 OR (same AND n >= 1) GROUP BY 1), m AS (SELECT r.gap_id, rank, gt_id FROM r LEFT JOIN f USING (gap_id))"


def matched(spark, sf):
    gold = spark.createDataFrame([("g1", ["part", "1"], "repeated_limitation"), ("g2", ["7", "5"], "underexplored_area")], "gt_id string, keywords array<string>, gap_type string")
    ranked = H.rank_by(candidates(spark, sf), lexicon.SIGNAL_WEIGHTS, "all").withColumn("score", F.col("gap_priority_score"))
    from pyspark.sql import Window

    r = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("approach").orderBy(F.desc("gap_priority_score"), "gap_id")))
    return H.match_gold(r, gold), gold


@query("h19_match_gold", f"{_MATCH} SELECT gap_id, rank, gt_id FROM m")
def h19(spark, sf):
    return matched(spark, sf)[0].select("gap_id", F.col("rank").cast("long").alias("rank"), "gt_id")


@query("h20_gap_benchmark", f"{_MATCH} SELECT sum((rank <= 5 AND gt_id IS NOT NULL)::INT) / 5 AS precision_at_5, count(DISTINCT CASE WHEN rank <= 10 THEN gt_id END) / 2 AS recall_at_10, coalesce(1.0 / min(CASE WHEN gt_id IS NOT NULL THEN rank END), 0)::DOUBLE AS mrr, sum((gt_id IS NULL)::INT)::BIGINT AS false_positives, 2 - count(DISTINCT gt_id) AS false_negatives FROM m")
def h20(spark, sf):
    return H.gap_benchmark(*matched(spark, sf))


@query("h21_rank_by", f"WITH {_CAND} SELECT gap_id, row_number() OVER (ORDER BY round(v0, 8) DESC, gap_id) AS rank FROM cand")
def h21(spark, sf):
    return H.rank_by(candidates(spark, sf), {"repeated_limitation": 1.0}, "frequency").select("gap_id", F.col("rank").cast("long").alias("rank"))


@query("h22_signal_overview", f"WITH {_CAND}, l AS (SELECT unnest([{', '.join(chr(39) + k + chr(39) for k, _ in _SIG)}]) AS s, unnest([{', '.join(f'v{i}' for i in range(len(_SIG)))}]) AS v FROM cand) SELECT s AS signal, count(*) AS active, round(avg(v), 6) AS mean_value FROM l WHERE v > 0 GROUP BY 1")
def h22(spark, sf):
    return H.signal_overview(H.breakdown(candidates(spark, sf))).select("signal", "active", F.round("mean_value", 6).alias("mean_value"))


# --- I: timelines and lifecycle

_CUES = {"open": V.word("the"), "partly_open": V.word("of"), "reopened": V.word("is"), "solved": V.word("de"), "partly_solved": V.word("la")}
_H = {k: V.hit("source_text", p) for k, p in _CUES.items()}
_EVENT = f"CASE WHEN {_H['open']} THEN CASE WHEN {_H['partly_open']} THEN 'partial_solution' WHEN {_H['reopened']} THEN 'reopened_limitation' ELSE 'limitation_persists' END WHEN {_H['solved']} THEN CASE WHEN {_H['partly_solved']} THEN 'partial_solution' ELSE 'attempted_solution' END ELSE 'limitation_identified' END"


@query("i1_classify_events", f"WITH {V.SENTENCES} SELECT id, {_EVENT} AS event_type FROM sentences")
def i1(spark, sf):
    return I.classify_events(V.sentences(spark, sf), _CUES).select("id", "event_type")


_DEDUPED = V.TIMELINE + ", ded AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY gap_id, paper_id, source_text ORDER BY seq) AS r FROM timeline) WHERE r = 1)"


@query("i2_dedupe_events", f"WITH {_DEDUPED} SELECT gap_id, paper_id, source_text, seq FROM ded")
def i2(spark, sf):
    return I.dedupe_events(V.timeline(spark, sf)).select("gap_id", "paper_id", "source_text", "seq")


@query("i3_graph_events", f"WITH {V.GRAPH_EDGES}, g AS (SELECT 'g' || n_nationkey AS gap_id, 'study of brand#1' || (n_nationkey % 5 + 1) || ' units' AS title FROM nation), w AS (SELECT gap_id, unnest(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 4)) AS w FROM g), l AS (SELECT DISTINCT target AS id, split_part(target, ':', 2) AS label FROM edges WHERE target LIKE 'method:%') SELECT gap_id, paper_id, CASE relationship WHEN 'extends' THEN 'attempted_solution' ELSE 'repeated_limitation' END AS event_type, seq FROM (SELECT DISTINCT gap_id, id FROM w JOIN l ON contains(label, w)) JOIN edges ON target = id")
def i3(spark, sf):
    g = V.table(spark, sf, "nation").select(F.concat(F.lit("g"), "n_nationkey").alias("gap_id"), F.concat(F.lit("study of brand#1"), F.col("n_nationkey") % 5 + 1, F.lit(" units")).alias("title"))
    n = V.graph_nodes(spark, sf).where("type = 'method'").withColumn("type", F.lit("Limitation"))
    e = V.graph_edges(spark, sf).where("target like 'method:%'").withColumn("relationship", F.when(F.col("relationship") == "extends", "addresses").otherwise("limited_by"))
    return I.graph_events(g, n, e).select("gap_id", "paper_id", "event_type", "seq")


@query("i4_resolve_years", f"WITH {V.TIMELINE} SELECT seq, coalesce(year, 1990 + paper_id)::INT AS year FROM timeline")
def i4(spark, sf):
    papers = spark.range(7).select("id", (1990 + F.col("id")).cast("int").alias("publication_year"))
    return I.resolve_years(V.timeline(spark, sf), papers).select("seq", "year")


_IMPUTED = V.TIMELINE + ", med AS (SELECT gap_id, list_sort(list(year) FILTER (year IS NOT NULL)) AS l FROM timeline GROUP BY 1), imp AS (SELECT t.* EXCLUDE (year), coalesce(year, l[len(l) // 2 + 1], 2024)::INT AS year, year IS NULL AS year_estimated FROM timeline t LEFT JOIN med USING (gap_id))"


def imputed(spark, sf):
    return I.impute_years(V.timeline(spark, sf))


@query("i5_impute_years", f"WITH {_IMPUTED} SELECT seq, year, year_estimated FROM imp")
def i5(spark, sf):
    return imputed(spark, sf).select("seq", "year", "year_estimated")


_TYPE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.TYPE_ORDER.items()) + " ELSE 5 END"
_ORDERED = _IMPUTED + f", ord AS (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY year, {_TYPE}, seq) AS position FROM imp)"


@query("i6_order_events", f"WITH {_ORDERED} SELECT seq, position FROM ord")
def i6(spark, sf):
    return I.order_events(imputed(spark, sf)).select("seq", F.col("position").cast("long").alias("position"))


@query("i7_flag_retrospective", f"WITH {_IMPUTED} SELECT seq, coalesce(event_type = 'attempted_solution' AND year < min(CASE WHEN event_type IN ('limitation_identified', 'repeated_limitation') THEN year END) OVER (PARTITION BY gap_id), false) AS is_retrospective FROM imp")
def i7(spark, sf):
    return I.flag_retrospective(imputed(spark, sf)).select("seq", "is_retrospective")


def anchored(spark, sf):
    t = imputed(spark, sf)
    return I.append_anchor(t, t.select("gap_id").distinct())


@query("i8_append_anchor", f"WITH {V.TIMELINE} SELECT gap_id, coalesce(max(year), 2026)::INT AS year FROM timeline GROUP BY 1")
def i8(spark, sf):
    return anchored(spark, sf).where("event_type = 'current_candidate_gap'").select("gap_id", "year")


@query("i9_timeline_summary", f"WITH {_IMPUTED} SELECT gap_id, min(year) AS first_year, max(year) AS latest_year, sum((event_type IN ('limitation_identified', 'repeated_limitation', 'limitation_persists'))::INT)::BIGINT AS repeated_limitations, sum((event_type IN ('attempted_solution', 'partial_solution'))::INT)::BIGINT AS attempted_solutions, count(DISTINCT CASE WHEN event_type = 'attempted_solution' THEN paper_id END) AS addressing_papers, count(*) + 1 AS total_events FROM imp GROUP BY 1")
def i9(spark, sf):
    return I.timeline_summary(anchored(spark, sf))


_LIFE = _IMPUTED + """, la AS (SELECT gap_id, count(DISTINCT paper_id) AS p, count(*) AS n, min(year) AS f, max(year) AS l, max(CASE WHEN event_type IN ('attempted_solution', 'partial_solution') THEN year END) AS sol,
    sum((event_type = 'partial_solution')::INT) AS np, sum((event_type = 'reopened_limitation')::INT) AS nr, avg(CASE WHEN event_type = 'attempted_solution' THEN confidence END) AS sure FROM imp GROUP BY 1),
    sp AS (SELECT DISTINCT gap_id, paper_id FROM imp WHERE event_type IN ('attempted_solution', 'partial_solution')),
    lb AS (SELECT i.gap_id, sum((i.year > sol)::INT) AS later, sum((i.year = sol AND sp.gap_id IS NULL)::INT) AS beside FROM imp i JOIN la USING (gap_id) LEFT JOIN sp ON sp.gap_id = i.gap_id AND sp.paper_id = i.paper_id WHERE event_type IN ('limitation_identified', 'repeated_limitation', 'limitation_persists') GROUP BY 1),
    life AS (SELECT gap_id, CASE WHEN p < 2 OR n < 2 THEN 'UNCERTAIN' WHEN sol IS NOT NULL THEN CASE WHEN nr > 0 OR later > 0 THEN 'REOPENED' WHEN np > 0 OR beside > 0 THEN 'PARTIALLY_ADDRESSED' WHEN coalesce(sure, 0.85) >= 0.80 THEN 'ADDRESSED' ELSE 'PARTIALLY_ADDRESSED' END
        WHEN l - f >= 2 THEN 'PERSISTENT' WHEN f >= l - 2 THEN 'EMERGING' ELSE 'UNCERTAIN' END AS status, p AS n_papers, (l - f)::BIGINT AS year_span FROM la LEFT JOIN lb USING (gap_id))"""


@query("i10_lifecycle", f"WITH {_LIFE} SELECT gap_id, status, n_papers, year_span FROM life")
def i10(spark, sf):
    return I.lifecycle(anchored(spark, sf)).select("gap_id", "status", "n_papers", "year_span")


@query("i11_lifecycle_overview", f"WITH {_LIFE} SELECT s AS status, count(gap_id) AS n FROM (SELECT unnest({I.STATES}) AS s) LEFT JOIN life ON status = s GROUP BY 1")
def i11(spark, sf):
    return I.lifecycle_overview(I.lifecycle(anchored(spark, sf)))


def chains(spark, sf):
    t = I.order_events(imputed(spark, sf))
    gaps = t.select("gap_id").distinct().withColumns({"title": F.concat(F.lit("Empirical Bottleneck: "), F.when(F.col("gap_id") % 4 == 0, "Memory").when(F.col("gap_id") % 4 == 1, "Domain").when(F.col("gap_id") % 4 == 2, "Scarcity").otherwise("Thing")), "description": F.lit("d")})
    return I.genealogy(gaps, t, I.timeline_summary(t))


@query("i12_genealogy", f"WITH {_ORDERED}, s AS (SELECT gap_id, k AS step, min(year) OVER () AS x FROM (SELECT gap_id, min(year) AS year FROM imp GROUP BY 1), range(1, 7) t(k)), fy AS (SELECT gap_id, min(year) AS f FROM imp GROUP BY 1) SELECT s.gap_id, step, coalesce(o.year, f + step - 1)::BIGINT AS year, o.paper_id AS source_paper FROM s JOIN fy USING (gap_id) LEFT JOIN ord o ON o.gap_id = s.gap_id AND position = step")
def i12(spark, sf):
    return chains(spark, sf).select("gap_id", F.col("step").cast("long").alias("step"), "year", "source_paper")


@query("i13_genealogy_summary", f"WITH {_IMPUTED} SELECT DISTINCT gap_id, CASE gap_id % 4 WHEN 0 THEN '{' -> '.join(s[0] for s in lexicon.GENEALOGY['memory']).replace('{title}', 'Memory')}' WHEN 1 THEN '{' -> '.join(s[0] for s in lexicon.GENEALOGY['domain']).replace('{title}', 'Domain')}' WHEN 2 THEN '{' -> '.join(s[0] for s in lexicon.GENEALOGY['data']).replace('{title}', 'Scarcity')}' ELSE '{' -> '.join(s[0] for s in lexicon.GENEALOGY['other']).replace('{title}', 'Thing')}' END AS summary FROM imp")
def i13(spark, sf):
    return I.genealogy_summary(chains(spark, sf))


@query("i14_static_status", f"WITH {V.TIMELINE} SELECT gap_id, CASE WHEN count(DISTINCT paper_id) >= 2 THEN 'PERSISTENT' ELSE 'UNCERTAIN' END AS status FROM timeline GROUP BY 1")
def i14(spark, sf):
    return I.static_status(V.timeline(spark, sf))


# --- J: verification

_NLI = ([V.word("thon"), V.word("ses")], [V.word("the"), V.word("der")], [V.word("of")])
_ANY = lambda ps: " OR ".join(V.hit("source_text", p) for p in ps)
_LABEL = f"CASE WHEN {_ANY(_NLI[0])} THEN 'CONTRADICTION' WHEN {_ANY(_NLI[1])} THEN 'ENTAILMENT' WHEN {_ANY(_NLI[2])} THEN 'CONTRADICTION' ELSE 'NEUTRAL' END"


@query("j1_nli", f"WITH {V.SENTENCES} SELECT id, {_LABEL} AS label FROM sentences")
def j1(spark, sf):
    return V.sentences(spark, sf).select("id", J.nli(F.col("source_text"), _NLI)["label"].alias("label"))


@query("j2_categorize", f"WITH {V.SENTENCES} SELECT id, CASE WHEN contains(lower(source_text), 'thin') OR contains(lower(source_text), 'sche') THEN 'COUNTER' WHEN contains(lower(source_text), 'tion') THEN 'ADDRESSED_BY' ELSE 'SUPPORTING' END AS category FROM sentences")
def j2(spark, sf):
    return V.sentences(spark, sf).select("id", J.category(F.col("source_text"), ["thin", "sche"], ["tion"]).alias("category"))


@query("j3_dedupe_evidence", f"WITH {_DEDUPED} SELECT gap_id, paper_id, source_text, seq FROM ded")
def j3(spark, sf):
    return J.dedupe_evidence(V.timeline(spark, sf)).select("gap_id", "paper_id", "source_text", "seq")


_J4 = "CASE WHEN relationship = 'extends' THEN 'ADDRESSED_BY' WHEN paper_id % 3 = 0 THEN 'CONTRADICTORY' ELSE '' END"


@query("j4_mine_edges", f"WITH {V.GRAPH_EDGES}, e AS (SELECT paper_id, 'uses ' || target AS source_text, min(seq) AS seq, arg_min({_J4}, seq) AS category FROM edges GROUP BY 1, 2), g AS (SELECT 'g' || n_nationkey AS gap_id, 'brand#1' || (n_nationkey % 5 + 1) AS w FROM nation) SELECT gap_id, paper_id, source_text, seq, category FROM g JOIN e ON contains(source_text, w) WHERE paper_id % 2 = 0 AND category <> ''")
def j4(spark, sf):
    g = V.table(spark, sf, "nation").select(F.concat(F.lit("g"), "n_nationkey").alias("gap_id"), F.concat(F.lit("A brand#1"), F.col("n_nationkey") % 5 + 1).alias("title"))
    kind = F.when(F.col("relationship") == "extends", "addresses").when(F.col("paper_id") % 3 == 0, "contradicts").otherwise("uses")
    e = V.graph_edges(spark, sf).withColumn("source_text", F.concat(F.lit("uses "), "target")).withColumn("relationship", kind)
    brands = g.select("gap_id", F.concat(F.lit("uses method:"), F.substring_index("title", " ", -1)).alias("source_text"))
    seen = e.where("paper_id % 2 = 1").select("paper_id", "source_text").distinct().join(brands, "source_text")
    return J.mine_edges(g, e, seen).select("gap_id", "paper_id", "source_text", "seq", "category")


_CAT = {"signup": "SUPPORTING", "error": "SUPPORTING", "click": "SUPPORTING", "view": "CONTRADICTORY", "purchase": "ADDRESSED_BY"}
_EV = "ev AS (SELECT user_id AS gap_id, event_id % 7 AS paper_id, CASE WHEN event_id % 11 <> 0 THEN (2000 + day(ts))::INT END AS year, CASE WHEN event_id % 23 = 0 THEN 'COUNTER' ELSE CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CAT.items()) + " END END AS category, least(1.0, value / 20) AS confidence, event_id AS seq, 'text ' || event_id AS source_text FROM events)"


def evidence(spark, sf):
    e = V.table(spark, sf, "events")
    kinds = F.create_map(*[x for k, v in _CAT.items() for x in (F.lit(k), F.lit(v))])
    return V.timeline(spark, sf).drop("event_type", "source_text").join(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 23 == 0, "COUNTER").otherwise(F.element_at(kinds, F.col("event_type"))).alias("category"), F.concat(F.lit("text "), "event_id").alias("source_text")), "seq")


@query("j5_evidence_dates", f"WITH {_EV} SELECT gap_id, min(year) AS earliest_year, max(year) AS latest_year, array_to_string(list_sort(list_distinct(list(year) FILTER (category = 'SUPPORTING' AND year IS NOT NULL))), ',') AS supporting FROM ev GROUP BY 1")
def j5(spark, sf):
    d = J.evidence_dates(evidence(spark, sf))
    return d.select("gap_id", "earliest_year", "latest_year", F.when(F.size("supporting_years") > 0, F.array_join("supporting_years", ",")).alias("supporting"))


@query("j6_nli_distribution", f"WITH {V.SENTENCES} SELECT paper_id AS gap_id, sum(({_LABEL} = 'ENTAILMENT')::INT)::BIGINT AS ENTAILMENT, sum(({_LABEL} = 'CONTRADICTION')::INT)::BIGINT AS CONTRADICTION, sum(({_LABEL} = 'NEUTRAL')::INT)::BIGINT AS NEUTRAL FROM sentences GROUP BY 1")
def j6(spark, sf):
    return J.nli_distribution(V.sentences(spark, sf).withColumnRenamed("paper_id", "gap_id"), cues=_NLI)


_VER = _EV + """, va AS (SELECT gap_id, count(DISTINCT CASE WHEN category = 'SUPPORTING' THEN paper_id END) AS p, sum((category = 'SUPPORTING')::INT) AS s, sum((category = 'COUNTER')::INT) AS c, sum((category = 'CONTRADICTORY')::INT) AS k, sum((category = 'ADDRESSED_BY')::INT) AS a,
    coalesce(avg(confidence) FILTER (category = 'SUPPORTING'), 0) AS ms, coalesce(avg(confidence) FILTER (category = 'COUNTER'), 0) AS mc, coalesce(avg(confidence) FILTER (category = 'ADDRESSED_BY'), 0) AS ma, coalesce(max(year) FILTER (category = 'SUPPORTING'), 0) AS ys, coalesce(max(year) FILTER (category = 'ADDRESSED_BY'), 0) AS ya FROM ev GROUP BY 1),
    ver AS (SELECT *, CASE WHEN p < 2 OR s < 2 THEN 'UNCERTAIN' WHEN (c >= 1 AND mc >= 0.85) OR c >= 2 THEN 'REFUTED' WHEN k >= 1 AND k >= s / 2 THEN 'UNCERTAIN' WHEN a >= 1 AND ya >= ys THEN CASE WHEN ma >= 0.85 THEN 'ADDRESSED' ELSE 'PARTIALLY_ADDRESSED' END WHEN 2032 - ys >= 3 THEN 'OUTDATED' ELSE 'VERIFIED_OPEN' END AS status FROM va)"""


@query("j7_verify", f"WITH {_VER} SELECT gap_id, status, s::BIGINT AS supporting FROM ver")
def j7(spark, sf):
    return J.verify(evidence(spark, sf), 2032).select("gap_id", "status", "supporting")


@query("j8_confidence", f"WITH {_VER} SELECT gap_id, round(least(greatest(s * ms / (s * ms + 1.5 * c + 1.0 * k + 0.8 * a + 0.5), 0.5), 0.98), 4) AS confidence FROM ver WHERE status = 'VERIFIED_OPEN'")
def j8(spark, sf):
    return J.verify(evidence(spark, sf), 2032).where("status = 'VERIFIED_OPEN'").select("gap_id", "confidence")


@query("j9_counter_evidence", f"WITH {_EV} SELECT gap_id, count(*) AS total, arg_max(source_text, CASE category WHEN 'COUNTER' THEN 3 WHEN 'CONTRADICTORY' THEN 2 ELSE 1 END * 1000.0 + confidence * 100 - seq / 1e9) AS strongest FROM ev WHERE category <> 'SUPPORTING' GROUP BY 1")
def j9(spark, sf):
    return J.counter_evidence(evidence(spark, sf))


@query("j10_acceptance", "WITH d AS (SELECT quality = 1 AS g, n_chars > 1000 AS n, n_chars > 3000 AS v FROM labels JOIN documents USING (doc_id)) SELECT 'naive' AS approach, sum((n AND g)::INT)::BIGINT AS tp, sum((n AND NOT g)::INT)::BIGINT AS fp, sum((n AND g)::INT) / sum(n::INT) AS precision, sum((n AND NOT g)::INT) / sum((NOT g)::INT) AS fpr FROM d UNION ALL SELECT 'verified', sum((v AND g)::INT)::BIGINT, sum((v AND NOT g)::INT)::BIGINT, sum((v AND g)::INT) / sum(v::INT), sum((v AND NOT g)::INT) / sum((NOT g)::INT) FROM d")
def j10(spark, sf):
    d = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return J.acceptance(d.select((F.col("quality") == 1).alias("gold_open"), (F.col("n_chars") > 1000).alias("accepted_naive"), (F.col("n_chars") > 3000).alias("accepted_verified"))).drop("tn")


# --- K: contexts and citations


def _sources(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("gap_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("source_rank"), F.col("turn").alias("seq"), "text")


_CTX = "src AS (SELECT conv_id AS gap_id, (role <> 'user')::INT AS source_rank, turn AS seq, text FROM conversations), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id, text ORDER BY source_rank, seq) AS r FROM src WHERE length(trim(text)) > 0) WHERE r = 1), ctx AS (SELECT gap_id, text, row_number() OVER (PARTITION BY gap_id ORDER BY source_rank, seq, text) AS n FROM one)"


@query("k1_evidence_context", f"WITH {_CTX} SELECT gap_id, text, 'E' || n AS citation_id FROM ctx")
def k1(spark, sf):
    return K.evidence_context(_sources(spark, sf)).select("gap_id", "text", "citation_id")


_LINES = "string_agg('[E' || n || '] ' || text, chr(10) ORDER BY n)"


@query("k2_context_text", f"WITH {_CTX} SELECT gap_id, {_LINES} AS context FROM ctx GROUP BY 1")
def k2(spark, sf):
    return K.context_text(K.evidence_context(_sources(spark, sf)))


@query("k3_prompts", f"WITH {_CTX} SELECT gap_id, 'Gap: t' || gap_id || chr(10) || 'Lifecycle: ' || ['EMERGING', 'PERSISTENT', 'ADDRESSED', 'unknown'][1 + gap_id % 4] || chr(10) || 'Genealogy: ' || CASE gap_id % 3 WHEN 0 THEN 'observed -> repeated' ELSE 'Direct bottleneck' END || chr(10) || 'Verification: ' || CASE WHEN gap_id % 5 < 2 THEN 'VERIFIED_OPEN' WHEN gap_id % 5 = 2 THEN 'DISPUTED' ELSE 'unknown' END || chr(10) || 'Cite evidence by tag and state nothing without a tag.' || chr(10) || 'Evidence: ' || {_LINES} AS prompt FROM ctx GROUP BY 1")
def k3(spark, sf):
    ctx = K.evidence_context(_sources(spark, sf))
    gaps = ctx.select("gap_id").distinct().withColumn("title", F.concat(F.lit("t"), "gap_id"))
    # of three gaps one has steps, one an empty list of them, one none
    chain = gaps.where("gap_id % 3 = 0").select("gap_id", F.explode(F.array(F.struct(F.lit(2).alias("step"), F.lit("repeated").alias("stage")), F.struct(F.lit(1).alias("step"), F.lit("observed").alias("stage")))).alias("s")).select("gap_id", "s.*")
    steps = I.genealogy_summary(chain).unionByName(gaps.where("gap_id % 3 = 1").select("gap_id", F.lit("").alias("summary")))
    # of four gaps one has no lifecycle state, of five two have no verification
    states = gaps.where("gap_id % 4 < 3").select("gap_id", F.element_at(F.array(*map(F.lit, ("EMERGING", "PERSISTENT", "ADDRESSED"))), (F.col("gap_id") % 4 + 1).cast("int")).alias("status"))
    verified = gaps.where("gap_id % 5 < 3").select("gap_id", F.when(F.col("gap_id") % 5 < 2, "VERIFIED_OPEN").otherwise("DISPUTED").alias("status"))
    return K.prompts(gaps, ctx, states, verified, steps)


@query("k4_parse_responses", "SELECT item_id, split_part(text, ' ', 1) AS executive_summary, 0.5::DOUBLE AS confidence FROM benchmark WHERE item_id % 3 <> 0")
def k4(spark, sf):
    b = V.table(spark, sf, "benchmark").withColumn("w", F.split_part("text", F.lit(" "), F.lit(1)))
    j = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("w").alias("executive_summary"), F.lit(0.5).alias("confidence"))), F.lit("\n```"))
    good, _ = K.parse_responses(b.select("item_id", F.when(F.col("item_id") % 3 == 0, F.lit("no object here")).otherwise(j).alias("response")))
    return good.select("item_id", "executive_summary", "confidence")


_CLAIM = "replace(replace(text, ' of ', ' [E1] '), ' the ', ' [e2] ')"


def _claims(spark, sf):
    c = V.table(spark, sf, "conversations")
    t = F.replace(F.replace("text", F.lit(" of "), F.lit(" [E1] ")), F.lit(" the "), F.lit(" [e2] "))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), t.alias("text"))


@query("k5_citation_tags", f"SELECT conv_id * 1000 + turn AS doc_id, upper(array_to_string(regexp_extract_all({_CLAIM}, '\\[([eE][0-9]+)\\]', 1), ',')) AS tags FROM conversations")
def k5(spark, sf):
    return _claims(spark, sf).select("doc_id", F.array_join(K.citation_tags(F.col("text")), ",").alias("tags"))


_SPLIT = f"cl AS (SELECT conv_id * 1000 + turn AS doc_id, unnest(string_split({_CLAIM}, chr(10))) AS line FROM conversations), parts AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(regexp_replace(trim(line), '^[*\\-0-9.\\s]+', ''), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))) AS c FROM cl), claims AS (SELECT doc_id, c AS claim_text FROM parts WHERE length(c) > 10)"


@query("k6_split_claims", f"WITH {_SPLIT} SELECT doc_id, claim_text FROM claims")
def k6(spark, sf):
    return K.split_claims(_claims(spark, sf)).select("doc_id", "claim_text")


_STOPS = ", ".join(f"'{w}'" for w in lexicon.OVERLAP_STOP_WORDS)
_SET = lambda c: f"list_distinct(list_filter({V.words_sql(c, '[a-z]{3,}')}, lambda x: x NOT IN ({_STOPS})))"


@query("k7_token_overlap", f"WITH p AS (SELECT a.item_id AS a, b.item_id AS b, {_SET('a.text')} AS x, {_SET('b.text')} AS y FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id) SELECT a, b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(greatest(len(list_intersect(x, y)) / len(list_distinct(x || y)), len(list_intersect(x, y)) / least(len(x), len(y))), 8) END AS overlap FROM p")
def k7(spark, sf):
    b = V.table(spark, sf, "benchmark")
    pairs = b.alias("a").join(b.alias("b"), F.col("a.item_id") < F.col("b.item_id"))  # the test items only
    return pairs.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(token_overlap(F.col("a.text"), F.col("b.text")), 8).alias("overlap"))


def verdicts(spark, sf):
    claims = K.split_claims(_claims(spark, sf))
    src = claims.select("doc_id").distinct().select("doc_id", F.lit("E1").alias("citation_id"), F.lit("Plain words and thinking about onething").alias("sentence_text"))
    return K.validate_claims(claims, src, cues=([V.word("ses")], [V.word("and")], [V.word("zzz")]))


_BARE = "trim(regexp_replace(trim(regexp_replace(claim_text, '\\[[eE][0-9]+\\]', '', 'g')), '^[a-zA-Z_]+:\\s*', ''))"
_VERDICT = f"{_SPLIT}, vb AS (SELECT doc_id, claim_text, contains(claim_text, '[E1]') AS e1, contains(claim_text, '[e2]') AS e2, {_BARE} AS bare FROM claims), vs AS (SELECT *, {V.hit('bare', V.word('ses'))} AS against, {V.hit('bare', V.word('and'))} AS pro, {_SET('bare')} AS x, ['plain', 'words', 'thinking', 'about', 'onething'] AS y FROM vb), vo AS (SELECT *, CASE WHEN len(x) = 0 THEN 0.0 ELSE greatest(len(list_intersect(x, y)) / len(list_distinct(x || y)), len(list_intersect(x, y)) / least(len(x), 5)) END AS o FROM vs), verdict AS (SELECT doc_id, claim_text, CASE WHEN NOT e1 AND NOT e2 THEN 'INSUFFICIENT_EVIDENCE' WHEN e2 THEN 'HALLUCINATED_CITATION' WHEN against THEN 'CONTRADICTED' WHEN pro OR CASE WHEN o >= 0.25 THEN least(0.8, 0.4 + o) ELSE o END >= 0.5 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM vo)"


@query("k8_validate_claims", f"WITH {_VERDICT} SELECT doc_id, claim_text, status FROM verdict")
def k8(spark, sf):
    return verdicts(spark, sf).select("doc_id", "claim_text", "status")


@query("k9_validation_report", f"WITH {_VERDICT} SELECT doc_id, count(*) AS claims, sum((status = 'SUPPORTED')::INT)::BIGINT AS supported, sum((status = 'HALLUCINATED_CITATION')::INT)::BIGINT AS hallucinated, round(sum((status = 'SUPPORTED')::INT) / count(*), 6) AS support_rate, sum((status IN ('HALLUCINATED_CITATION', 'CONTRADICTED'))::INT) = 0 AND sum((status = 'SUPPORTED')::INT) / count(*) >= 0.6 AS is_valid FROM verdict GROUP BY 1")
def k9(spark, sf):
    return K.validation_report(verdicts(spark, sf)).select("doc_id", "claims", "supported", "hallucinated", "support_rate", "is_valid")
