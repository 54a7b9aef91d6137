"""The test tables seen as papers, sentences, graphs and timelines; each view in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.rules import Cue
from lacuna.sources.tables import spread

SECTION_NAMES = ["Introduction", "Methods", "Results", "Limitations", "Future Work"]
#: Words that occur in the invented prose stand in for the production cues.
WORD = "(^|[^A-Za-z]){}([^A-Za-z]|$)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The documents for work that takes long per row, so on all cores."""
    return spread(table(spark, sf, "documents").select(*columns))


def papers(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    year = F.when(F.col("doc_id") % 17 != 0, (2018 + F.col("doc_id") % 8).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("venue"), year.alias("publication_year"), "text")


PAPERS = """papers AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS venue,
    CASE WHEN doc_id % 17 <> 0 THEN (2018 + doc_id % 8)::INT END AS publication_year, text FROM documents)"""


def paragraphs(spark, sf) -> DataFrame:
    rows = texts(spark, sf, "doc_id", "text").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("paragraph_id", "paragraph"))
    name = F.element_at(F.array(*map(F.lit, SECTION_NAMES)), F.col("paragraph_id") % 5 + 1)
    return rows.select("paper_id", "paragraph_id", "paragraph", name.alias("section_name"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in SECTION_NAMES) + "]"
PARAGRAPHS = f"""paragraphs AS (SELECT paper_id, paragraph_id, l[paragraph_id + 1] AS paragraph, {_NAMES}[paragraph_id % 5 + 1] AS section_name
    FROM (SELECT doc_id AS paper_id, l, unnest(range(len(l))) AS paragraph_id FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def sentences(spark, sf) -> DataFrame:
    """Paragraphs cut after a stop and a blank, numbered within the paragraph."""
    rows = paragraphs(spark, sf).select("paper_id", "paragraph_id", "section_name", F.posexplode(F.split(F.replace("paragraph", F.lit(". "), F.lit(".\u0001")), "\u0001")).alias("part", "source_text"))
    return rows.where("length(source_text) > 3").withColumn("id", F.col("paper_id") * 1000000000 + F.col("paragraph_id") * 100000 + F.col("part"))


SENTENCES = PARAGRAPHS + """, sentences AS (SELECT paper_id, paragraph_id, section_name, part, s AS source_text, paper_id * 1000000000 + paragraph_id * 100000 + part AS id
    FROM (SELECT paper_id, paragraph_id, section_name, l[part + 1] AS s, part FROM (SELECT *, unnest(range(len(l))) AS part FROM (SELECT *, string_split(replace(paragraph, '. ', '.' || chr(1)), chr(1)) AS l FROM paragraphs)))
    WHERE length(s) > 3)"""


#: A dictionary entry that no sentence holds, as sentences are cut at this sign; any word may occur in a larger corpus.
ABSENT = "\u0001"


def word(w: str) -> Cue:
    return Cue(WORD.format(w), w)


RULES = {
    "PROBLEM": [(word("the"), 0.6), (word("of"), 0.5)],
    "OBJECTIVE": [(word("to"), 0.7)],
    "METHOD": [(word("and"), 0.55), (word("with"), 0.8)],
    "DATASET": [(word("der"), 0.9), (word("die"), 0.7)],
    "METRIC": [(word("que"), 1.1)],
    "RESULT": [(word("is"), 0.65), (word("are"), 0.75)],
    "LIMITATION": [(word("le"), 0.8), (word("les"), 0.85)],
    "FUTURE_WORK": [(word("for"), 1.2)],
    "OTHER": [],
}
PRIORS = {"limitations": {"LIMITATION": 2.0, "FUTURE_WORK": 0.5}, "future work": {"FUTURE_WORK": 2.2}, "results": {"RESULT": 1.5}}


def hit(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(?i){pattern}')"


#: SQL of the parts of a column between blanks, in lower case.
SPLIT = "regexp_extract_all(lower({}), '[^\\s\\p{{Z}}]+')"


def words_sql(column: str, pattern: str) -> str:
    """SQL of the words of a column in lower case that the pattern describes from end to end."""
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '{pattern}'))"


def bucket_sql(term: str, digest: str, dim: int = 384) -> str:
    return f"('0x' || substr({digest}({term}), 1, 8))::BIGINT % {dim}"


def score_sql(col: str = "source_text", rules=None, base: float = 0.1) -> dict[str, str]:
    rules = RULES if rules is None else rules
    return {k: " + ".join([f"{base}::DOUBLE", *(f"CASE WHEN {hit(col, p)} THEN {w}::DOUBLE ELSE 0 END" for p, w in v)]) for k, v in rules.items()}


def classified_sql() -> str:
    """SQL of sentences with their label and confidence under the test rules and priors."""
    scores = score_sql()
    prior = lambda k: "CASE " + " ".join(f"WHEN lower(trim(section_name)) = '{s}' THEN {w.get(k, 0.0)}::DOUBLE" for s, w in PRIORS.items()) + " ELSE 0 END"
    names = list(RULES)
    raw = ", ".join(f"{v} AS s_{k}" for k, v in scores.items())
    top = "greatest(" + ", ".join(f"s_{k}" for k in names) + ")"
    lifted = ", ".join(f"s_{k} + CASE WHEN {top} > 0.1 OR lower(trim(section_name)) IN ('limitations', 'future work') THEN {prior(k)} ELSE 0 END AS t_{k}" for k in names)
    best = "greatest(" + ", ".join(f"t_{k}" for k in names) + ")"
    label = "CASE WHEN " + best + " < 0.8 THEN 'OTHER' " + " ".join(f"WHEN t_{k} = {best} THEN '{k}'" for k in names) + " END"
    total = " + ".join(f"exp(least(t_{k}, 10.0))" for k in names)
    return f"""scored AS (SELECT *, {raw} FROM sentences), lifted AS (SELECT *, {lifted} FROM scored),
        classified AS (SELECT id, paper_id, section_name, source_text, {label} AS label,
        CASE WHEN {best} < 0.8 THEN 0.65 ELSE round(least(greatest(exp(least({best}, 10.0)) / ({total}), 0.55), 0.98), 6) END AS confidence FROM lifted)"""


# --- a graph of orders: papers are orders, methods are brands, datasets are part types, topics are segments


def graph_edges(spark, sf) -> DataFrame:
    """Edges of the order graph, with a seq: uses brand, uses type, belongs_to segment, authored by customer."""
    li, o, p, c = (table(spark, sf, t) for t in ("lineitem", "orders", "part", "customer"))
    lp = li.join(p, li.l_partkey == p.p_partkey)
    order = F.concat(F.lit("paper:"), F.col("l_orderkey"))
    sure = F.round(1 - F.col("l_discount"), 4)
    a = lp.select(order.alias("source"), F.concat(F.lit("method:"), F.lower("p_brand")).alias("target"), F.when(F.col("l_linenumber") % 3 == 0, "extends").otherwise("uses").alias("relationship"), sure.alias("confidence"), F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").cast("long").alias("seq"))
    b = lp.select(order.alias("source"), F.concat(F.lit("dataset:"), F.lower("p_type")).alias("target"), F.lit("uses").alias("relationship"), sure.alias("confidence"), F.col("l_orderkey").alias("paper_id"), (100 + F.col("l_linenumber")).cast("long").alias("seq"))
    d = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("paper:"), F.col("o_orderkey")).alias("source"), F.concat(F.lit("topic:"), F.lower("c_mktsegment")).alias("target"), F.lit("belongs_to").alias("relationship"), F.lit(0.8).alias("confidence"), F.col("o_orderkey").alias("paper_id"), F.lit(200).cast("long").alias("seq"))
    e = a.unionByName(b).unionByName(d)
    return e.withColumn("id", F.concat("source", F.lit("->"), "relationship", F.lit("->"), "target")).withColumn("source_text", F.lit(None).cast("string"))


GRAPH_EDGES = """lp AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey), edges AS (
    SELECT 'paper:' || l_orderkey AS source, 'method:' || lower(p_brand) AS target, CASE WHEN l_linenumber % 3 = 0 THEN 'extends' ELSE 'uses' END AS relationship, round(1 - l_discount, 4) AS confidence, l_orderkey AS paper_id, l_linenumber::BIGINT AS seq FROM lp
    UNION ALL SELECT 'paper:' || l_orderkey, 'dataset:' || lower(p_type), 'uses', round(1 - l_discount, 4), l_orderkey, 100 + l_linenumber FROM lp
    UNION ALL SELECT 'paper:' || o_orderkey, 'topic:' || lower(c_mktsegment), 'belongs_to', 0.8, o_orderkey, 200 FROM orders JOIN customer ON o_custkey = c_custkey)"""

#: The edge fold as the last run of the final relation.
MERGED_EDGES = GRAPH_EDGES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY seq, relationship) AS n,
    last_value(relationship) OVER (PARTITION BY source, target ORDER BY seq, relationship ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM edges),
    runs AS (SELECT *, coalesce(max(CASE WHEN relationship <> fin THEN n END) OVER (PARTITION BY source, target), 0) AS brk FROM ranked),
    merged AS (SELECT source, target, relationship, confidence, paper_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, n) AS r FROM runs WHERE relationship = fin AND n > brk) WHERE r = 1)"""


def graph_nodes(spark, sf) -> DataFrame:
    e = graph_edges(spark, sf)
    ids = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return ids.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("label"), F.split_part("id", F.lit(":"), F.lit(1)).alias("type"))


GRAPH_NODES = "nodes AS (SELECT id, split_part(id, ':', 2) AS label, split_part(id, ':', 1) AS type FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges))"

# --- timelines: gaps are users, years are days, types are event types

EVENT_KINDS = {"signup": "limitation_identified", "error": "repeated_limitation", "click": "limitation_persists", "view": "partial_solution", "purchase": "attempted_solution"}


def timeline(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kinds = F.create_map(*[x for k, v in EVENT_KINDS.items() for x in (F.lit(k), F.lit(v))])
    year = F.when(F.col("event_id") % 11 != 0, (2000 + F.dayofmonth("ts")).cast("int"))
    return e.select(
        F.col("user_id").alias("gap_id"), (F.col("event_id") % 7).alias("paper_id"), year.alias("year"), F.element_at(kinds, F.col("event_type")).alias("event_type"),
        F.least(F.lit(1.0), F.col("value") / 20).alias("confidence"), F.col("event_id").alias("seq"), F.concat(F.lit("text "), F.col("event_id") % 5).alias("source_text"),
    )


_KINDS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_KINDS.items()) + " END"
TIMELINE = f"""timeline AS (SELECT user_id AS gap_id, event_id % 7 AS paper_id, CASE WHEN event_id % 11 <> 0 THEN (2000 + day(ts))::INT END AS year, {_KINDS} AS event_type,
    least(1.0, value / 20) AS confidence, event_id AS seq, 'text ' || (event_id % 5) AS source_text FROM events)"""
