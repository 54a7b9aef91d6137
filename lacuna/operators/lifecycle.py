"""Timelines of gaps, their lifecycle states, and genealogies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.rules import matches
from lacuna.functions.text import strip
from lacuna.operators.substrings import containing

LIMITS = ["limitation_identified", "repeated_limitation", "limitation_persists"]
SOLUTIONS = ["attempted_solution", "partial_solution"]
#: Order of event types within a year.
TYPE_ORDER = {"limitation_identified": 1, "repeated_limitation": 2, "attempted_solution": 3, "partial_solution": 4, "domain_adaptation": 5, "limitation_persists": 6, "reopened_limitation": 7, "current_candidate_gap": 8}
STATES = ["EMERGING", "PERSISTENT", "PARTIALLY_ADDRESSED", "ADDRESSED", "REOPENED", "UNCERTAIN"]


def event_type(text: Column, cues: dict[str, str] | None = None) -> Column:
    c = {"open": lexicon.STILL_OPEN, "partly_open": lexicon.PARTLY_OPEN, "reopened": lexicon.REOPENED, "solved": lexicon.SOLVED, "partly_solved": lexicon.PARTLY_SOLVED} | (cues or {})
    hit = lambda k: matches(text, c[k])
    still = F.when(hit("partly_open"), "partial_solution").when(hit("reopened"), "reopened_limitation").otherwise("limitation_persists")
    return F.when(hit("open"), still).when(hit("solved"), F.when(hit("partly_solved"), "partial_solution").otherwise("attempted_solution")).otherwise("limitation_identified")


def classify_events(evidence: DataFrame, cues: dict[str, str] | None = None) -> DataFrame:
    """Evidence (gap_id, paper_id, source_text, confidence, seq) as events with type and relation."""
    kind = event_type(F.col("source_text"), cues)
    relation = F.when(F.col("event_type").isin(*SOLUTIONS), "addresses").when(F.col("event_type") == "reopened_limitation", "reopens").otherwise("limited_by")
    return evidence.withColumn("source_text", strip(F.col("source_text"))).withColumn("event_type", kind).withColumn("relationship", relation)


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def dedupe_events(evidence: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """Events once each: evidence by paper and text, graph events by paper, type and text besides those of evidence.

    Evidence counts as limitation_identified in the key, whatever its type.
    """
    own = first_by(evidence.withColumn("__k", F.lit("limitation_identified")).withColumn("__p", F.lit(0)), ["gap_id", "paper_id", "source_text"], ["seq"])
    if graph is None:
        return own.drop("__k", "__p")
    both = own.unionByName(graph.withColumn("__k", F.col("event_type")).withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return first_by(both, ["gap_id", "paper_id", "__k", "source_text"], ["__p", "seq"]).drop("__k", "__p")


def title_words(gaps: DataFrame, longer: int = 4) -> DataFrame:
    """(gap_id, w): distinct words of a gap's title of more than ``longer`` letters."""
    w = F.filter(F.array_distinct(F.split(F.lower("title"), "\\s+")), lambda x: F.char_length(x) > longer)
    return gaps.select("gap_id", F.explode(w).alias("w"))


def graph_events(gaps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Events from addresses and limited_by edges into limitation nodes whose label holds a word of the gap's title.

    Titles' distinct words are matched against labels; gaps then join by word.
    """
    labels = nodes.where("type = 'Limitation'").select("id", "label")
    pairs = containing(labels, F.lower("label"), title_words(gaps)).select("gap_id", F.col("id").alias("target")).distinct()
    kind = F.when(F.col("relationship") == "addresses", "attempted_solution").when(F.col("relationship") == "limited_by", "repeated_limitation")
    text = F.coalesce("source_text", F.concat(F.lit("Relationship "), "relationship", F.lit(" from "), "source", F.lit(" to "), "target"))
    rows = pairs.join(edges, "target").withColumn("event_type", kind).where("event_type is not null")
    return rows.select("gap_id", "paper_id", text.alias("source_text"), "confidence", "event_type", "relationship", "seq")


def resolve_years(df: DataFrame, papers: DataFrame) -> DataFrame:
    """``year``: the own one, else the paper's."""
    p = papers.select(F.col("id").alias("paper_id"), F.col("publication_year").alias("__y"))
    own = F.col("year") if "year" in df.columns else F.lit(None).cast("int")
    return df.join(p, "paper_id", "left").withColumn("year", F.coalesce(own, F.col("__y"))).drop("__y")


def impute_years(df: DataFrame, default: int = 2024) -> DataFrame:
    """Missing years become the upper median of the gap's known years; ``year_estimated`` marks them.

    The median comes from counts per year, so no gap's years are gathered in a list.
    """
    counts = df.where("year is not null").groupBy("gap_id", "year").agg(F.count("*").alias("n"))
    w = Window.partitionBy("gap_id").orderBy("year")
    upto = counts.withColumn("c", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("gap_id")))
    median = upto.where(F.col("c") > F.floor(F.col("total") / 2)).groupBy("gap_id").agg(F.min("year").alias("__m"))
    filled = df.join(median, "gap_id", "left").withColumn("year_estimated", F.col("year").isNull())
    return filled.withColumn("year", F.coalesce("year", "__m", F.lit(default))).drop("__m")


def type_order(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in TYPE_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, kind), F.lit(5))


def order_events(df: DataFrame) -> DataFrame:
    """``position``: chronological order within the gap, types of a year by their rank, then by seq."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy("gap_id").orderBy("year", type_order(F.col("event_type")), "seq")))


def flag_retrospective(df: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("event_type").isin("limitation_identified", "repeated_limitation"), F.col("year"))).over(Window.partitionBy("gap_id"))
    late = (F.col("event_type") == "attempted_solution") & (F.col("year") < first)
    return df.withColumn("is_retrospective", F.coalesce(late, F.lit(False)))


def append_anchor(df: DataFrame, gaps: DataFrame, default: int = 2026) -> DataFrame:
    """Add the candidate itself as each gap's last event, at its latest known year."""
    known = F.max(F.when(~F.coalesce(F.col("year_estimated"), F.lit(False)), F.col("year"))) if "year_estimated" in df.columns else F.max("year")
    last = df.groupBy("gap_id").agg(known.alias("year"))
    anchor = gaps.join(last, "gap_id", "left").select("gap_id", F.coalesce("year", F.lit(default)).alias("year"), F.lit("current_candidate_gap").alias("event_type"), F.lit("evaluated_as_candidate").alias("relationship"))
    return df.unionByName(anchor, allowMissingColumns=True)


def timeline_summary(df: DataFrame) -> DataFrame:
    """First and latest year, counts of repeated limitations, attempted solutions, addressing papers and events."""
    is_ = lambda kinds: F.col("event_type").isin(*kinds)
    known = F.when(is_(["current_candidate_gap"]), None).otherwise(F.col("year"))
    return df.groupBy("gap_id").agg(
        F.min(known).alias("first_year"), F.max(known).alias("latest_year"), F.sum(is_(LIMITS).cast("long")).alias("repeated_limitations"),
        F.sum(is_(SOLUTIONS).cast("long")).alias("attempted_solutions"), F.count_distinct(F.when(is_(["attempted_solution"]), F.col("paper_id"))).alias("addressing_papers"), F.count("*").alias("total_events"),
    )


def lifecycle(df: DataFrame) -> DataFrame:
    """(gap_id, status, confidence, n_papers, year_span) of events (gap_id, paper_id, year, event_type, confidence).

    A first aggregate finds the last solution's year and the gap's span; joined back, a second
    one counts what came after it or beside it. The anchor event is no evidence.
    """
    ev = df.where("event_type <> 'current_candidate_gap'")
    is_ = lambda kinds: F.col("event_type").isin(*kinds)
    a = ev.groupBy("gap_id").agg(
        F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_evidence"), F.min("year").alias("first"), F.max("year").alias("last"),
        F.max(F.when(is_(SOLUTIONS), F.col("year"))).alias("solved"), F.sum(is_(SOLUTIONS).cast("int")).alias("n_solutions"), F.sum(is_(["partial_solution"]).cast("int")).alias("n_partial"),
        F.sum(is_(["reopened_limitation"]).cast("int")).alias("n_reopened"), F.avg(F.when(is_(["attempted_solution"]), F.col("confidence"))).alias("sure"),
    )
    solvers = ev.where(is_(SOLUTIONS)).select("gap_id", "paper_id").distinct().withColumn("__s", F.lit(True))
    limits = ev.where(is_(LIMITS)).join(a.select("gap_id", "solved"), "gap_id").join(solvers, ["gap_id", "paper_id"], "left")
    b = limits.groupBy("gap_id").agg(
        F.sum(F.when(F.col("year") > F.col("solved"), 1).otherwise(0)).alias("later"), F.sum(F.when((F.col("year") == F.col("solved")) & F.col("__s").isNull(), 1).otherwise(0)).alias("beside")
    )
    r = a.join(b, "gap_id", "left").withColumns({"later": F.coalesce("later", F.lit(0)), "beside": F.coalesce("beside", F.lit(0)), "span": F.coalesce(F.col("last") - F.col("first"), F.lit(0))})
    pick = lambda s, c: F.struct(F.lit(s).alias("status"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    sure = F.coalesce("sure", F.lit(0.85))
    solved = (
        F.when((F.col("n_reopened") > 0) | (F.col("later") > 0), pick("REOPENED", 0.88))
        .when((F.col("n_partial") > 0) | (F.col("beside") > 0), pick("PARTIALLY_ADDRESSED", 0.84))
        .when(sure >= 0.80, pick("ADDRESSED", F.round(sure, 2)))
        .otherwise(pick("PARTIALLY_ADDRESSED", 0.84))
    )
    state = (
        F.when((F.col("n_papers") < 2) | (F.col("n_evidence") < 2), pick("UNCERTAIN", 0.50))
        .when(F.col("n_solutions") > 0, solved)
        .when(F.col("span") >= 2, pick("PERSISTENT", 0.92))
        .when(F.col("first") >= F.col("last") - 2, pick("EMERGING", 0.86))
        .otherwise(pick("UNCERTAIN", 0.60))
    )
    return r.withColumn("__s", state).select("gap_id", "__s.status", "__s.confidence", F.col("n_papers").cast("long").alias("n_papers"), F.col("span").cast("long").alias("year_span"))


def lifecycle_overview(states: DataFrame) -> DataFrame:
    known = states.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return F.broadcast(known).join(states.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def template_of(title: Column) -> Column:
    low = F.lower(title)
    has = lambda *ws: F.greatest(*[low.contains(w) for w in ws]) if len(ws) > 1 else low.contains(ws[0])
    return F.when(has("memory", "attention", "overhead"), "memory").when(has("cross-domain", "generaliz", "domain"), "domain").when(has("data", "scarcity", "annotat"), "data").otherwise("other")


def genealogy(gaps: DataFrame, events: DataFrame, first_years: DataFrame, templates: dict | None = None) -> DataFrame:
    """Six steps a gap (gap_id, title, description): step k takes the k-th event (position), else the template's default."""
    templates = lexicon.GENEALOGY if templates is None else templates
    steps = gaps.sparkSession.createDataFrame([(t, n, *s) for t, own in templates.items() for n, s in enumerate(own, 1)], "template string, step int, stage string, default_text string, relationship string")
    clean = F.trim(F.replace(F.replace(F.col("title"), F.lit("Empirical Bottleneck:"), F.lit("")), F.lit("Underexplored Research Frontier:"), F.lit("")))
    g = gaps.withColumn("clean", clean).withColumn("template", template_of(F.col("clean")))
    rows = g.join(F.broadcast(steps), "template").join(first_years.select("gap_id", "first_year"), "gap_id", "left")
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{title}"), F.col("clean")), F.lit("{description}"), F.coalesce("description", F.lit("")))
    e = events.where("event_type <> 'current_candidate_gap'").select("gap_id", F.col("position").alias("step"), F.col("year").alias("__y"), F.col("paper_id").alias("source_paper"), F.col("source_text").alias("__t"), F.col("confidence").alias("__c"))
    out = rows.join(e, ["gap_id", "step"], "left")
    year = F.coalesce("__y", F.coalesce("first_year", F.lit(2021)) + F.col("step") - 1)
    return out.select("gap_id", "step", fill("stage").alias("stage"), fill("default_text").alias("description"), "source_paper", F.coalesce("__t", fill("default_text")).alias("source_sentence"), year.cast("long").alias("year"), "relationship", F.round(F.coalesce("__c", F.lit(0.88)), 2).alias("confidence"))


def genealogy_summary(chain: DataFrame) -> DataFrame:
    own = chain.groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct("step", "stage"))).alias("s"))
    return own.select("gap_id", F.array_join(F.transform("s", lambda x: x["stage"]), " -> ").alias("summary"))


def static_status(df: DataFrame) -> DataFrame:
    """The baseline that looks at the number of papers only."""
    return df.groupBy("gap_id").agg(F.when(F.count_distinct("paper_id") >= 2, "PERSISTENT").otherwise("UNCERTAIN").alias("status"))
