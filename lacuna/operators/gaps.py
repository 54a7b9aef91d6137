"""Signals of research gaps, gap candidates, priorities, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.rules import matches
from lacuna.functions.text import slugify, title_case
from lacuna.operators.ranks import positions
from lacuna.operators.substrings import containing

#: Confidence of the candidates whose evidence carries none.
TOPIC_SURE, METHOD_SURE, DATASET_SURE, CONFLICT_SURE = 0.88, 0.89, 0.88, 0.87


def sig_underexplored(papers: Column, mean: Column) -> Column:
    ratio = papers / F.when(mean > 0, mean).otherwise(1.0)
    return F.when(ratio < 0.75, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio / 0.75 * 0.7)), 4)).otherwise(0.0)


def sig_repeated(papers: Column, limitations: Column) -> Column:
    score = F.lit(0.60) + 0.15 * (papers - 2) + F.least(F.lit(0.10), 0.02 * limitations)
    return F.when(papers >= 2, F.round(F.least(F.lit(1.0), score), 4)).otherwise(0.0)


def sig_concentration(counts: DataFrame, by: list[str], name: str = "name", n: str = "n") -> DataFrame:
    """Concentration of a group's counts: hhi, signal, the largest name and its share, the three largest.

    Sums give the index, and only the first three names of a group are ever gathered.
    """
    order = [F.desc(n), F.col(name)]
    sums = counts.groupBy(*by).agg(F.sum(n).alias("total"), (F.sum(F.col(n).cast("double") * F.col(n)) / F.sum(n) / F.sum(n)).alias("hhi"))
    if by:
        top = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r <= 3")
    else:
        top = counts.orderBy(*order).limit(3)
    first = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("c"), F.col(name).alias("k"))))
    top = top.groupBy(*by).agg(first.alias("__o"))
    out = sums.join(top, by) if by else sums.crossJoin(top)  # one row each
    score = F.when((F.col("total") > 1) & (F.col("hhi") >= 0.50), F.round(F.least(F.lit(1.0), (F.col("hhi") - 0.40) / 0.60), 4)).otherwise(0.0)
    return out.select(*by, "total", "hhi", score.alias("signal"), F.col("__o")[0]["k"].alias("top"), (-F.col("__o")[0]["c"] / F.col("total")).alias("top_share"), F.transform("__o", lambda s: s["k"]).alias("top_three"))


def sig_temporal(first: Column, last: Column, addressed: Column) -> Column:
    span = last - first
    ok = first.isNotNull() & last.isNotNull() & ~F.coalesce(addressed, F.lit(False)) & (span >= 1)
    return F.when(ok, F.round(F.least(F.lit(1.0), 0.50 + 0.15 * span), 4)).otherwise(0.0)


def sig_cross_domain(domains: Column) -> Column:
    return F.when(domains <= 1, 0.85).otherwise(0.0)


def sig_conflict(conflicts: Column, papers: Column) -> Column:
    return F.when((conflicts >= 1) & (papers >= 2), F.round(F.least(F.lit(1.0), 0.75 + 0.10 * (conflicts - 1)), 4)).otherwise(0.0)


def limitation_key(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The key of a recurring limitation: the first keyword group, else its first three longer words."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit("[\\p{L}\\p{N}_]{4,}"), F.lit(0))
    plain = F.filter(found, lambda w: ~w.isin(*lexicon.NO_KEY_WORDS))
    key = F.when(F.size(plain) > 0, F.array_join(F.slice(plain, 1, 3), " ")).otherwise("unspecified limitation")
    chosen = None
    for pattern, name in lexicon.LIMITATION_KEYS if rules is None else rules:
        chosen = F.when(matches(low, pattern), name) if chosen is None else chosen.when(matches(low, pattern), name)
    return chosen.otherwise(key) if chosen is not None else key


def signals_map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def weight(name: Column, weights: dict[str, float] | None = None) -> Column:
    table = lexicon.SIGNAL_WEIGHTS if weights is None else weights
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), name)


def priority(signals: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of a map of signals, each part rounded to four places, held in 0 to 1."""
    table = lexicon.SIGNAL_WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for name, w in table.items():
        total = total + F.round(F.coalesce(F.element_at(signals, F.lit(name)), F.lit(0.0)) * w, 4)
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4)


def breakdown(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(gap_id, signal, value, weight, contribution): one row a signal of the weight table."""
    table = lexicon.SIGNAL_WEIGHTS if weights is None else weights
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.coalesce(F.element_at("signals", F.lit(k)), F.lit(0.0)).alias("value"), F.lit(w).alias("weight")) for k, w in table.items()]))
    return candidates.select("gap_id", rows.alias("s")).select("gap_id", "s.*", F.round(F.col("s.value") * F.col("s.weight"), 4).alias("contribution"))


def narrative(parts: DataFrame) -> DataFrame:
    """(gap_id, narrative): the active signals, the largest contribution first."""
    own = parts.where("value > 0").groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("contribution")).alias("c"), "signal", "value"))).alias("s"))
    return own.select("gap_id", F.array_join(F.transform("s", lambda x: F.format_string("%s (%.2f)", x["signal"], x["value"])), "; ").alias("narrative"))


def _candidate(df: DataFrame, gap_id: Column, title: Column, kind: Column, signals: Column, sure: Column) -> DataFrame:
    """Candidate rows; a candidate without a paper or without evidence is dropped."""
    own = df.where("n_papers > 0 and n_evidence > 0").withColumn("signals", signals)
    return own.select(gap_id.alias("gap_id"), title.alias("title"), kind.alias("gap_type"), F.lit("potential_gap").alias("verification_status"), F.col("n_papers").cast("long"), F.col("n_evidence").cast("long"), "signals", priority(F.col("signals")).alias("gap_priority_score"), F.round(sure, 4).alias("confidence"))


def limitation_gaps(limitations: DataFrame, addressed: DataFrame) -> DataFrame:
    """Gaps of recurring limitations (id, paper_id, year, text, confidence); ``addressed`` has ids with an addressing edge."""
    keyed = limitations.withColumn("key", limitation_key(F.col("text"))).join(addressed.select("id").distinct().withColumn("__a", F.lit(True)), "id", "left")
    g = keyed.groupBy("key").agg(
        F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_limitations"), F.sum(F.when(F.length("text") > 0, 1).otherwise(0)).alias("n_evidence"),
        F.min("year").alias("first"), F.max("year").alias("last"), F.bool_or(F.coalesce("__a", F.lit(False))).alias("addressed"), F.avg("confidence").alias("sure"),
    )
    rep = sig_repeated(F.col("n_papers"), F.col("n_limitations"))
    signals = signals_map(repeated_limitation=rep, temporal_opportunity=sig_temporal(F.col("first"), F.col("last"), F.col("addressed")))
    slug = F.substring(slugify(F.col("key"), "-", None), 1, 32)
    return _candidate(g, F.concat(F.lit("gap-limitation-"), slug), F.concat(F.lit("Empirical Bottleneck: "), title_case(F.col("key"))), F.when(rep > 0, "repeated_limitation").otherwise("temporal_opportunity"), signals, F.col("sure"))


def topic_gaps(topics: DataFrame, members: DataFrame) -> DataFrame:
    """Gaps of topics (topic_id, topic_name) with few papers (members: topic_id, paper_id)."""
    counts = topics.join(members.groupBy("topic_id").agg(F.count_distinct("paper_id").alias("n")), "topic_id", "left").withColumn("n_papers", F.coalesce("n", F.lit(0)))
    mean = counts.agg(F.avg("n_papers").alias("mean"))
    g = counts.crossJoin(F.broadcast(mean)).withColumn("n_evidence", F.col("n_papers"))  # one row
    signals = signals_map(underexplored=sig_underexplored(F.col("n_papers"), F.col("mean")), cross_domain=sig_cross_domain(F.lit(1)))
    return _candidate(g, F.concat(F.lit("gap-topic-"), F.col("topic_id").cast("string")), F.concat(F.lit("Underexplored Research Frontier: "), F.col("topic_name")), F.lit("underexplored_area"), signals, F.lit(TOPIC_SURE))


def concentration_gaps(uses: DataFrame, kind: str) -> DataFrame:
    """One gap if the use (name, paper_id) of methods or datasets is concentrated; its papers use the largest."""
    counts = uses.groupBy("name").agg(F.count("*").alias("n"))
    c = sig_concentration(counts, []).where("signal > 0")
    own = uses.join(F.broadcast(c.select(F.col("top").alias("name"), "signal")), "name").groupBy("name", "signal").agg(F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_evidence"))
    name, sure = ("method_concentration", METHOD_SURE) if kind == "method" else ("dataset_concentration", DATASET_SURE)
    return _candidate(own, F.concat(F.lit(f"gap-{kind}-"), slugify(F.col("name"), "-", None)), F.concat(F.lit(f"Concentration on {kind} "), F.col("name")), F.lit(name), signals_map(**{name: F.col("signal")}), F.lit(sure))


def conflict_gaps(edges: DataFrame) -> DataFrame:
    """One gap from contradicts edges between two papers or more."""
    g = edges.where("relationship = 'contradicts'").agg(F.count("*").alias("n_evidence"), F.count_distinct("paper_id").alias("n_papers"))
    g = g.withColumn("c", sig_conflict(F.col("n_evidence"), F.col("n_papers"))).where("c > 0")
    return _candidate(g, F.lit("gap-conflict"), F.lit("Conflicting Evidence"), F.lit("conflicting_evidence"), signals_map(conflicting_evidence=F.col("c")), F.lit(CONFLICT_SURE))


def generate_candidates(parts: list[DataFrame], min_priority: float = 0.0, min_confidence: float = 0.5) -> DataFrame:
    """Candidates of all generators, the first of each id, above the thresholds, by priority."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("__n", F.lit(n))
        out = p if out is None else out.unionByName(p)
    first = Window.partitionBy("gap_id").orderBy("__n")
    kept = out.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__n")
    return kept.where((F.col("gap_priority_score") >= min_priority) & (F.col("confidence") >= min_confidence)).orderBy(F.desc("gap_priority_score"), "gap_id")


def list_candidates(df: DataFrame, gap_type: str | None = None, min_priority: float = 0.0, min_confidence: float = 0.5, q: str | None = None, limit: int | None = 50) -> DataFrame:
    if gap_type:
        df = df.where(F.col("gap_type") == gap_type)
    if q:
        df = df.where(F.lower("title").contains(q.lower()))
    df = df.where((F.col("gap_priority_score") >= min_priority) & (F.col("confidence") >= min_confidence)).orderBy(F.desc("gap_priority_score"), "gap_id")
    return df if limit is None else df.limit(limit)


def find_candidate(df: DataFrame, gap_id: str) -> DataFrame:
    return df.where((F.col("gap_id") == gap_id) | F.col("gap_id").endswith(gap_id))


def dashboard(papers: DataFrame, topics: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, n): counts for an overview page."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    conflict = candidates.where(F.coalesce(F.element_at("signals", F.lit("conflicting_evidence")), F.lit(0.0)) > 0)
    parts = [count(papers, "papers"), count(topics, "topics"), count(topics.where("trajectory = 'EMERGING'"), "emerging"), count(candidates, "gaps"), count(conflict, "conflicts")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_gold(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates (gap_id, title, gap_type, rank) with the first gold item (gt_id, keywords, gap_type) they match, or null.

    An item matches by two keywords, or by its type and one. The gold table is a few rows.
    """
    words = gold.select("gt_id", F.col("gap_type").alias("gold_type"), F.explode(F.transform("keywords", lambda k: F.lower(k))).alias("w"))
    hits = containing(candidates.select("gap_id", "gap_type", "title"), F.lower("title"), words)
    counted = hits.groupBy("gap_id", "gt_id").agg(F.count("*").alias("n"), F.bool_or(F.col("gap_type") == F.col("gold_type")).alias("same"))
    found = counted.where("n >= 2 or same").groupBy("gap_id").agg(F.min("gt_id").alias("gt_id"))
    return candidates.join(found, "gap_id", "left")


def gap_benchmark(matched: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision at 5, recall at 10, reciprocal rank, false positives and false negatives of matched candidates."""
    n = gold.agg(F.count("*").alias("gold_n"))
    m = matched.agg(
        (F.sum(F.when((F.col("rank") <= 5) & F.col("gt_id").isNotNull(), 1).otherwise(0)) / F.least(F.lit(5), F.count("*"))).alias("precision_at_5"),
        F.count_distinct(F.when(F.col("rank") <= 10, F.col("gt_id"))).alias("found10"), F.min(F.when(F.col("gt_id").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("gt_id").isNull(), 1).otherwise(0)).alias("false_positives"), F.count_distinct("gt_id").alias("found"),
    )
    return m.crossJoin(n).select("precision_at_5", (F.col("found10") / F.col("gold_n")).alias("recall_at_10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), "false_positives", (F.col("gold_n") - F.col("found")).alias("false_negatives"))  # one row each


def rank_by(df: DataFrame, weights: dict[str, float], approach: str, by: list[str] | None = None) -> DataFrame:
    """Candidates ranked by a weighted sum of their signals (a map), by ordered parts."""
    score = F.lit(0.0)
    for k, w in weights.items():
        score = score + F.lit(float(w)) * F.coalesce(F.element_at("signals", F.lit(k)), F.lit(0.0))
    rows = df.withColumn("score", F.round(score, 8)).withColumn("approach", F.lit(approach))
    return positions(rows, ["approach", *(by or [])], [F.desc("score"), "gap_id"]).withColumnRenamed("position", "rank")


def signal_overview(parts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each signal with its weight and how many candidates it is active in, its mean value there."""
    table = lexicon.SIGNAL_WEIGHTS if weights is None else weights
    known = parts.sparkSession.createDataFrame(list(table.items()), "signal string, weight double")
    used = parts.where("value > 0").groupBy("signal").agg(F.count("*").alias("active"), F.avg("value").alias("mean_value"))
    return F.broadcast(known).join(used, "signal", "left").select("signal", "weight", F.coalesce("active", F.lit(0)).cast("long").alias("active"), F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"))
