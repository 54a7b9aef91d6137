"""Counter-evidence: inference by cues, evidence categories, and verification of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.rules import any_match, contains_any
from lacuna.functions.text import strip
from lacuna.operators.lifecycle import first_by, title_words
from lacuna.operators.substrings import containing

CATEGORIES = ["SUPPORTING", "COUNTER", "CONTRADICTORY", "ADDRESSED_BY"]


def nli(text: Column, cues: tuple[list[str], list[str], list[str]] | None = None) -> Column:
    """Label and confidence of a hypothesis by its cues; the premise is not read."""
    against, pro, solved = cues or (lexicon.REFUTATION_PATTERNS, lexicon.ENTAILMENT_PATTERNS, lexicon.ADDRESSED_PATTERNS)
    s = strip(text)
    pick = lambda k, c: F.struct(F.lit(k).alias("label"), F.lit(c).alias("confidence"))
    return F.when(any_match(s, against), pick("CONTRADICTION", 0.92)).when(any_match(s, pro), pick("ENTAILMENT", 0.90)).when(any_match(s, solved), pick("CONTRADICTION", 0.84)).otherwise(pick("NEUTRAL", 0.65))


def category(text: Column, refuting: list[str] | None = None, solving: list[str] | None = None) -> Column:
    low = F.lower(text)
    return F.when(contains_any(low, refuting or lexicon.REFUTING), "COUNTER").when(contains_any(low, solving or lexicon.SOLVING), "ADDRESSED_BY").otherwise("SUPPORTING")


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    return first_by(evidence.withColumn("source_text", strip(F.col("source_text"))), ["gap_id", "paper_id", "source_text"], ["seq"])


def categorize(evidence: DataFrame, **options) -> DataFrame:
    """Evidence once each (gap_id, paper_id, source_text, year, confidence, seq) with its category."""
    return dedupe_evidence(evidence).withColumn("category", category(F.col("source_text"), **options))


def mine_edges(gaps: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Further evidence from graph edges whose text or ends hold a word of the gap's title, without what is there."""
    kind = F.when(F.col("relationship") == "contradicts", "CONTRADICTORY").when(F.col("relationship") == "addresses", "ADDRESSED_BY")
    rows = edges.where(F.length(F.coalesce("source_text", F.lit(""))) > 0).withColumn("category", kind)
    hay = F.lower(F.concat_ws("\n", "source_text", "source", "target"))
    found = containing(rows, hay, title_words(gaps)).select("gap_id", "paper_id", "source_text", "confidence", "seq", "category").distinct()
    new = first_by(found.join(seen.select("gap_id", "paper_id", "source_text"), ["gap_id", "paper_id", "source_text"], "left_anti"), ["gap_id", "paper_id", "source_text"], ["seq"])
    return new.where("category is not null")


def evidence_dates(df: DataFrame) -> DataFrame:
    """Earliest and latest year, and the sorted distinct years of each category."""
    years = lambda k: F.array_sort(F.collect_set(F.when(F.col("category") == k, F.col("year"))))
    return df.groupBy("gap_id").agg(F.min("year").alias("earliest_year"), F.max("year").alias("latest_year"), years("SUPPORTING").alias("supporting_years"), years("COUNTER").alias("counter_years"), years("ADDRESSED_BY").alias("addressed_years"))


def nli_distribution(df: DataFrame, text: str = "source_text", **options) -> DataFrame:
    labels = df.select("gap_id", nli(F.col(text), **options)["label"].alias("label"))
    return labels.groupBy("gap_id").pivot("label", ["ENTAILMENT", "CONTRADICTION", "NEUTRAL"]).count().na.fill(0)


def verify(df: DataFrame, as_of_year: int) -> DataFrame:
    """(gap_id, status, confidence, counts) from evidence (gap_id, paper_id, category, year, confidence), ordered rules."""
    is_ = lambda k: F.col("category") == k
    n = lambda k, name: F.sum(is_(k).cast("long")).alias(name)
    mean = lambda k, name: F.coalesce(F.avg(F.when(is_(k), F.col("confidence"))), F.lit(0.0)).alias(name)
    last = lambda k, name: F.coalesce(F.max(F.when(is_(k), F.col("year"))), F.lit(0)).alias(name)
    a = df.groupBy("gap_id").agg(
        F.count_distinct(F.when(is_("SUPPORTING"), F.col("paper_id"))).alias("papers"), n("SUPPORTING", "s"), n("COUNTER", "c"), n("CONTRADICTORY", "k"), n("ADDRESSED_BY", "a"),
        mean("SUPPORTING", "ms"), mean("COUNTER", "mc"), mean("ADDRESSED_BY", "ma"), last("SUPPORTING", "ys"), last("ADDRESSED_BY", "ya"),
    )
    s, c, k, d = (F.col(x).cast("double") for x in "scka")
    pro = s * F.col("ms")
    opened = F.round(F.least(F.greatest(pro / (pro + 1.5 * c + 1.0 * k + 0.8 * d + 0.5), F.lit(0.50)), F.lit(0.98)), 4)
    pick = lambda x, v: F.struct(F.lit(x).alias("status"), (v if isinstance(v, Column) else F.lit(v)).cast("double").alias("confidence"))
    state = (
        F.when((F.col("papers") < 2) | (s < 2), pick("UNCERTAIN", 0.35))
        .when(((c >= 1) & (F.col("mc") >= 0.85)) | (c >= 2), pick("REFUTED", F.greatest(F.lit(0.20), F.round(1 - F.col("mc"), 4))))
        .when((k >= 1) & (k >= s / 2), pick("UNCERTAIN", 0.50))
        .when((d >= 1) & (F.col("ya") >= F.col("ys")), F.when(F.col("ma") >= 0.85, pick("ADDRESSED", 0.88)).otherwise(pick("PARTIALLY_ADDRESSED", 0.75)))
        .when(F.lit(as_of_year) - F.col("ys") >= 3, pick("OUTDATED", 0.70))
        .otherwise(pick("VERIFIED_OPEN", opened))
    )
    return a.withColumn("__s", state).select("gap_id", "__s.status", "__s.confidence", F.col("s").alias("supporting"), F.col("c").alias("counter"), F.col("k").alias("contradictory"), F.col("a").alias("addressed"))


def counter_evidence(df: DataFrame) -> DataFrame:
    """Opposing items of each gap and the strongest: the surest of the first category that has any."""
    rank = F.when(F.col("category") == "COUNTER", 3).when(F.col("category") == "CONTRADICTORY", 2).otherwise(1)
    rows = df.where("category <> 'SUPPORTING'")
    return rows.groupBy("gap_id").agg(F.count("*").alias("total"), F.max_by("source_text", F.struct(rank, F.col("confidence"), -F.col("seq"))).alias("strongest"))


def acceptance(df: DataFrame) -> DataFrame:
    """Naive against verified acceptance (gold_open, accepted_naive, accepted_verified): TP, FP, precision, false-positive rate."""
    out = None
    for name in ("naive", "verified"):
        ok = F.col(f"accepted_{name}")
        tp, fp, tn = (F.sum((x).cast("long")) for x in (ok & F.col("gold_open"), ok & ~F.col("gold_open"), ~ok & ~F.col("gold_open")))
        row = df.agg(tp.alias("tp"), fp.alias("fp"), tn.alias("tn")).select(F.lit(name).alias("approach"), "tp", "fp", F.coalesce(F.expr("try_divide(tp, tp + fp)"), F.lit(0.0)).alias("precision"), F.coalesce(F.expr("try_divide(fp, fp + tn)"), F.lit(0.0)).alias("fpr"))
        out = row if out is None else out.unionByName(row)
    return out
