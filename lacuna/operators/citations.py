"""Evidence contexts, prompts, and checking of cited statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.text import strip, token_overlap, words
from lacuna.operators.lifecycle import first_by
from lacuna.operators.verify import nli

RESPONSE = "executive_summary string, problem_statement string, evidence_analysis string, counter_evidence string, proposed_direction string, open_questions array<string>, confidence double, limitations string, citations array<string>"


def evidence_context(sources: DataFrame) -> DataFrame:
    """Tagged evidence E1, E2, ... of each gap from (gap_id, source_rank, seq, text, ...): distinct texts in order of source."""
    kept = first_by(sources.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0), ["gap_id", "text"], ["source_rank", "seq"])
    n = F.row_number().over(Window.partitionBy("gap_id").orderBy("source_rank", "seq", "text"))
    return kept.withColumn("n", n).withColumn("citation_id", F.concat(F.lit("E"), F.col("n").cast("string")))


def context_text(context: DataFrame) -> DataFrame:
    """(gap_id, context): a gap's tagged evidence as lines of one text, which goes into one prompt and so must fit one row."""
    line = F.concat(F.lit("["), "citation_id", F.lit("] "), "text")
    own = context.groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))).alias("s"))
    return own.select("gap_id", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("context"))


def prompts(gaps: DataFrame, context: DataFrame, states: DataFrame, verified: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(gap_id, prompt) from the gap, its lifecycle and verification states, its genealogy (gap_id, summary) and its tagged context."""
    steps = gaps.where("false").select("gap_id", F.lit("").alias("summary")) if steps is None else steps
    rows = gaps.join(context_text(context), "gap_id", "left").join(states.select("gap_id", F.col("status").alias("lifecycle")), "gap_id", "left").join(verified.select("gap_id", F.col("status").alias("verification")), "gap_id", "left")
    rows = rows.join(steps.select("gap_id", F.col("summary").alias("genealogy")), "gap_id", "left")
    part = lambda name, c, default="unknown": F.concat(F.lit(name + ": "), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)))
    lines = [part("Gap", "title"), part("Lifecycle", "lifecycle"), part("Genealogy", "genealogy", "Direct bottleneck"), part("Verification", "verification"), F.lit("Cite evidence by tag and state nothing without a tag."), part("Evidence", "context")]
    return rows.select("gap_id", F.concat_ws("\n", *lines).alias("prompt"))


def parse_responses(df: DataFrame, column: str = "response") -> tuple[DataFrame, DataFrame]:
    """Model answers as typed fields, and those that hold no JSON object."""
    bare = F.regexp_replace(F.col(column), "(?s)^\\s*```(?:json)?\\s*|\\s*```\\s*$", "")
    inner = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    parsed = df.withColumn("__j", F.from_json(inner, RESPONSE, {"mode": "PERMISSIVE"}))
    fields = [f.split()[0] for f in RESPONSE.split(", ")]
    bad = F.col("__j").isNull() | F.forall(F.array(*[F.col(f"__j.{f}").isNull() for f in fields]), lambda x: x)
    keys = [c for c in df.columns if c != column]
    return parsed.where(~bad).select(*keys, "__j.*"), parsed.where(bad).select(*df.columns)


def citation_tags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)\\[(E\\d+)\\]"), F.lit(1)), lambda x: F.upper(x))


def claims_of(text: Column) -> Column:
    """Statements of a text: lines without bullets, cut after stops before a capital or digit, longer than ten letters."""
    cut = "\u0001"
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(strip(x), "^[*\\-\\d.\\s]+", "")))
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, "([.!?])\\s+(?=[A-Z0-9])", f"$1{cut}"), cut)))
    return F.filter(F.transform(parts, strip), lambda s: F.char_length(s) > 10)


def split_claims(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(claims_of(F.col(text_col))).alias("claim_no", "claim_text"))


def validate_claims(claims: DataFrame, sources: DataFrame, min_score: float = 0.50, cues=None) -> DataFrame:
    """Status and support score of each claim (doc_id, claim_no, claim_text) against tagged sources (doc_id, citation_id, sentence_text)."""
    rows = claims.withColumn("tags", citation_tags(F.col("claim_text")))
    bare = F.regexp_replace(strip(F.regexp_replace("claim_text", "(?i)\\[E\\d+\\]", "")), "^[a-zA-Z_]+:\\s*", "")
    cited = rows.withColumn("bare", strip(bare)).select("doc_id", "claim_no", "bare", F.explode("tags").alias("citation_id"))
    cited = cited.join(sources.select("doc_id", "citation_id", F.col("sentence_text").alias("src")), ["doc_id", "citation_id"], "left")
    verdict, overlap = nli(F.col("bare"), cues), token_overlap(F.col("bare"), F.col("src"))
    near = F.when(overlap >= 0.25, F.least(F.lit(0.80), 0.40 + overlap)).otherwise(overlap)
    score = F.when(verdict["label"] == "CONTRADICTION", 0.0).when(verdict["label"] == "ENTAILMENT", F.greatest(F.lit(0.85), verdict["confidence"])).otherwise(near)
    per = cited.groupBy("doc_id", "claim_no").agg(F.bool_or(F.col("src").isNull()).alias("unknown"), F.bool_or(verdict["label"] == "CONTRADICTION").alias("against"), F.max(score).alias("score"))
    status = (
        F.when(F.size("tags") == 0, "INSUFFICIENT_EVIDENCE").when(F.col("unknown"), "HALLUCINATED_CITATION").when(F.col("against"), "CONTRADICTED")
        .when(F.col("score") >= min_score, "SUPPORTED").otherwise("UNSUPPORTED")
    )
    counted = F.col("status").isin("SUPPORTED", "UNSUPPORTED")
    out = rows.join(per, ["doc_id", "claim_no"], "left").withColumn("status", status)
    return out.select("doc_id", "claim_no", "claim_text", F.array_join("tags", ",").alias("cited"), "status", F.when(counted, F.round("score", 3)).otherwise(0.0).alias("support_score"))


def validation_report(verdicts: DataFrame, min_rate: float = 0.60) -> DataFrame:
    """Counts by status, support rate and validity of each document."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    a = verdicts.groupBy("doc_id").agg(F.count("*").alias("claims"), n("SUPPORTED").alias("supported"), n("UNSUPPORTED").alias("unsupported"), n("CONTRADICTED").alias("contradicted"), n("HALLUCINATED_CITATION").alias("hallucinated"), n("INSUFFICIENT_EVIDENCE").alias("uncited"))
    rate = F.col("supported") / F.col("claims")
    valid = (F.col("hallucinated") == 0) & (F.col("contradicted") == 0) & (rate >= min_rate)
    reason = F.when(F.col("hallucinated") > 0, "hallucinated citations").when(F.col("contradicted") > 0, "contradicted claims").when(rate < min_rate, "low support rate")
    return a.withColumns({"support_rate": F.round(rate, 6), "is_valid": valid, "reason": reason})


def overlap_words(text: Column) -> Column:
    return words(text, 3, lexicon.OVERLAP_STOP_WORDS)
