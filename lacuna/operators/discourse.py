"""Discourse labels, detectors and entities of sentences (columns source_text, section_name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.rules import Cue, any_match, contains_any, first_match, folded, matches, weight_max, weight_sum
from lacuna.functions.text import AFTER, BEFORE, strip
from lacuna.operators.substrings import containing

BASE, THRESHOLD = 0.1, 0.8
#: What own work is called, and strings of which every numeric gain holds one.
OWN_WORK = Cue(r"\b(?:our\s+(?:work|method|study|approach|pipeline|algorithm)|we\s+acknowledge)\b", "our", "we")
GAIN_NEEDS = ("improve", "gain", "boost", "outperform", "by")
STRONG_SECTIONS = ["limitation", "limitations", "threats to validity", "future work"]


def section_key(section: Column) -> Column:
    return F.lower(F.trim(F.coalesce(section, F.lit(""))))


def score_patterns(df: DataFrame, rules: dict[str, list] | None = None, labels: list[str] | None = None, text: str = "source_text") -> DataFrame:
    """Add ``scores``, an array in label order: the base plus the weights of matching patterns."""
    rules = lexicon.LABEL_PATTERNS if rules is None else rules
    labels = labels or lexicon.LABELS
    own = [weight_sum(F.coalesce(F.col(text), F.lit("")), rules.get(k, []), BASE) for k in labels]
    return df.withColumn("scores", F.array(*own))


def apply_priors(df: DataFrame, priors: dict[str, dict[str, float]] | None = None, labels: list[str] | None = None, strong: list[str] | None = None) -> DataFrame:
    """Add a section's weights to the scores where any pattern matched, and always in the strong sections."""
    priors = lexicon.SECTION_PRIORS if priors is None else priors
    labels, strong = labels or lexicon.LABELS, STRONG_SECTIONS if strong is None else strong
    key = section_key(F.col("section_name"))
    table = F.create_map(*[x for s, w in priors.items() for x in (F.lit(s), F.array(*[F.lit(float(w.get(k, 0.0))) for k in labels]))])
    boost = F.element_at(table, key)
    use = boost.isNotNull() & ((F.array_max("scores") > BASE) | key.isin(*strong))
    return df.withColumn("scores", F.when(use, F.zip_with("scores", boost, lambda a, b: a + b)).otherwise(F.col("scores")))


def choose_label(df: DataFrame, labels: list[str] | None = None, text: str = "source_text", digits: int = 2) -> DataFrame:
    """Add ``label`` (ties to the first) and ``confidence`` (soft-max held in .55 to .98)."""
    labels = labels or lexicon.LABELS
    top = F.array_max("scores")
    name = F.element_at(F.array(*map(F.lit, labels)), F.array_position("scores", top).cast("int"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(F.least(s, F.lit(10.0))))
    sure = F.round(F.least(F.greatest(F.exp(F.least(top, F.lit(10.0))) / total, F.lit(0.55)), F.lit(0.98)), digits)
    empty = F.length(strip(F.coalesce(F.col(text), F.lit("")))) == 0
    return df.withColumn("label", F.when(empty | (top < THRESHOLD), F.lit("OTHER")).otherwise(name)).withColumn(
        "confidence", F.when(empty, F.lit(0.5)).when(top < THRESHOLD, F.lit(0.65)).otherwise(sure)
    )


def _prepared(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the stripped text and its folded form, each computed once for all detectors."""
    if "__s" in df.columns:
        return df
    return df.withColumn("__s", strip(F.coalesce(F.col(text), F.lit("")))).withColumn("__low", folded(F.col("__s")))


def _without(df: DataFrame, like: DataFrame, *own: str) -> DataFrame:
    """``df`` without its columns ``own``, and without the prepared ones if ``like`` has none."""
    return df.drop(*own, *(["__s", "__low"] if "__s" not in like.columns else []))


def classify(df: DataFrame, rules=None, priors=None, labels=None, text: str = "source_text", strong=None, digits: int = 2) -> DataFrame:
    """Add ``label`` and ``confidence``, as ``choose_label`` over ``apply_priors`` over ``score_patterns`` does.

    Scores are columns here, a step each, so that each pattern is looked for once and all steps are compiled.
    """
    rules, priors = lexicon.LABEL_PATTERNS if rules is None else rules, lexicon.SECTION_PRIORS if priors is None else priors
    labels, strong = labels or lexicon.LABELS, STRONG_SECTIONS if strong is None else strong
    raw, own = [f"__r{i}" for i in range(len(labels))], [f"__t{i}" for i in range(len(labels))]
    largest = lambda columns: F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = _prepared(df, text).withColumn("__key", section_key(F.col("section_name")))
    rows = rows.withColumns({r: weight_sum(whole, rules.get(k, []), BASE, F.col("__low")) for r, k in zip(raw, labels)})
    rows = rows.withColumn("__use", F.col("__key").isin(*priors) & ((largest(raw) > BASE) | F.col("__key").isin(*strong)))

    def lifted(r, k):
        boost = F.lit(0.0)
        for section, weights in priors.items():
            boost = F.when(F.col("__key") == section, F.lit(float(weights.get(k, 0.0)))).otherwise(boost)
        return F.when(F.col("__use"), F.col(r) + boost).otherwise(F.col(r))

    rows = rows.withColumns({t: lifted(r, k) for t, r, k in zip(own, raw, labels)}).withColumn("__top", largest(own))
    name, total = F.lit(labels[-1]), F.lit(0.0)
    for t, k in reversed(list(zip(own, labels))):
        name = F.when(F.col(t) == F.col("__top"), F.lit(k)).otherwise(name)
    for t in own:
        total = total + F.exp(F.least(F.col(t), F.lit(10.0)))
    sure = F.round(F.least(F.greatest(F.exp(F.least(F.col("__top"), F.lit(10.0))) / total, F.lit(0.55)), F.lit(0.98)), digits)
    empty, low = F.length("__s") == 0, F.col("__top") < THRESHOLD
    chosen = rows.withColumns({"label": F.when(empty | low, F.lit("OTHER")).otherwise(name), "confidence": F.when(empty, F.lit(0.5)).when(low, F.lit(0.65)).otherwise(sure)})
    return _without(chosen, df, "__key", "__use", "__top", *raw, *own)


def classify_with(df: DataFrame, model, **options) -> DataFrame:
    """Label by a column function ``model(text, section)`` where it gives one, else by the rules."""
    ruled = classify(df, **options)
    return ruled.withColumn("label", F.coalesce(model(F.col("source_text"), F.col("section_name")), F.col("label")))


def detect_limitations(df: DataFrame, subtypes: dict[str, list[str]] | None = None, text: str = "source_text") -> DataFrame:
    """Add ``subtype`` and ``lim_confidence``; null where the sentence states no limitation."""
    subtypes = lexicon.LIMITATION_SUBTYPES if subtypes is None else subtypes
    s, low, key, kind = F.col("__s"), F.col("__low"), section_key(F.col("section_name")), F.col("__kind")
    inside = contains_any(key, ["limitation", "threats to validity", "weakness", "drawback"])
    own = matches(s, OWN_WORK, low=low)
    out = matches(s, lexicon.MEASUREMENT, low=low) | (matches(s, lexicon.PRIOR_WORK, low=low) & ~own)
    special = [k for k in subtypes if k != "generic"]
    named = F.coalesce(*[F.when(any_match(s, subtypes[k], low), F.lit(k)) for k in special], F.when(any_match(s, subtypes.get("generic", []), low), F.lit("generic")))
    hedged = matches(s, r"\b(?:however|although|yet|while|though|cannot|limited|constrained|assumes?|limits?|relies?|fails?|small)\b")
    found = F.coalesce(named, F.when(inside & hedged, F.lit("generic")))
    # what takes a limitation back is looked for where there is one
    rows = _prepared(df, text).withColumn("__kind", F.when(F.char_length(s) >= 10, found))
    rows = rows.withColumn("subtype", F.when(kind.isNotNull() & (inside | ~out), kind))
    sure = F.lit(0.72) + F.when(F.col("subtype") != "generic", 0.18).otherwise(0.0) + F.when(inside, 0.08).otherwise(0.0)
    return _without(rows.withColumn("lim_confidence", F.when(F.col("subtype").isNotNull(), F.round(F.least(sure, F.lit(0.98)), 2))), df, "__kind")


def _confidence(base: float, weight: Column, inside: Column) -> Column:
    sure = F.lit(base) + F.when(weight >= 3.0, 0.16).otherwise(0.0) + F.when(inside, 0.08).otherwise(0.0)
    return F.when(weight > 0, F.round(F.least(sure, F.lit(0.98)), 2))


def detect_future_work(df: DataFrame, rules: list | None = None, text: str = "source_text") -> DataFrame:
    """Add ``fw_confidence``; null where the sentence names no future work."""
    s, key, weight = F.col("__s"), section_key(F.col("section_name")), F.col("__w")
    forward = matches(s, r"\b(?:will|should|could|plan|aim|explore|investigate|study|hope|next|release)\b")
    rows = _prepared(df, text).withColumn("__w", weight_max(s, lexicon.FUTURE_WORK if rules is None else rules, F.col("__low")))
    rows = rows.withColumn("__w", F.when(F.char_length(s) < 10, 0.0).when((weight == 0) & key.contains("future work") & forward, 2.5).otherwise(weight))
    return _without(rows.withColumn("fw_confidence", _confidence(0.72, weight, contains_any(key, ["future work", "conclusion", "discussion"]))), df, "__w")


def numeric_gain(text: Column) -> Column:
    found = F.regexp_extract(text, "(?i)" + lexicon.NUMERIC_GAIN, 0)
    return F.nullif(found, F.lit(""))


def has_p_value(text: Column) -> Column:
    return matches(text, lexicon.P_VALUE)


def detect_results(df: DataFrame, rules: list | None = None, text: str = "source_text") -> DataFrame:
    """Add ``numerical_gain``, ``has_p_value`` and ``res_confidence``; null where no result is stated."""
    s, low, key, weight = F.col("__s"), F.col("__low"), section_key(F.col("section_name")), F.col("__w")
    inside = contains_any(key, ["result", "evaluation", "experiments", "findings", "discussion"])
    gain = F.when(contains_any(low, GAIN_NEEDS), numeric_gain(s))
    rows = _prepared(df, text).withColumns({"numerical_gain": gain, "has_p_value": matches(s, lexicon.P_VALUE, low=low), "__w": weight_max(s, lexicon.RESULTS if rules is None else rules, low)})
    shown = matches(s, r"\b(?:table|figure)\s+\d+\s+(?:shows|illustrates|summarizes)\b")
    rows = rows.withColumn("__w", F.when(F.col("numerical_gain").isNotNull() | F.col("has_p_value"), F.greatest(weight, F.lit(2.8))).otherwise(weight))
    rows = rows.withColumn("__w", F.when(F.char_length(s) < 10, 0.0).when(inside & (weight == 0) & shown, 2.2).otherwise(weight))
    return _without(rows.withColumn("res_confidence", _confidence(0.70, weight, inside)), df, "__w")


def _named(text: Column, templates: list[str], ignore: list[str], article: str) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in templates])
    clean = F.transform(found, lambda x: F.regexp_replace(F.trim(x), article, ""))
    return F.filter(clean, lambda x: (F.char_length(x) >= 3) & ~F.lower(x).isin(*ignore))


def dictionary_mentions(text: Column, names: list[str], low: Column | None = None) -> Column:
    """Known names in a text as written there, the first of each; ``low`` is the folded text, if it is at hand."""
    low = folded(text) if low is None else low

    def first(n):
        found = F.regexp_extract(text, "(?i)" + BEFORE + "\\Q" + n + "\\E" + AFTER, 0)
        return F.when(low.contains(n.lower().strip()), found).otherwise("") if n.isascii() else found

    return F.filter(F.array(*map(first, names)), lambda x: x != "")


def dictionary_join(df: DataFrame, names: DataFrame, text: str = "source_text", name: str = "name") -> DataFrame:
    """Rows of ``df`` with each row of ``names`` whose name is in the text as a word or words of its own, without case: adds ``mention``, the first one as written there.

    For dictionaries of any size: names meet texts by q-grams, and only what is suggested is matched at its edges.
    The columns of ``names`` other than the name, such as a canonical one, come along.
    """
    low = names.where(F.length(name) > 0).withColumn("w", F.lower(name))
    found = containing(df, F.lower(text), low)
    pattern = F.concat(F.lit("(?iu)" + BEFORE + "\\Q"), F.replace(F.col(name), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E" + AFTER))
    return found.withColumn("mention", F.regexp_substr(F.col(text), pattern)).where("mention is not null").drop("w")


def drop_substrings(items: Column, name: str = "entity_name") -> Column:
    """Items whose name, without case, is not a part of a longer one's."""
    low = lambda x: F.lower(x[name])
    return F.filter(items, lambda a: ~F.exists(items, lambda b: low(b).contains(low(a)) & (low(b) != low(a))))


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def _first_of_each(items: Column, name: str) -> Column:
    """Items whose name, without case, no earlier one has."""
    lower = lambda x: F.lower(x[name])
    return _let(items, lambda own: _let(F.transform(own, lower), lambda low: F.filter(own, lambda x, i: F.array_position(low, lower(x)) == i + 1)))


def _entity_items(templates, ignore, article, names, sure: float, known: float, text: str, low: Column | None = None) -> Column:
    """An array of (entity_name, confidence, extraction_method), names once each and none a part of a longer one."""
    s = F.coalesce(F.col(text), F.lit(""))
    item = lambda m, c: lambda x: F.struct(x.alias("entity_name"), F.lit(c).alias("confidence"), F.lit(m).alias("extraction_method"))
    both = F.concat(F.transform(_named(s, templates, ignore, article), item("linguistic_template", sure)), F.transform(dictionary_mentions(s, names, low), item("canonical_dictionary", known)))
    # one name is neither repeated nor a part of another
    return _let(both, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(_let(_first_of_each(all_, "entity_name"), lambda items: drop_substrings(items))))


def _entities(df: DataFrame, kind: str, *rules) -> DataFrame:
    return df.select(*df.columns, F.lit(kind).alias("entity_type"), F.inline(_entity_items(*rules)))


def _method_rules(templates=None, names=None, text: str = "source_text") -> tuple:
    return templates or lexicon.METHOD_TEMPLATES, lexicon.NO_METHODS, "^[Tt]he\\s+|^[Aa]n?\\s+", names or lexicon.CANONICAL_METHODS, 0.85, 0.92, text


def _dataset_rules(templates=None, names=None, text: str = "source_text") -> tuple:
    return templates or lexicon.DATASET_TEMPLATES, lexicon.NO_DATASETS, "^[Tt]he\\s+", names or lexicon.CANONICAL_DATASETS, 0.84, 0.94, text


def extract_methods(df: DataFrame, templates=None, names=None, text: str = "source_text") -> DataFrame:
    return _entities(df, "METHOD", *_method_rules(templates, names, text))


def extract_datasets(df: DataFrame, templates=None, names=None, text: str = "source_text") -> DataFrame:
    return _entities(df, "DATASET", *_dataset_rules(templates, names, text))


def _metric_items(templates=None, text: str = "source_text") -> Column:
    """An array of (name, score), the first of each name."""
    s = F.coalesce(F.col(text), F.lit(""))
    pairs = F.concat(*[F.arrays_zip(F.regexp_extract_all(s, F.lit("(?i)" + p), F.lit(1)).alias("name"), F.regexp_extract_all(s, F.lit("(?i)" + p), F.lit(2)).alias("score")) for p in templates or lexicon.METRIC_TEMPLATES])
    return _first_of_each(pairs, "name")


def extract_metrics(df: DataFrame, templates=None, text: str = "source_text") -> DataFrame:
    """Metric names with their score if one follows; the first of each name."""
    rows = df.withColumn("__e", F.explode(_metric_items(templates, text)))
    score = F.nullif(F.col("__e.score"), F.lit(""))
    return rows.select(*df.columns, F.lit("METRIC").alias("entity_type"), F.col("__e.name").alias("entity_name"), score.alias("score_value"), F.when(score.isNotNull(), 0.92).otherwise(0.86).alias("confidence"), F.lit("regex_metric_template").alias("extraction_method"))


def extract_all(sentences: DataFrame, subtypes=None, future_work: list | None = None, results: list | None = None, methods: dict | None = None, datasets: dict | None = None, metrics: dict | None = None, **options) -> DataFrame:
    """All extractions of sentences (id, paper_id, source_text, section_name, ...), long form.

    The primary label gives a row unless it is OTHER; a detector adds a row where the primary label
    differs; a LIMITATION primary takes the detector's subtype and name; entities follow. Rules of
    the detectors and options of the entity extractors may be given, ``options`` are those of ``classify``.
    """
    # the primary label stays, as other branches ask for it
    base = detect_results(detect_future_work(detect_limitations(classify(_prepared(sentences, "source_text"), **options), subtypes), future_work), results)
    same = (F.col("label") == "LIMITATION") & F.col("subtype").isNotNull()
    none, fields = F.lit(None).cast("string"), ("limitation_subtype", "numerical_gain", "score_value")

    def row(kind, text, sure, method, **more):
        extra = [more.get(k, none).alias(k) for k in fields]
        return F.struct(kind.alias("extraction_type"), text.alias("extracted_text"), sure.cast("double").alias("confidence"), method.alias("extraction_method"), *extra)

    s, stripped, named = F.col("source_text"), F.col("__s"), F.concat(F.lit("limitation_detector_"), F.col("subtype"))
    # all rows of a sentence come from one pass over it
    found = F.array(
        F.when(F.col("label") != "OTHER", row(F.col("label"), s, F.col("confidence"), F.when(same, named).otherwise("scientific_classifier_baseline"), limitation_subtype=F.when(same, F.col("subtype")))),
        F.when(F.col("subtype").isNotNull() & (F.col("label") != "LIMITATION"), row(F.lit("LIMITATION"), stripped, F.col("lim_confidence"), named, limitation_subtype=F.col("subtype"))),
        F.when(F.col("fw_confidence").isNotNull() & (F.col("label") != "FUTURE_WORK"), row(F.lit("FUTURE_WORK"), stripped, F.col("fw_confidence"), F.lit("future_work_detector"))),
        F.when(F.col("res_confidence").isNotNull() & (F.col("label") != "RESULT"), row(F.lit("RESULT"), stripped, F.col("res_confidence"), F.lit("result_detector"), numerical_gain=F.col("numerical_gain"))),
    )
    of = lambda kind: lambda e: row(F.lit(kind), e["entity_name"], e["confidence"], e["extraction_method"])
    score = lambda e: F.nullif(e["score"], F.lit(""))
    metric = lambda e: row(F.lit("METRIC"), e["name"], F.when(score(e).isNotNull(), 0.92).otherwise(0.86), F.lit("regex_metric_template"), score_value=score(e))
    low = lambda given: F.col("__low") if (given or {}).get("text", "source_text") == "source_text" else None
    every = F.concat(F.filter(found, lambda x: x.isNotNull()), F.transform(_entity_items(*_method_rules(**(methods or {})), low(methods)), of("METHOD")), F.transform(_entity_items(*_dataset_rules(**(datasets or {})), low(datasets)), of("DATASET")), F.transform(_metric_items(**(metrics or {})), metric))
    return base.select("id", "paper_id", F.inline(every))


def count_types(df: DataFrame, column: str = "label", labels: list[str] | None = None) -> DataFrame:
    """Rows of each label, zero for labels that do not occur."""
    labels = labels or lexicon.LABELS
    known = df.sparkSession.createDataFrame([(k,) for k in labels], "extraction_type string")
    counts = df.groupBy(F.col(column).alias("extraction_type")).agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counts, "extraction_type", "left").select("extraction_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_extractions(extractions: DataFrame, column: str = "extraction_type", labels: list[str] | None = None) -> DataFrame:
    """(extraction_type, n, total) over all extraction rows, zero for types that do not occur; total leaves OTHER out."""
    counts = count_types(extractions, column, labels)
    return counts.withColumn("total", F.sum(F.when(F.col("extraction_type") != "OTHER", F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0))))  # a row a type


def filter_extractions(df: DataFrame, paper: int | None = None, kind: str | None = None) -> DataFrame:
    if paper is not None:
        df = df.where(F.col("paper_id") == paper)
    return df if kind is None else df.where(F.col("extraction_type") == kind)


def limitations_view(df: DataFrame) -> DataFrame:
    """Limitations with subtype, section and page, from provenance or by default."""
    p = lambda c, d: F.coalesce(F.col(f"provenance.{c}"), F.lit(d)).alias(c)
    return df.where("extraction_type = 'LIMITATION'").select("id", "paper_id", "extracted_text", "confidence", p("limitation_subtype", "generic"), p("section_name", "Unknown"), p("page_number", 1))


def future_work_view(df: DataFrame) -> DataFrame:
    p = lambda c, d: F.coalesce(F.col(f"provenance.{c}"), F.lit(d)).alias(c)
    return df.where("extraction_type = 'FUTURE_WORK'").select("id", "paper_id", "extracted_text", "confidence", p("section_name", "Unknown"), p("page_number", 1))


def prototype_classify(vectors: DataFrame, anchors: DataFrame, threshold: float = 0.52, id_col: str = "id") -> DataFrame:
    """(id, best, is_positive): the best cosine of each vector to the anchors, in blocks of both, and whether it reaches ``threshold``."""
    from lacuna.operators.vectors import knn_join

    named = anchors.withColumn("__anchor", F.xxhash64("embedding"))
    best = knn_join(vectors, named, 1, query_id=id_col, id_col="__anchor")
    return best.select(id_col, F.col("score").alias("best"), (F.col("score") >= threshold).alias("is_positive"))


def hybrid_decision(rule: Column, in_section: Column, best: Column) -> Column:
    """A rule hit, or a good cosine in a limitation section, or a better one anywhere."""
    return rule | (in_section & (best >= 0.50)) | (best >= 0.58)
