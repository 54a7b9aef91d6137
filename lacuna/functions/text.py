"""Text functions over columns; all run in the JVM but for NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lacuna.functions import lexicon

INVISIBLE = "[\\u200B\\u200C\\u200D\\u200E\\u200F\\uFEFF\\u00AD\\u202A-\\u202E]"
DOT = "\ue000"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC; only texts with characters beyond ASCII go to Python."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfc(F.when(text.rlike("[^\\x00-\\x7F]"), text))).otherwise(text)


def fold_ligatures(text: Column) -> Column:
    for joined, letters in lexicon.LIGATURES.items():
        text = F.replace(text, F.lit(joined), F.lit(letters))
    return text


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z]{2,})-\\s*\\n\\s*([a-z]{2,})", "$1$2")


def drop_line_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "\\n\\s*\\d+\\s*\\n", "\n")


def normalize_ws(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return strip(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def clean_text(text: Column, unicode: bool = True) -> Column:
    """NFC, ligatures, invisible characters, hyphens, line numbers, white space; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return normalize_ws(drop_line_numbers(join_hyphens(strip_invisible(fold_ligatures(nfc(text) if unicode else text)))))


def normalize_sentence(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "\\s*\\n\\s*", " "), "\\s{2,}", " "))


def clean_paragraph(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(\\w+)-\\n(\\w+)", "$1$2"), "\\n+", " "), "\\s+", " "))


def title_case(text: Column) -> Column:
    """Every run of letters begins with a capital, also after a hyphen or a digit."""
    runs = F.regexp_extract_all(text, F.lit("[\\p{L}]+|[^\\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def slugify(text: Column, dash: str = "_", limit: int | None = 64) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), "[^\\p{L}\\p{N}_\\s\\p{Z}-]", ""), "[-\\s\\p{Z}]+", dash)
    return F.substring(slug, 1, limit) if limit else slug


#: Edges of words in any script, spelt out as ``\\b`` depends on the Java version.
BEFORE, AFTER = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"


def whole_words(text: Column, pattern: str) -> Column:
    """The words of a text in lower case that ``pattern`` describes from end to end."""
    return F.regexp_extract_all(F.lower(text), F.lit(BEFORE + pattern + AFTER), F.lit(0))


def words(text: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Distinct lower-case ASCII words of ``least`` letters or more, without stop words."""
    found = F.array_distinct(whole_words(text, f"[a-z]{{{least},}}"))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def token_overlap(a: Column, b: Column) -> Column:
    """The larger of Jaccard similarity and containment of two texts' word sets; 0 if one has none."""
    x, y = words(a, 3, lexicon.OVERLAP_STOP_WORDS), words(b, 3, lexicon.OVERLAP_STOP_WORDS)
    shared = F.size(F.array_intersect(x, y)).cast("double")
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(some, F.greatest(shared / F.size(F.array_union(x, y)), shared / F.least(F.size(x), F.size(y)))).otherwise(F.lit(0.0))


def protect_periods(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Replace periods that end no sentence by a private character: numbers, initials, abbreviations, citations."""
    dot = DOT
    text = F.regexp_replace(text, "(\\d)\\.(?=\\d)", f"$1{dot}")
    text = F.regexp_replace(text, BEFORE + "([A-Z])\\.\\s+(?=[A-Z])", f"$1{dot} ")
    for a in lexicon.ABBREVIATIONS if abbreviations is None else abbreviations:
        parts = a.split(".")[:-1]
        groups = "\\.".join("(" + p.replace(" ", "\\x20") + ")" for p in parts)
        text = F.regexp_replace(text, f"(?i){BEFORE}{groups}\\.", "".join(f"${n}{dot}" for n in range(1, len(parts) + 1)))
    return F.regexp_replace(text, "(\\[\\s*\\d+)\\.(\\s*\\d+\\])", f"$1{dot}$2")


def split_sentences(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Sentences of a cleaned text as an array: paragraphs, list items, then stops before a capital, digit or quote."""
    cut = "\u0001"
    protected = protect_periods(text, abbreviations)
    paragraphs = F.transform(F.split(protected, "\\n{2,}"), strip)
    item = "\\n\\s*(?:[-\u2022*]|\\(?\\d+[\\.\\)]|\\(?[a-zA-Z][\\.\\)])\\s+"
    listed = lambda p: p.rlike("\\n[-*\u2022] |\\n\\d+\\.\\s+")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(listed(p), F.transform(F.split(p, item), strip)).otherwise(F.array(p))))
    marked = lambda p: F.regexp_replace(p, "(?<=[.!?])(?:['\"\u201d\u2019)\\]]+)?\\s+(?=[A-Z\"\u201c'(\\[\\d\u2022\\-*])", cut)
    raw = F.flatten(F.transform(parts, lambda p: F.split(marked(p), cut)))
    whole = F.transform(raw, lambda s: normalize_sentence(F.replace(s, F.lit(DOT), F.lit("."))))
    return F.filter(whole, lambda s: (F.char_length(s) > 3) & s.rlike("[\\p{L}\\p{N}]"))


def estimate_page(start: Column, end: Column, paragraph: Column, paragraphs: Column) -> Column:
    """Page of a paragraph, spread evenly over the section's pages, halves to even."""
    many = (end > start) & (paragraphs > 1)
    return F.when(many, start + F.bround(paragraph / F.when(paragraphs > 1, paragraphs - 1) * (end - start)).cast("int")).otherwise(start)
