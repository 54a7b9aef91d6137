"""Structure of papers from layout blocks: reading order, title, abstract, authors, sections, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.text import clean_paragraph, strip, title_case

YEAR = "\\b(19\\d{2}|20[0-2]\\d)\\b"
DOI = "\\b(10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+)"
REFERENCE_SECTIONS = ["References", "Bibliography"]


def reading_order(blocks: DataFrame) -> DataFrame:
    """``position`` of each block in its page: full-width, left and right columns if both have two blocks, else by line and x."""
    mid = F.col("page_width") / 2
    kind = (
        F.when((F.col("x0") < mid * 0.7) & (F.col("x1") > mid * 1.3), 0).when(F.col("x1") <= mid + 20, 1).when(F.col("x0") >= mid - 20, 2).otherwise(0)
    )
    page = Window.partitionBy("paper_id", "page")
    rows = blocks.withColumn("kind", kind).withColumns({"nl": F.sum((F.col("kind") == 1).cast("int")).over(page), "nr": F.sum((F.col("kind") == 2).cast("int")).over(page)})
    columns = (F.col("nl") >= 2) & (F.col("nr") >= 2)
    first = F.when(columns, F.col("kind").cast("double")).otherwise(F.bround(F.col("y0") / 10) * 10)
    second = F.when(columns, F.col("y0")).otherwise(F.col("x0"))
    ordered = rows.withColumn("position", F.row_number().over(page.orderBy(first, second, "block_no")))
    return ordered.drop("kind", "nl", "nr")


def detect_title(blocks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(paper_id, title): the largest block in the upper part of page 1 before the abstract, else the metadata's, else a fixed one."""
    text, paper = strip(F.col("text")), Window.partitionBy("paper_id")
    page1 = blocks.where("page = 1").withColumn("t", text)
    stop = F.min(F.when(F.col("t").rlike("(?i)^\\s*abstract\\b") & (F.col("y0") <= F.col("page_height") * 0.45), F.col("position"))).over(paper)
    rows = page1.withColumn("stop", stop).where("y0 <= page_height * 0.45 and (stop is null or position < stop) and char_length(t) >= 4")
    rows = rows.where(~F.col("t").rlike("(?i)^(proceedings|doi:|arxiv:|issn|isbn|vol\\.|volume|journal|ieee|acm)"))
    best = rows.groupBy("paper_id").agg(F.max_by("t", F.struct("font_size", -F.col("position"))).alias("best"))
    best = best.withColumn("best", strip(F.regexp_replace("best", "\\s+", " ")))
    out = blocks.select("paper_id").distinct().join(best, "paper_id", "left")
    if meta is not None:
        out = out.join(meta.select("paper_id", F.trim("meta_title").alias("m")), "paper_id", "left")
        usable = F.when((F.char_length("m") > 3) & ~F.col("m").endswith(".pdf"), F.col("m"))
    else:
        usable = F.lit(None).cast("string")
    return out.select("paper_id", F.coalesce(F.when(F.char_length("best") >= 5, F.col("best")), usable, F.lit("Untitled Paper")).alias("title"))


def lines_of(blocks: DataFrame) -> DataFrame:
    """Lines of blocks in reading order: paper_id, page, position, line."""
    return blocks.select("paper_id", "page", "position", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def detect_abstract(blocks: DataFrame) -> DataFrame:
    """(paper_id, abstract): from the abstract's line to introduction, keywords or index terms, on the first two pages."""
    start, stop = "(?i)^\\s*abstract[\\s:.—-]*(.*)$", "(?i)^(?:(?:1\\.|I\\.)\\s+)?(?:introduction|keywords|index terms)\\b"
    rows = lines_of(blocks.where("page <= 2")).withColumn("l", strip(F.col("line"))).withColumn("at", F.struct("page", "position", "line_no"))
    paper = Window.partitionBy("paper_id")
    rows = rows.withColumn("first", F.min(F.when(F.col("l").rlike(start), F.col("at"))).over(paper))
    rows = rows.withColumn("last", F.min(F.when(F.col("l").rlike(stop) & (F.col("at") > F.col("first")), F.col("at"))).over(paper))
    inside = rows.where("first is not null and at >= first and (last is null or at < last)").withColumn("s", F.when(F.col("l").rlike(start), F.regexp_extract("l", start, 1)).otherwise(F.col("l")))
    whole = inside.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("x"))
    return whole.select("paper_id", strip(F.regexp_replace(F.array_join(F.transform("x", lambda v: v["s"]), " "), "\\s+", " ")).alias("abstract"))


def detect_authors(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(paper_id, authors): names between title and abstract, lines of affiliations and addresses left out."""
    rows = blocks.where("page = 1").join(titles, "paper_id").withColumn("t", strip(F.col("text")))
    paper = Window.partitionBy("paper_id")
    rows = rows.withColumn("at", F.min(F.when(F.col("t").contains(F.col("title")) | F.col("title").contains(F.col("t")), F.col("position"))).over(paper))
    rows = rows.withColumn("stop", F.min(F.when(F.col("t").rlike("(?i)^\\s*(abstract|introduction)\\b") & (F.col("position") > F.col("at")), F.col("position"))).over(paper))
    own = rows.where("position > at and (stop is null or position < stop)").select("paper_id", "position", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    own = own.where(~F.col("line").contains("@") & ~F.col("line").rlike("(?i)\\b(university|institute|department|college|lab|email)\\b"))
    names = own.select("paper_id", "position", "n", F.posexplode(F.split("line", ",|\\band\\b|;")).alias("k", "raw")).withColumn("name", strip(F.regexp_replace("raw", "[\\d*†‡§]", "")))
    names = names.where(F.size(F.split("name", "\\s+")).between(2, 4) & (F.length("name") > 0) & ~F.lower("name").contains("abstract"))
    return names.groupBy("paper_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "n", "k", "name"))), lambda x: x["name"])).alias("authors"))


def detect_year(text: Column, meta_date: Column | None = None) -> Column:
    """Year by a cue on page 1, else by the metadata's date, else the first plausible one."""
    cue = F.regexp_extract(text, "(?i)(?:©|copyright|published|proceedings|arxiv:[\\d.]+|vol\\.)[^\\n\\r]*\\b(19\\d{2}|20[0-2]\\d)\\b", 1)
    any_ = F.filter(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1950, 2027))
    meta = F.regexp_extract(F.coalesce(meta_date, F.lit("")), "(19\\d{2}|20[0-2]\\d)", 1) if meta_date is not None else F.lit("")
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    return F.coalesce(number(cue), number(meta), F.get(any_, F.lit(0)))


def detect_doi(text: Column, *more: Column) -> Column:
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), DOI, 1), F.lit("")) for c in (text, *more)]
    return F.coalesce(*found)


def section_header(line: Column, names: list[str] | None = None) -> Column:
    """The section name that a line states, in title case, or null; a number may stand before, text after a stop or blank."""
    names = lexicon.KNOWN_SECTIONS if names is None else names
    s, known = strip(line), "|".join(names)
    found = F.regexp_extract(s, f"(?i)^(?:(?:\\d+(?:\\.\\d+)*|[IVX|]+(?:\\.[A-Z])?)\\.?\\s+)?({known})(?:[:.\\s].*)?$", 1)
    return F.when((F.char_length(s) <= 75) & (found != ""), title_case(F.lower(found)))


def sectionize(blocks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sections of papers: blocks after a header belong to it until the next; references are marked.

    A running count of headers numbers the sections (gaps and islands); blocks before the first
    header are left out.
    """
    order = Window.partitionBy("paper_id").orderBy("page", "position")
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    rows = blocks.withColumn("header", section_header(first_line, names)).withColumn("section_order", F.sum(F.col("header").isNotNull().cast("int")).over(order))
    rows = rows.where("section_order > 0")
    body = F.when(F.col("header").isNotNull(), F.regexp_replace("text", "^[^\\n]*\\n?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("body", clean_paragraph(body)).withColumn("at", F.struct("page", "position"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), lambda t: F.length(t) > 0)
    s = rows.groupBy("paper_id", "section_order").agg(F.max("header").alias("section_name"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), parts.alias("paragraphs"))
    return s.withColumns({"content": F.array_join("paragraphs", "\n\n"), "is_reference": F.col("section_name").isin(*REFERENCE_SECTIONS)})


def split_references(df: DataFrame, id_col: str = "paper_id", text_col: str = "text") -> DataFrame:
    """(id, ref_index, raw_text): entries of a bibliography by [n] or n. marks, else its lines longer than 15 letters."""
    mark = "\u0001"
    marked = F.regexp_replace(text_col, "(?:^|\\n)\\s*(?:\\[(\\d+)\\]|(\\d+)\\.)\\s*", f"{mark}$1$2\u0002")
    entries = F.filter(F.split(marked, mark), lambda e: e.contains("\u0002"))
    numbered = F.transform(entries, lambda e: F.struct(F.substring_index(e, "\u0002", 1).cast("int").alias("ref_index"), strip(F.substring_index(e, "\u0002", -1)).alias("raw_text")))
    lines = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("ref_index"), strip(x).alias("raw_text")))
    chosen = F.when(F.size(entries) > 0, F.filter(numbered, lambda r: F.length(r["raw_text"]) > 0)).otherwise(F.filter(lines, lambda r: F.char_length(r["raw_text"]) > 15))
    return df.select(F.col(id_col), F.explode(chosen).alias("r")).select(id_col, "r.ref_index", "r.raw_text")


def parse_reference(raw: Column) -> Column:
    """A struct of normalised text, first year and quoted title."""
    text = strip(F.regexp_replace(raw, "\\s+", " "))
    year = F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).try_cast("int")
    title = F.nullif(F.trim(F.regexp_extract(text, "[\"“]([^\"”]+)[\"”]", 1)), F.lit(""))
    return F.struct(text.alias("raw_text"), year.alias("year"), title.alias("title"))
