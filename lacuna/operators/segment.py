"""Sentences of papers, with their provenance and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text as T


def paragraphs(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, section_order, section_name, paragraph_id, paragraph, page_number) of all papers.

    A section without paragraphs gives its content as one, a paper without sections its abstract.
    """
    parts = F.when(F.size(F.coalesce("paragraphs", F.array().cast("array<string>"))) > 0, F.col("paragraphs")).otherwise(F.array("content"))
    own = sections.select("paper_id", "section_order", "section_name", "page_start", "page_end", parts.alias("parts"))
    rest = papers.select(F.col("id").alias("paper_id"), "abstract").join(sections.select("paper_id"), "paper_id", "left_anti").where(F.length("abstract") > 0)
    own = own.unionByName(rest.select("paper_id", F.lit(0).alias("section_order"), F.lit("Abstract").alias("section_name"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array("abstract").alias("parts")))
    rows = own.select("*", F.posexplode("parts").alias("paragraph_id", "paragraph"), F.size("parts").alias("n"))
    page = T.estimate_page(F.col("page_start"), F.col("page_end"), F.col("paragraph_id"), F.col("n"))
    return rows.select("paper_id", "section_order", "section_name", "paragraph_id", "paragraph", page.alias("page_number"))


def split_paragraphs(rows: DataFrame, abbreviations: list[str] | None = None, splitter=None) -> DataFrame:
    """One row a sentence of ``paragraph``, numbered in it (part)."""
    split = splitter or (lambda p: T.split_sentences(T.clean_text(p), abbreviations))
    return rows.select(*[c for c in rows.columns if c != "paragraph"], F.posexplode(split(F.col("paragraph"))).alias("part", "source_text"))


def number_sentences(rows: DataFrame) -> DataFrame:
    """Global order per paper over section, paragraph and sentence, beginning with 1."""
    order = Window.partitionBy("paper_id").orderBy("section_order", "paragraph_id", "part")
    return rows.withColumn("sentence_order", F.row_number().over(order))


def segment_papers(papers: DataFrame, sections: DataFrame, abbreviations: list[str] | None = None) -> DataFrame:
    return number_sentences(split_paragraphs(paragraphs(papers, sections), abbreviations))
