"""Documents to packed sequences: language, near-duplicates, benchmark passages, personal data, packing.

Every stage takes what the one before it kept, whole. Null texts count as empty, very long texts are
read whole, further columns pass through whatever their names, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import decontaminate, langid, packing, pii, simhash
from lacuna.llm.common import cut


#: Languages that the packed corpus is made for.
LANGUAGES = ("de", "en", "es", "fr")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which one of LANGUAGES prevails.

    Null texts and texts without letters go; rows that repeat an id or a text are judged each, alike.
    """
    return langid.keep_known(docs, languages=LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of five-word Jaccard similarity 0.8 or more.

    Equal texts, empty ones included, are one component; of rows that repeat an id one stays, rows without an id all stay.
    """
    return simhash.keep_one(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a benchmark passage, up to a tenth of its letters edited.

    Rows that repeat an id go or stay together; rows without an id stay; passages that are null or short match nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets and count the characters anew; all rows stay, null texts stay null."""
    return pii.redact(docs, pii.train(docs), count_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 2048 tokens.

    An empty text is its end token; rows that repeat an id are packed each; ties between pieces go by id and start.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: Learnt models and tokenizers have no SQL form; tests/llm checks the rows stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
