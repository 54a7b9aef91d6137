"""Readers and writers: entity tables, nested JSON, raw files, vectors, results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPERS = "id bigint, title string, doi string, abstract string, authors array<string>, publication_year int, venue string, file_hash string, file_size int, page_count int"
SECTIONS = "paper_id bigint, section_name string, section_order int, page_start int, page_end int, content string, paragraphs array<string>"
REFERENCES = "paper_id bigint, ref_index int, raw_text string, title string, year int"
SENTENCES = "id bigint, paper_id bigint, paragraph_id int, sentence_order int, source_text string, section_name string, page_number int"
EXTRACTIONS = "id bigint, paper_id bigint, sentence_id bigint, extraction_type string, extracted_text string, confidence double, extraction_method string, provenance struct<paper_id:bigint,section_name:string,page_number:int,limitation_subtype:string>"
BLOCKS = "paper_id bigint, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, page_width double, page_height double"
SCHEMAS = {"papers": PAPERS, "sections": SECTIONS, "references": REFERENCES, "sentences": SENTENCES, "extractions": EXTRACTIONS, "blocks": BLOCKS}
MAX_FILE_BYTES = 25 * 1024 * 1024


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in spark.checkpoint.dir; a local session without it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to scratch and read back: its lineage is cut, and what chance decided in it stays as it is."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, name: str | None = None, key: str | None = None) -> DataFrame:
    """A Parquet table with its declared schema if it has one; in key order if a key is given."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    df = reader.parquet(path)
    return df.orderBy(key) if key else df


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and relevance rows of a nested JSON benchmark."""
    schema = "corpus array<struct<id:bigint,paper_id:bigint,sentence_id:bigint,paper_title:string,year:int,section:string,page:int,extraction_type:string,text:string>>, queries array<struct<query_id:string,query:string,relevant_sentence_ids:array<bigint>,relevant_paper_ids:array<bigint>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    queries = raw.select(F.inline("queries"))
    return raw.select(F.inline("corpus")), queries.select("query_id", "query"), queries.select("query_id", F.explode("relevant_sentence_ids").alias("id"))


def land_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with path, size, hash and content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), "content")


def file_fault(path: Column, size: Column, content: Column, mime: Column | None = None, extension: str = ".pdf", magic: bytes = b"%PDF-", most: int = MAX_FILE_BYTES) -> Column:
    """The first reason to reject a file, or null."""
    rules = [(~F.lower(path).endswith(extension), "invalid_extension")]
    if mime is not None:
        rules.append((~mime.isin("application/pdf", "application/x-pdf", "application/octet-stream"), "invalid_mime_type"))
    rules += [(size == 0, "empty_file"), (size > most, "file_too_large"), (F.substring(content, 1, len(magic)) != F.lit(magic), "invalid_signature")]
    chosen = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        chosen = chosen.when(test, name)
    return chosen


def validate_files(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Good files, and quarantined ones with their reason."""
    mime = F.col("mime_type") if "mime_type" in df.columns else None
    marked = df.withColumn("reason", file_fault(F.col("path"), F.col("file_size"), F.col("content"), mime, **options))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def dedupe_by_hash(new: DataFrame, existing: DataFrame | None, key: str, order: str) -> DataFrame:
    """New rows whose key is not there yet, the first of each key."""
    if existing is not None:
        new = new.join(existing.select(key), key, "left_anti")
    first = Window.partitionBy(key).orderBy(order)
    return new.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def metadata_hash(title: Column, doi: Column, year: Column) -> Column:
    """SHA-256 of title, doi and year for records without a file; nulls read None."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("_", text(title), text(doi), text(year)), 256)


def replace_by_key(target: DataFrame, updates: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Rows of the updated keys replaced; running it again changes nothing. With ``tasks`` keys meet in so many tasks."""
    old, keys = target, updates.select(key)
    if tasks is not None:
        old, keys = target.repartition(tasks, key), keys.repartition(tasks, key)
    return old.join(keys.distinct(), key, "left_anti").select(*target.columns).unionByName(updates)


def page(df: DataFrame, order: list[str], skip: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def children(df: DataFrame, parent: int, order: str, key: str = "paper_id") -> DataFrame:
    return df.where(F.col(key) == parent).orderBy(order)


def assemble_papers(papers: DataFrame, sections: DataFrame, references: DataFrame) -> DataFrame:
    """Papers with their ordered sections and references nested; a paper's own must fit one row."""
    nest = lambda df, order, name: df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in ("paper_id", order)]))).alias(name)).withColumnRenamed("paper_id", "id")
    return papers.join(nest(sections, "section_order", "sections"), "id", "left").join(nest(references, "ref_index", "references"), "id", "left")


def search_papers(papers: DataFrame, q: str | None = None, year: int | None = None, topic: int | None = None, topics: DataFrame | None = None) -> DataFrame:
    """Papers whose title, venue or an author contains the text, of a year, of a topic."""
    if q:
        low = q.lower()
        hit = F.lower("title").contains(low)
        if "venue" in papers.columns:
            hit = hit | F.coalesce(F.lower("venue").contains(low), F.lit(False))
        if "authors" in papers.columns:
            hit = hit | F.coalesce(F.exists("authors", lambda a: F.lower(a).contains(low)), F.lit(False))
        papers = papers.where(hit)
    if year is not None:
        papers = papers.where(F.col("publication_year") == year)
    if topic is not None and topics is not None:
        papers = papers.join(topics.where(F.col("topic_id") == topic).select(F.col("paper_id").alias("id")), "id", "left_semi")
    return papers


def paper_years(papers: DataFrame) -> DataFrame:
    return papers.select("publication_year").where("publication_year is not null").distinct().orderBy(F.desc("publication_year"))


def save_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, dim: int | None = None, count: int | None = None, column: str = "embedding") -> DataFrame:
    """Saved vectors; a wrong dimension or number of rows is an error."""
    df = spark.read.parquet(path)
    if dim is not None or count is not None:
        found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.size(column) != dim, 1).otherwise(0)), F.lit(0)).alias("wrong")).first()
        if dim is not None and found["wrong"] or count is not None and found["n"] != count:
            raise ValueError(f"{path} holds {found['n']} vectors, {found['wrong']} of them not of dimension {dim}")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan would give fewer tasks than that, as a file of one row group does.

    Scans of many files keep their partitions, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session held to BATCH_BYTES, so that no worker holds many texts; a lower bound of the user's stays."""
    conf = df.sparkSession.conf
    had = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not had.isdigit() or int(had) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` over small batches."""
    return small_batches(df).mapInArrow(run, schema)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that Spark itself uses for its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
