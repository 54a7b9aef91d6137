"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with the path of the table, for ``discard`` when nothing needs it any more."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that Spark itself uses for its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table; over all cores where its scan would give fewer tasks than that, as a file of one row group does."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ["*"])
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of BATCH_BYTES at most, so that neither side holds many texts at once.

    The bound is the session's setting for all Arrow batches; a lower one of the user's stays.
    """
    conf = df.sparkSession.conf
    had = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not had.isdigit() or int(had) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def below_share(key, share: float):
    """Whether a 64-bit hash lies in the lowest ``share`` of its range: a sample that any size of table can take."""
    return F.lit(True) if share >= 1 else key < F.lit(-(1 << 63) + int(share * (1 << 64))).cast("long")


def remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; an id that is null gives 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def majority(hashes) -> int:
    """The SimHash of unsigned 64-bit hashes: a bit is one if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = np.array(hashes[i : i + (1 << 15)], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")
