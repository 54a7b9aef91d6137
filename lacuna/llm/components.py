"""Connected components over an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut_at, discard


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Return (node, label), label being the smallest node of its component.

    Labels and edges stay in Spark; the driver sees one count a round. Every round takes
    the smallest label among a node and its neighbours and then follows the label's own
    label, so chains shorten about twofold; rounds go on until no label changes. Each round is
    written to the shared folder and the table of the round before is deleted.
    """
    spark = edges.sparkSession
    both, edges_path = cut_at(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .unionByName(edges.select(F.col(dst).alias("u"), F.col(src).alias("v")))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    labels, path = cut_at(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped, next_path = cut_at(hooked.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        discard(spark, path)
        labels, path = jumped.select("node", "label"), next_path
        if jumped.where("label <> old").isEmpty():
            discard(spark, edges_path)
            return labels
