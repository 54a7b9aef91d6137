"""Fixed questions to the graph: who addresses, extends, uses, supports or contradicts what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def papers_by_relation(edges: DataFrame, relation: str, target: str) -> DataFrame:
    """Edges of papers with a relation to a node: who addresses a limitation or extends a method."""
    return edges.where((F.col("relationship") == relation) & (F.col("target") == target) & F.col("source").startswith("paper:"))


def claims_by_relation(edges: DataFrame, relation: str, target: str) -> DataFrame:
    """Edges of any node with a relation to a claim: what supports or contradicts it."""
    return edges.where((F.col("relationship") == relation) & (F.col("target") == target))


def methods_for_dataset(edges: DataFrame, dataset: str) -> DataFrame:
    """Methods of the papers that use a dataset, once each."""
    papers = edges.where(F.col("target") == dataset).select("source").distinct()
    return edges.where(F.col("target").startswith("method:")).join(papers, "source", "left_semi").select(F.col("target").alias("method")).distinct()


def topic_papers(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    own = edges.where((F.col("relationship") == "belongs_to") & (F.col("target") == f"topic:{topic}")).select(F.col("source").alias("id"), "confidence")
    return nodes.join(own, "id")


def limitation_papers(edges: DataFrame, limitation: str, roles: tuple[str, ...] = ("limited_by", "addresses")) -> DataFrame:
    """Papers limited by a limitation and papers addressing it, marked by role."""
    return edges.where((F.col("target") == limitation) & F.col("relationship").isin(*roles)).withColumn("role", F.col("relationship"))


def directions(edges: DataFrame, source: str, relation: str, limitation: str, prefix: str = "direction:") -> DataFrame:
    """Direct targets of a node, and the directions of the papers that share its limitation."""
    direct = edges.where((F.col("source") == source) & (F.col("relationship") == relation)).select(F.col("target").alias("direction"), F.lit("direct").alias("link"))
    papers = edges.where(F.col("target") == limitation).select("source")
    same = edges.where(F.col("target").startswith(prefix)).join(papers, "source").select(F.col("target").alias("direction"), F.lit("same_paper").alias("link"))
    return direct.unionByName(same)


def find_nodes(nodes: DataFrame, q: str, kind: str | None = None) -> DataFrame:
    """Nodes by exact id, by the end of the id, or by text in label or an alias."""
    low = q.lower()
    hit = (F.col("id") == q) | F.col("id").endswith(q) | F.lower("label").contains(low) | F.exists("aliases", lambda a: F.lower(a).contains(low))
    found = nodes.where(hit)
    return found if kind is None else found.where(F.col("type") == kind)


def limitation_context(edges: DataFrame, limitation: str) -> DataFrame:
    return method_context(edges, limitation, ("limited_by", "addresses"))


def method_context(edges: DataFrame, target: str, roles: tuple[str, ...] = ("proposes", "uses", "extends")) -> DataFrame:
    """Papers of each role towards a node, with their number of edges."""
    own = edges.where((F.col("target") == target) & F.col("relationship").isin(*roles))
    return own.groupBy(F.col("relationship").alias("role")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("paper_id")).alias("papers"))
