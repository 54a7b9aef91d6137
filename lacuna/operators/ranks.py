"""Positions and running sums in groups of any size: ordered parts, totals per part, offsets.

A window over a group runs in one task. Here the order is cut into parts, every part is counted,
the counts before each part are added up, and only the rows of one (group, part) meet in a task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.sources.tables import stored


def ranged(df: DataFrame, order: Sequence[str | Column], parts: int | None = None, name: str = "ranged") -> DataFrame:
    """``df`` with ``__part``, the number of its range in the order; equal rows share a part.

    Ranges are sampled anew for every plan, so the rows are written once with the number they got.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), name)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str] = (), part: str | None = None) -> DataFrame:
    """Adds ``position`` (from 1) in the group ``by`` and, for each column c of ``sums``, ``before_c``: its sum over the rows before.

    ``part`` names a column that follows the order already; else the order is cut into ranges of
    (by, order), so a group that holds all rows is spread over all parts. Null keys are a group of
    their own; null values count as zero; rows that tie get different positions. The table that
    holds the offsets has a row for each part of a group.
    """
    by, sums = list(by), list(sums)
    if part is None:
        df, part = ranged(df, [*by, *order]), "__part"
    totals = df.groupBy(*by, part).agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{c}") for c in sums])
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate([*by, part])]
    offsets = totals.select(*keys, zero("__n").alias("__n"), *[zero(f"__s_{c}").alias(f"__s_{c}") for c in sums])
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*by, part])])
    w = Window.partitionBy(*by, part).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.join(offsets, same).withColumn("position", F.col("__n") + F.row_number().over(w))
    rows = rows.withColumns({f"before_{c}": F.col(f"__s_{c}") + F.coalesce(F.sum(c).over(run), F.lit(0)) for c in sums})
    return rows.drop(*[f"__k{i}" for i in range(len(keys))], "__n", "__part", *[f"__s_{c}" for c in sums])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(by, value, n, rank): how often each value occurs in its group and the mean rank of its rows.

    Rows stand for ``weight`` rows each if it is given. Equal values are counted before they are ordered, so
    neither a hot group nor a hot value meets in one task.
    """
    counts = df.groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return positions(counts, by, [value], ["n"]).select(*by, value, "n", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))
