"""Positions, ranks and rank statistics by ordered parts against plain loops; one group that holds all rows is spread."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import ranks, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    data = [("all", float(rng.integers(40)) / 4, float(rng.integers(60)) / 8) for _ in range(600)] + [(None, 1.0, 2.0), (None, 2.0, 1.0), ("one", 3.0, 4.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("gap", None, 1.0)]
    return spark.createDataFrame(data, "g string, x double, y double"), data


def mean_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def groups(data):
    for g in {r[0] for r in data}:
        own = [(x, y) for k, x, y in data if k == g and x is not None and y is not None]
        if own:
            yield g, [x for x, _ in own], [y for _, y in own]


def test_positions_run_through_the_parts(spark):
    data = [("a", i * 37 % 1000, i % 5) for i in range(1000)] + [("b", 1, 7), (None, 3, None), (None, 2, 4)]
    df = spark.createDataFrame(data, "g string, o long, w long").repartition(5)
    got = {(r["g"], r["o"]): (r["position"], r["before_w"]) for r in ranks.positions(df, ["g"], ["o"], ["w"]).collect()}
    for g in ("a", "b", None):
        before = 0
        for n, (_, o, w) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: r[1]), 1):
            assert got[g, o] == (n, before)
            before += w or 0
    down = ranks.positions(df.where("g = 'a'"), [], [F.desc("o")]).select("o", "position").collect()
    assert all(r["position"] == 1000 - r["o"] for r in down)
    part = df.withColumn("p", F.floor(F.col("o") / 100))
    assert {(r["g"], r["o"]): (r["position"], r["before_w"]) for r in ranks.positions(part, ["g"], ["o"], ["w"], part="p").collect()} == got
    assert ranks.positions(df.where("false"), ["g"], ["o"], ["w"]).count() == 0


def test_one_group_lies_in_all_parts(spark):
    df = ranks.ranged(spark.range(4000).select(F.lit("hot").alias("g"), "id"), ["g", "id"], 8)
    sizes = [r["count"] for r in df.groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_average_ranks_share_ties(rows):
    df, data = rows
    got = {(r["g"], r["x"]): r["rank"] for r in ranks.average_ranks(df.where("x is not null"), ["g"], "x").collect()}
    for g, x, _ in groups(data):
        assert all(abs(got[g, v] - r) < 1e-9 for v, r in zip(x, mean_ranks(x)))


def test_spearman_and_kendall(rows):
    df, data = rows
    rho = {r["g"]: r["rho"] for r in stats.spearman(df, ["g"]).collect()}
    tau = {r["g"]: r["tau"] for r in stats.kendall(df, ["g"]).collect()}
    for g, x, y in groups(data):
        rx, ry = mean_ranks(x), mean_ranks(y)
        if len(set(x)) == 1 or len(set(y)) == 1:
            assert rho[g] is None and tau[g] is None
            continue
        assert abs(rho[g] - np.corrcoef(rx, ry)[0, 1]) < 1e-9
        s = nx = ny = 0
        for i, j in itertools.combinations(range(len(x)), 2):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
        assert abs(tau[g] - s / math.sqrt(nx * ny)) < 1e-9
    whole = stats.kendall(df.where("g = 'all'"), []).first()["tau"]
    assert abs(whole - tau["all"]) < 1e-12
    assert stats.kendall(df.where("false"), ["g"]).count() == 0 == stats.spearman(df.where("false"), ["g"]).count()


def test_wilcoxon_sums(rows):
    df, data = rows
    got = {r["g"]: r for r in stats.wilcoxon(df, ["g"]).collect()}
    for g, x, y in groups(data):
        d = [a - b for a, b in zip(x, y) if a != b]
        r = mean_ranks([abs(v) for v in d])
        up, down = sum(k for v, k in zip(d, r) if v > 0), sum(k for v, k in zip(d, r) if v < 0)
        assert (got[g]["n"], got[g]["w_plus"], got[g]["w_minus"]) == (len(d), up, down) and 0 <= got[g]["p_value"] <= 1
