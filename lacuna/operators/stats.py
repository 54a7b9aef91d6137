"""Evaluation statistics per group: Spark aggregates, an Arrow function over the groups adds tails and quantiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lacuna.operators.ranks import average_ranks, positions


def confusion(df: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """(by, gold, pred, n) with zeros for pairs of labels that do not occur."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "gold string, pred string")
    groups = df.select(*by).distinct().crossJoin(F.broadcast(grid))  # labels squared
    counts = df.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    return groups.join(counts, [*by, "gold", "pred"], "left").na.fill(0, ["n"])


def class_metrics(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class from a confusion matrix."""
    per = lambda c, name: matrix.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(name))
    tp = matrix.where("gold = pred").select(*by, F.col("gold").alias("label"), F.col("n").alias("tp"))
    r = tp.join(per("pred", "predicted"), [*by, "label"]).join(per("gold", "support"), [*by, "label"])
    p, q = ratio("tp", "predicted"), ratio("tp", "support")
    return r.withColumns({"precision": p, "recall": q}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def macro(classes: DataFrame, by: list[str]) -> DataFrame:
    return classes.groupBy(*by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def binary_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, TN, FN of 0/1 columns gold and pred."""
    n = lambda g, p: F.sum(((F.col("gold") == g) & (F.col("pred") == p)).cast("long"))
    return df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))


def binary_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    c = binary_counts(df, by).withColumns({"pp": F.col("tp") + F.col("fp"), "gp": F.col("tp") + F.col("fn")})
    c = c.withColumns({"precision": ratio("tp", "pp"), "recall": ratio("tp", "gp")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.withColumns({"f1": f1, "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))}).drop("pp", "gp")


def subtype_accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of right subtypes among true positives (gold, pred, gold_subtype, pred_subtype)."""
    return df.where("gold = 1 and pred = 1").groupBy(*by).agg(F.avg((F.col("gold_subtype") == F.col("pred_subtype")).cast("double")).alias("subtype_accuracy"))


#: Chances that a Poisson draw of mean one is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])


def poisson_draws(rows: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row (a 64-bit hash) counts in each resample: seeded draws from a mix of row and resample."""
    with np.errstate(over="ignore"):
        x = rows.view(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), "right")


def bootstrap_ci(df: DataFrame, value: str, by: list[str], resamples: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: each row counts as often as a seeded draw per resample says.

    A task draws for its own rows, batch by batch, and gives the sums of each group and resample;
    a row is never sent for each resample. Rows are told apart by the column ``row``; null values
    are left out; a resample that draws no row has no mean.
    """

    def run(frames):
        for f in frames:
            for key, own in f.groupby(by, dropna=False):
                count, total = np.zeros(resamples), np.zeros(resamples)
                for at in range(0, len(own), 1024):
                    part = own.iloc[at : at + 1024]
                    t = poisson_draws(part["__h"].to_numpy(), resamples)
                    count += t.sum(axis=0)
                    total += part["__v"].to_numpy() @ t
                out = pd.DataFrame({k: [v] * resamples for k, v in zip(by, key)})
                yield out.assign(r=np.arange(resamples), total=total, times=count)

    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), F.xxhash64("row").alias("__h"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    sums = rows.mapInPandas(run, f"{fields}, r int, total double, times double")
    means = sums.groupBy(*by, "r").agg(F.try_divide(F.sum("total"), F.sum("times")).alias("m"))
    return means.groupBy(*by).agg(F.expr(f"percentile(m, {low})").alias("low"), F.expr(f"percentile(m, {high})").alias("high"))


def _erfc_chi(x: float) -> float:
    return math.erfc(math.sqrt(x / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, n: float) -> float:
    """Two-sided tail of Student's t with n degrees of freedom."""
    return _beta_fraction(n / 2, 0.5, n / (n + t * t))


def t_quantile(p: float, n: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, n) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def chi_p(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _erfc_chi(v) if v == v else float("nan"))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) if a == a and b > 0 else float("nan") for a, b in zip(t, n)])


@F.pandas_udf(DoubleType())
def t_q(n: pd.Series) -> pd.Series:
    return n.map(lambda v: t_quantile(0.975, v) if v > 0 else float("nan"))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def one(a, b, c, d):
        log = lambda x: math.lgamma(x + 1)
        r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
        p = lambda k: math.exp(log(r1) - log(k) - log(r1 - k) + log(r2) - log(c1 - k) - log(r2 - c1 + k) - log(n) + log(c1) + log(n - c1))
        own = p(a)
        return min(1.0, sum(q for q in map(p, range(max(0, c1 - r2), min(r1, c1) + 1)) if q <= own * (1 + 1e-7)))

    return pd.Series([one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])


def mcnemar(df: DataFrame, by: list[str]) -> DataFrame:
    """Continuity-corrected statistic and p-value of two methods' correctness (right_a, right_b)."""
    n = lambda c: F.sum(c.cast("long"))
    a = df.groupBy(*by).agg(n(F.col("right_a") & ~F.col("right_b")).alias("b"), n(~F.col("right_a") & F.col("right_b")).alias("c"))
    stat = F.when(F.col("b") + F.col("c") > 0, F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2.0) / (F.col("b") + F.col("c"))).otherwise(0.0)
    return a.withColumn("statistic", stat).withColumn("p_value", chi_p("statistic"))


def paired_t(df: DataFrame, by: list[str]) -> DataFrame:
    """t statistic and p-value of paired differences (x, y)."""
    d = F.col("x") - F.col("y")
    a = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return a.withColumn("statistic", t).withColumn("p_value", t_p("statistic", F.col("n") - 1))


def signed_rank_p(ranks: list[float], smaller: float) -> float:
    """Two-sided p-value of a signed-rank sum: exact without ties up to 50 values, else normal with the tie correction."""
    n = len(ranks)
    if n <= 50 and len(set(ranks)) == n:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for total in range(len(ways) - 1, r - 1, -1):
                ways[total] += ways[total - r]
        return min(1.0, 2 * sum(ways[: int(smaller) + 1]) / 2**n)
    return normal_p(n, sum(r * r for r in ranks), smaller)


def normal_p(n: int, squares: float, smaller: float) -> float:
    """Normal tail of a signed-rank sum; the squared ranks carry the tie correction, as their sum is four times the variance."""
    return math.erfc(abs(smaller - n * (n + 1) / 4) / math.sqrt(squares / 4) / math.sqrt(2)) if squares else 1.0


@F.pandas_udf(DoubleType())
def signed_rank(n: pd.Series, ties: pd.Series, squares: pd.Series, smaller: pd.Series) -> pd.Series:
    exact = lambda m, t: m <= 50 and not t
    return pd.Series([signed_rank_p(list(range(1, int(m) + 1)), w) if exact(m, t) else normal_p(int(m), q, w) for m, t, q, w in zip(n, ties, squares, smaller)], dtype=float)


def wilcoxon(df: DataFrame, by: list[str]) -> DataFrame:
    """Signed-rank sums of paired values (x, y) without zero differences, the smaller of them and its p-value.

    Equal absolute differences are counted before they are ranked, so no group meets in one task.
    """
    rows = df.withColumn("d", F.col("x") - F.col("y")).where("d <> 0").withColumn("a", F.abs("d"))
    cells = rows.groupBy(*by, "a").agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    r = F.col("before_n") + (F.col("n") + 1) / 2.0
    a = positions(cells, by, ["a"], ["n"]).withColumn("r", r).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * F.col("r")).alias("w_minus"),
        F.sum(F.col("n") * F.col("r") * F.col("r")).alias("__q"), (F.sum("n") - F.count("*")).alias("__t"),
    )
    a = a.withColumn("statistic", F.least("w_plus", "w_minus"))
    return a.withColumn("p_value", signed_rank("n", "__t", "__q", "statistic")).drop("__q", "__t")


def mean_ci(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, standard error and the 95 % t interval."""
    a = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    a = a.withColumn("q", t_q(F.col("n") - 1))
    return a.withColumns({"low": F.col("mean") - F.col("q") * F.col("se"), "high": F.col("mean") + F.col("q") * F.col("se")}).drop("q")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, by keys that may be null."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"__r_{k}" for k in keys])


def spearman(df: DataFrame, by: list[str]) -> DataFrame:
    """Rank correlation of the columns x and y in each group, rows with a null left out; null where one is constant.

    Equal (x, y) are counted first; the values of both columns are ranked in one pass over their counts.
    """
    cells = df.where("x is not null and y is not null").groupBy(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("c"))
    both = cells.select(*by, "c", F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("value")) for k in ("x", "y")])))
    ranks = average_ranks(both.withColumnRenamed("c", "n"), [*by, "side"], "value", "n")
    of = lambda side: ranks.where(F.col("side") == side).select(*by, F.col("value").alias(side), F.col("rank").alias(f"r{side}"))
    rows = _same(_same(cells, of("x"), [*by, "x"]), of("y"), [*by, "y"])
    sums = {k: F.sum(F.col("c") * v) for k, v in {"n": F.lit(1.0), "sx": F.col("rx"), "sxx": F.col("rx") * F.col("rx"), "syy": F.col("ry") * F.col("ry"), "sxy": F.col("rx") * F.col("ry")}.items()}
    a = rows.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    middle = F.col("n") * ((F.col("n") + 1) / 2) * ((F.col("n") + 1) / 2)  # mean ranks are (n + 1) / 2 on both sides
    vx, vy = F.col("sxx") - middle, F.col("syy") - middle
    return a.select(*by, F.when((vx > 0) & (vy > 0), (F.col("sxy") - middle) / F.sqrt(vx * vy)).alias("rho"))


def kendall(df: DataFrame, by: list[str]) -> DataFrame:
    """Tau-b of the columns x and y in each group, rows with a null left out; null where one of them is constant.

    Equal (x, y) are counted first. Each pair of cells is then told apart at the highest bit in which the
    ranks of their x differ: among cells with one prefix, running sums in the order of y say how many without
    the bit lie below one with it. A cell is a row for each bit, and running sums go by parts, so
    a group that holds all rows is spread over all tasks.
    """
    known = df.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    xs = positions(known.select(*by, "x").distinct(), by, ["x"]).select(*by, "x", (F.col("position") - 1).alias("r"))
    bits = int(xs.agg(F.max("r")).first()[0] or 0).bit_length()
    cells = _same(known, xs, [*by, "x"])
    squares = lambda key, name: known.groupBy(*by, key).agg(F.sum("c").cast("double").alias("n")).groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias(name))
    pairs = _same(squares("x", "qx"), squares("y", "qy").drop("all"), by) if by else squares("x", "qx").join(squares("y", "qy").drop("all"), F.lit(True))
    if bits:
        at = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
        keyed = at.withColumn("upper", F.expr("shiftright(r, bit) & 1")).withColumn("prefix", F.expr("shiftright(r, bit + 1)"))
        levels = keyed.groupBy(*by, "bit", "prefix", "y").agg(F.sum(F.when(F.col("upper") == 0, F.col("c")).otherwise(0)).alias("low"), F.sum(F.when(F.col("upper") == 1, F.col("c")).otherwise(0)).alias("high"))
        run = positions(levels, [*by, "bit", "prefix"], ["y"], ["low"])
        # for each cell: those below less those above = 2 before + own level - all
        found = run.groupBy(*by, "bit", "prefix").agg(F.sum(F.col("high").cast("double") * (2 * F.col("before_low") + F.col("low"))).alias("s"), F.sum("high").cast("double").alias("h"), F.sum("low").cast("double").alias("l"))
        score = found.groupBy(*by).agg(F.sum(F.col("s") - F.col("h") * F.col("l")).alias("s"))
        pairs = _same(pairs, score, by) if by else pairs.join(score, F.lit(True))
    else:
        pairs = pairs.withColumn("s", F.lit(0.0))
    differ = lambda q: (F.col("all") * F.col("all") - F.col(q)) / 2
    product = differ("qx") * differ("qy")
    return pairs.select(*by, F.when(product > 0, F.col("s") / F.sqrt(product)).alias("tau"))


def kappa(matrix: DataFrame, by: list[str]) -> DataFrame:
    total = matrix.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("agree"))
    gold = matrix.groupBy(*by, F.col("gold").alias("k")).agg(F.sum("n").alias("__g"))
    pred = matrix.groupBy(*by, F.col("pred").alias("k")).agg(F.sum("n").alias("__p"))
    e = gold.join(pred, [*by, "k"]).groupBy(*by).agg(F.sum(F.col("__g") * F.col("__p")).alias("e"))
    po, pe = F.col("agree") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return total.join(e, by).select(*by, F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def fisher(df: DataFrame, by: list[str]) -> DataFrame:
    """Two-sided exact p-value of the 2 x 2 table of gold and pred."""
    return binary_counts(df, by).withColumn("p_value", fisher_p("tp", "fp", "fn", "tn"))


def metric_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def segmentation_check(sentences: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against actual sentences of each document (doc_id), and whether they agree."""
    actual = sentences.groupBy("doc_id").agg(F.count("*").alias("actual"))
    both = expected.join(actual, "doc_id", "full").na.fill(0, ["expected", "actual"])
    return both.withColumn("passed", F.col("expected") == F.col("actual"))
