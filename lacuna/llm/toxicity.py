"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import below_share, cut, map_arrow, remainder

#: So many that words seldom share one; only the chosen buckets have weights.
BUCKETS = 1 << 28
#: Labelled documents that the machine is fitted on, at most (by a hash of the id).
MAX_TRAIN = 20_000
#: Numbers of terms with weights to choose from, by the log-loss on a part of the learning rows.
TERMS = (512, 1024, 2048, 4096)
#: One in so many of the learning rows is that part.
PART = 4
FACTORS = 8
STEPS = 80
THRESHOLD = 0.7
#: Pairs are penalised more than single terms, so that what one term shows is not left to pairs.
LINEAR_PENALTY, PAIR_PENALTY = 1e-6, 1e-3
#: Rows of the rarer kind weigh so many times more, at most.
MAX_BALANCE = 10.0
#: A term's first weight counts half if it stands in so many rows.
PRIOR_ROWS = 10
#: A term stands in so many distinct rows at least; rows with the same terms count once, so copies of one text choose none.
MIN_ROWS = 3
CACHE_WORDS = 500_000
WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> list[int]:
    """Hashed terms of a word: the word itself and its beginnings of 4, 5 and 6 letters."""
    terms = ["=" + word] + [f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return [zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """Distinct term buckets of the labelled documents that the machine learns from: n, y, b; one row an id.

    At most about ``max_train`` documents are drawn, by a threshold on a hash of the id.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("n")).agg(F.max(label_col).alias("y"))
    n = known.count()
    known = known.where(below_share(F.xxhash64("n"), max_train / max(1, n)))  # bounds what is broadcast

    def run(batches):
        for b in batches:
            found = [sorted({k for w in set(WORD.findall((t or "").lower())) for k in buckets(w)}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["n", "y", "b"])

    rows = docs.select(F.col(id_col).alias("n"), F.col(text_col).alias("t")).join(F.broadcast(known), "n").select(F.col("n").cast("long"), F.col("y").cast("int"), "t")
    terms = rows.transform(map_arrow, run, "n long, y int, b array<int>")
    return cut(terms.groupBy("n").agg(F.min(F.struct("y", "b")).alias("r")).select("n", "r.y", "r.b"), "terms")


class Machine:
    """Second-order factorization machine over chosen buckets, with a logistic output."""

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.index = {int(t): i for i, t in enumerate(terms)}
        self.bias, self.weight, self.factor = bias, weight, factor
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, text: str | None) -> list[int]:
        known, found = self.known, set()
        for w in set(WORD.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                own = known[w] = tuple(i for i in map(self.index.get, buckets(w)) if i is not None)
            if own:
                found.update(own)
        return sorted(found)

    def score(self, text: str | None) -> float:
        at = self.features(text)
        z = self.bias + self.weight[at].sum()
        if len(at) > 1:
            v = self.factor[at]
            z += 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: DataFrame, terms: int | tuple[int, ...] = TERMS, factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """Fit on rows (n, y, b): Spark counts the buckets, the driver learns over the chosen ones only.

    The buckets with the largest chi-square against the label are chosen among those in MIN_ROWS
    distinct rows. How many of them is chosen from ``terms``: machines learnt on three quarters of
    these rows are tried on the last, and the number with the least log-loss is taken for all rows.
    """
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = total["n"], total["p"]
    if not n or not p or p == n:
        share = (p + 0.5) / (n + 1)
        return Machine(np.empty(0, int), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, factors)))
    sizes = (terms,) if isinstance(terms, int) else tuple(sorted(terms))
    stats = rows.groupBy("b").agg(F.max("y").alias("y")).select("y", F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("df"), F.sum("y").alias("pos"))
    expected = F.col("df") * (p / n)
    chi = F.pow(F.col("pos") - expected, 2) / (expected * (1 - F.col("df") / F.lit(n + 1.0)))
    chosen = stats.where(F.col("df") >= MIN_ROWS).select("b", "df", "pos", chi.alias("chi")).orderBy(F.desc("chi"), "b").limit(sizes[-1]).collect()
    picked, df, pos = (np.array([r[c] for r in chosen], int) for c in ("b", "df", "pos"))  # the largest chi-square first
    keep = rows.sparkSession.createDataFrame([(int(t), i) for i, t in enumerate(picked)], "b int, i int")
    # rows are bounded by MAX_TRAIN, and each has so many chosen terms at most; ``keep`` by TERMS
    pairs = rows.select("n", "y", F.explode_outer("b").alias("b")).join(F.broadcast(keep), "b", "left")
    data = pairs.groupBy("n", "y", F.pmod(F.xxhash64("n"), F.lit(PART)).alias("part")).agg(F.array_sort(F.collect_list("i")).alias("i")).orderBy("n", "y").collect()
    y, tried = np.array([r["y"] for r in data], np.float32), np.array([r["part"] == 0 for r in data])
    # terms begin with most of their log-odds, so that one that is rarely alone counts on its own
    odds = np.log((pos + 0.5) / (p + 1)) - np.log((df - pos + 0.5) / (n - p + 1))
    first = (0.7 * df / (df + PRIOR_ROWS) * odds).astype(np.float32)
    # a number beyond the terms there are is the same as the next lower one
    sizes = sizes[: int(np.searchsorted(sizes, len(picked))) + 1]
    best = sizes[-1]
    if len(sizes) > 1 and len({*y[tried]}) == 2 == len({*y[~tried]}):
        losses = []
        for k in sizes:
            machine = descend([r["i"] for r in data if r["part"]], y[~tried], first[:k], factors, steps)
            z = reached(machine, Sparse([r["i"] for r in data if not r["part"]], len(first[:k])))[0]
            losses.append(float((balanced(y[tried]) * np.logaddexp(0, np.where(y[tried] == 1, -z, z))).sum()))
        best = sizes[int(np.argmin(losses))]
    bias, weight, factor = descend([r["i"] for r in data], y, first[:best], factors, steps)
    order = np.argsort(picked[:best])
    return Machine(picked[:best][order], float(bias[0]), weight[order].astype(float), factor[order].astype(float))


def balanced(y: np.ndarray) -> np.ndarray:
    """Row weights that add up to one, both kinds weighing alike unless one is very rare."""
    weight = np.where(y == 1, min(MAX_BALANCE, float((y == 0).sum() / max(1, (y == 1).sum()))), 1.0).astype(np.float32)
    return weight / weight.sum()


def reached(theta, x: Sparse):
    """The score of each row before the logistic function, and the sums of its factors."""
    bias, w, v = theta
    xv = x.dot(v)
    return bias + x.dot(w) + 0.5 * ((xv**2).sum(axis=1) - x.dot((v * v).sum(axis=1))), xv


def descend(columns: list[list[int]], y: np.ndarray, first: np.ndarray, factors: int, steps: int):
    """Bias, weights and factors by full-batch Adam on the regularised log-loss, from the weights ``first``; columns beyond them are left out."""
    x, weight = Sparse(columns, len(first)), balanced(y)
    p, n = float(y.sum()), len(y)
    theta = [np.array([np.log(p / (n - p))], np.float32), first.copy(), np.random.default_rng(7).normal(0, 0.05, (len(first), factors)).astype(np.float32)]
    means, squares = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        bias, w, v = theta
        z, xv = reached(theta, x)
        g = (1 / (1 + np.exp(-z)) - y) * weight
        gx = x.back(g)
        grads = [np.array([g.sum()]), gx + LINEAR_PENALTY * w, x.back(g[:, None] * xv) - gx[:, None] * v + PAIR_PENALTY * v]
        for i, grad in enumerate(grads):
            means[i] = 0.9 * means[i] + 0.1 * grad
            squares[i] = 0.999 * squares[i] + 0.001 * grad * grad
            theta[i] = theta[i] - 0.08 * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
    return theta


class Sparse:
    """A 0/1 matrix by the columns of each row's ones below ``width``, with products from both sides."""

    def __init__(self, columns: list[list[int]], width: int):
        self.shape = len(columns), width
        at = np.array([i for c in columns for i in c], np.int64)
        row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        self.at, self.row = at[at < width], row[at < width]

    def dot(self, v: np.ndarray) -> np.ndarray:
        flat = v.reshape(self.shape[1], -1)
        out = np.stack([np.bincount(self.row, flat[:, j][self.at], minlength=self.shape[0]) for j in range(flat.shape[1])], axis=1)
        return out.reshape(self.shape[0], *v.shape[1:])

    def back(self, g: np.ndarray) -> np.ndarray:
        flat = g.reshape(self.shape[0], -1)
        out = np.stack([np.bincount(self.at, flat[:, j][self.row], minlength=self.shape[1]) for j in range(flat.shape[1])], axis=1)
        return out.reshape(self.shape[1], *g.shape[1:])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Score every text (null: empty): id, the ``keep`` columns, score, predicted."""

    def run(batches):
        for b in batches:
            s = np.array([machine.score(t) for t in b.column("__text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (id_col, *keep)), pa.array(s), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[id_col, *keep, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col, *keep).schema)
    return docs.select(id_col, *keep, F.col(text_col).alias("__text")).transform(map_arrow, run, f"{fields}, score double, predicted int")


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, max_train: int = MAX_TRAIN) -> DataFrame:
    """Learn from labels outside the held-out fold and score all documents: id, held_out, score, predicted.

    Labels that repeat for an id count once, as toxic if any is; null labels and labels of
    absent documents are left out. Without labels of both kinds every score is the share of
    toxic ones. Empty and null texts are scored as texts without terms.
    """
    fold = remainder(id_col, folds)
    machine = fit(_sample(docs, labels.where(fold != held).select(id_col, label_col), id_col, text_col, label_col, max_train))
    return score(docs.withColumn("held_out", fold == held), machine, id_col, text_col, ("held_out",))
