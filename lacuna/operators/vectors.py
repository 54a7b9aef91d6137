"""Dense vectors: hashed embedding, norms, exact and approximate nearest neighbours."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lacuna.sources.tables import map_batches, small_batches

#: Queries and vectors of one pair of blocks.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384
#: Queries that are multiplied with a block of vectors at a time.
SLICE = 256
#: Texts, and sentences, that are embedded at a time.
TEXTS, SENTENCES = 256, 1024
#: Type of a hashed embedding of up to 32,767 entries without its zeros.
HASHED_PAIRS = "struct<place:array<smallint>,weight:array<double>,length:double>"
#: Vectors that the cells of the approximate index are fitted on, at most about.
MAX_FIT = 20_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A vector of length one; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def check_dim(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector is null or of another length than ``dim``."""
    return df.where(F.col(column).isNull() | (F.size(column) != dim))


def require_dim(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``df``, failing at run time on a vector of another length."""
    right = F.size(column) == dim
    return df.withColumn(column, F.when(right, F.col(column)).otherwise(F.raise_error(F.lit(f"vector length is not {dim}"))))


@lru_cache(50_000)
def _beginning(letters: str, dim: int) -> int:
    return int(hashlib.md5(letters.encode()).hexdigest()[:8], 16) % dim


def _sha_buckets(texts: list[bytes], dim: int) -> np.ndarray:
    """The bucket of each text: the first four bytes of its SHA-256."""
    return (np.frombuffer(b"".join([hashlib.sha256(t).digest() for t in texts]), ">u4")[::8] % dim).astype(np.int64)


def hashed_weights(texts: list[str | None], dim: int = 384) -> np.ndarray:
    """A row of weights a text: hashed words, beginnings and pairs of words, weighted by place; without words all are zero.

    Words are what blanks part, in lower case; a pair weighs as its second word does. Words and pairs of all
    texts are numbered first, so each distinct one is hashed once; weights are added up as arrays.
    """
    parts = [(t or "").lower().split() for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(parts)), np.int64, lengths.sum())
    words = list(numbers)
    if not words:
        return np.zeros((len(texts), dim))
    row = np.repeat(np.arange(len(texts)), lengths)
    place = 1.0 / (1.0 + 0.05 * (np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)))
    raw = [w.encode() for w in words]
    whole, start = _sha_buckets(raw, dim), np.array([_beginning(w[:4], dim) if len(w) > 3 else -1 for w in words], np.int64)
    long = start[at] >= 0
    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    pairs, which = np.unique(at[second - 1] * len(words) + at[second], return_inverse=True)
    first = [w + b"_" for w in raw]
    hashed = _sha_buckets([first[a] + raw[b] for a, b in zip((pairs // len(words)).tolist(), (pairs % len(words)).tolist())], dim)
    cells = np.concatenate([row * dim + whole[at], (row * dim + start[at])[long], row[second] * dim + hashed[which]])
    weights = np.concatenate([1.5 * place, 0.75 * place[long], 2.0 * place[second]])
    return np.bincount(cells, weights, len(texts) * dim).reshape(len(texts), dim)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def hashed_rows(texts: list[str | None], dim: int = 384) -> np.ndarray:
    """``hashed_weights`` of unit length; without words all are zero."""
    own = hashed_weights(texts, dim)
    return own / _lengths(own)


def hashed_terms(df: DataFrame, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """(id, bucket, w): the sparse form of the hashed embedding; texts without words give no rows."""

    def run(batches):
        for b in (whole.slice(i, TEXTS) for whole in batches for i in range(0, whole.num_rows, TEXTS)):
            own = hashed_rows(b.column(1).to_pylist(), dim)
            at, bucket = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(bucket, pa.int32()), pa.array(own[at, bucket], pa.float64())], names=["id", "bucket", "w"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, bucket int, w double")


def hashed_pairs(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 384) -> DataFrame:
    """``df`` with the hashed embedding in place of the text, a sentence or a paragraph: the places that are not zero, in order, their weights, and the vector's length.

    An entry of the embedding is weight / length. Weights as they are repeat from text to text, so a file holds each once.
    """
    kept = [c for c in df.columns if c != text_col]

    def run(batches):
        for b in (whole.slice(i, SENTENCES) for whole in batches for i in range(0, whole.num_rows, SENTENCES)):
            own = hashed_weights(b.column(len(kept)).to_pylist(), dim)
            row, place = np.nonzero(own)
            starts = pa.array(np.searchsorted(row, np.arange(len(own) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in (place.astype(np.int16), own[row, place])]
            vectors = pa.StructArray.from_arrays([*lists, pa.array(_lengths(own)[:, 0])], names=["place", "weight", "length"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], names=[*kept, out_col])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(df.select(*kept, text_col), run, f"{schema}, `{out_col}` {HASHED_PAIRS}")


def hashing_model(dim: int = 384):
    """The hashed embedding as a model for ``embed_with``; a text without words is the zero vector."""
    return lambda texts: hashed_rows(texts, dim).astype(np.float32)


def hash_embed(df: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 384) -> DataFrame:
    """(id, embedding): the dense hashed embedding of every text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return embed_with(rows, lambda: hashing_model(dim), "t").drop("t")


def embed_with(df: DataFrame, load, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Embed by a model: ``load()`` runs once a worker and gives a function from texts to vectors."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            # vectors stay arrays, a slice of the texts at a time: as lists of numbers they take eight times the room
            parts = (model(texts.iloc[i : i + TEXTS].fillna("").tolist()) for i in range(0, len(texts), TEXTS))
            yield pd.Series([np.array(v, np.float32) for part in parts for v in part], dtype=object)

    return small_batches(df).withColumn(out_col, embed(F.col(text_col)))


def evidence_filter(df: DataFrame, paper_id=None, extraction_type=None, section=None, year=None, min_year=None, max_year=None) -> DataFrame:
    """Metadata filters, applied before ranking; a null year passes no year filter."""
    if paper_id is not None:
        df = df.where(F.col("paper_id") == paper_id)
    if extraction_type is not None:
        df = df.where(F.upper("extraction_type") == extraction_type.upper())
    if section is not None:
        df = df.where(F.lower("section").contains(section.lower()))
    for value, test in ((year, "="), (min_year, ">="), (max_year, "<=")):
        if value is not None:
            df = df.where(f"year {test} {int(value)}")
    return df


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """The k nearest by cosine to one query vector; ties go to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = norm(F.col(column)) * norm(q)
    score = F.when(length > 0, dot(F.col(column), q) / length).otherwise(0.0)
    scored = vectors.withColumn("score", F.round(F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0)), 4))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.astype(float).reshape(table.num_rows, -1))


def _blocked(df: DataFrame, key: str, column: str, name: str, rows: int) -> tuple[DataFrame, int]:
    """(key, v, block): vectors dealt to blocks of about ``rows`` by a hash of the key; null vectors are left out."""
    own = df.where(F.col(column).isNotNull()).select(F.col(key).alias(name), F.col(column).alias(f"{name}_v"))
    blocks = -(-own.count() // rows) or 1
    return own.withColumn(f"{name}_b", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")), blocks


def _block_pairs(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _best(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The best k vectors of each query of two blocks; ties, to 12 places, go to the smaller id."""
    vectors = vectors.sort_by("id")
    q, v, out = _matrix(queries, "query_v"), _matrix(vectors, "id_v"), []
    for i in range(0, len(q), SLICE):
        raw = q[i : i + SLICE] @ v.T
        if 4 * k < raw.shape[1] and not np.isnan(raw).any():
            # only what comes near the k-th best is rounded, ordered and handed on
            least = np.partition(raw, raw.shape[1] - k, axis=1)[:, -k] - 1e-11
            row, col = np.nonzero(raw >= least[:, None])
            s = np.clip(np.round(raw[row, col], 12), -1, 1)
            order = np.lexsort((col, -s, row))
            row, col, s = row[order], col[order], s[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            names = queries.column("query").slice(i, len(raw)).take(pa.array(row[best]))
            out.append(pa.table([names, vectors.column("id").take(pa.array(col[best])), pa.array(s[best])], names=["query", "id", "score"]))
            continue
        scores = np.clip(np.round(raw, 12), -1, 1)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        names = queries.column("query").slice(i, len(scores)).take(pa.array(np.repeat(np.arange(len(scores)), top.shape[1])))
        out.append(pa.table([names, vectors.column("id").take(pa.array(top.ravel())), pa.array(np.take_along_axis(scores, top, 1).ravel())], names=["query", "id", "score"]))
    return pa.concat_tables(out)


def _top(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, query_id: str, id_col: str) -> DataFrame:
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return _best(left, right, k)
        return pa.table([pa.nulls(0, left.schema.field("query").type), pa.nulls(0, right.schema.field("id").type), pa.nulls(0, pa.float64())], names=["query", "id", "score"])

    parts = _block_pairs(queries, vectors, keys, run, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", column: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query by cosine, over all vectors: query_id, id, score, rank.

    Both sides are dealt to blocks; each pair of blocks meets in one task, which keeps its best k
    for each query by matrix products; a window merges them. Memory is bounded by two blocks.
    """
    q, n = _blocked(queries, query_id, column, "query", QUERY_BLOCK)
    v, m = _blocked(vectors, id_col, column, "id", VECTOR_BLOCK)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    return _top(q.withColumn("id_b", every(m)), v.withColumn("query_b", every(n)), ["query_b", "id_b"], k, query_id, id_col)


def _forest(a: pa.Table, b: pa.Table, least: float, same: bool) -> list[tuple[int, int]]:
    """Places (in a, in b) of links that connect what all links of two blocks connect."""
    x, y = _matrix(a, "id_v"), _matrix(b, "id_v")
    root = list(range(len(x) + (0 if same else len(y))))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for at in range(0, len(x), SLICE):
        left, right = np.nonzero(np.round(x[at : at + SLICE] @ y.T, 12) >= least)
        for i, j in zip((left + at).tolist(), right.tolist()):
            r, s = find(i), find(j if same else len(x) + j)
            if r != s:
                root[max(r, s)] = min(r, s)
                out.append((i, j))
    return out


def neighbour_links(vectors: DataFrame, least: float, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(source, target): links of cosine ``least`` or more that connect all vectors such links connect.

    Each pair of blocks meets in one task, which goes through all its links and keeps a spanning
    forest of them, so dense groups give few rows and no link is capped.
    """
    v, m = _blocked(vectors, id_col, column, "id", QUERY_BLOCK)
    others = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other")
    pairs = v.select("id", "id_v", "id_b", others).select("id", "id_v", "id_b", F.least("id_b", "other").alias("p"), F.greatest("id_b", "other").alias("q"))
    kind = v.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = _forest(left, right if right.num_rows else left, least, not right.num_rows) if left.num_rows else []
        i, j = (pa.array([x[n] for x in links], pa.int64()) for n in (0, 1))
        return pa.table([left.column("id").take(i), (right if right.num_rows else left).column("id").take(j)], names=["source", "target"])

    return _block_pairs(pairs.where("id_b = p"), pairs.where("id_b = q and p < q"), ["p", "q"], run, f"source {kind}, target {kind}").where("source <> target")


def fit_cells(vectors: DataFrame, cells: int, column: str = "embedding", seed: int = 42) -> np.ndarray:
    """Centres of an index: k-means over about MAX_FIT unit vectors at most, drawn by a hash of the vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = vectors.where(F.col(column).isNotNull())
    share = MAX_FIT / max(1, known.count())
    drawn = known if share >= 1 else known.where(F.xxhash64(column) < F.lit(-(1 << 63) + int(share * (1 << 64))).cast("long"))
    rows = drawn.select(array_to_vector(l2_normalize(F.col(column))).alias("v"))
    return _unit(np.array(KMeans(k=cells, seed=seed, featuresCol="v").fit(rows).clusterCenters()))


def _to_cells(df: DataFrame, centres: np.ndarray, probes: int, column: str) -> DataFrame:
    """Add ``cell``: a row for each of the ``probes`` nearest cells of a vector."""
    from pyspark.sql.types import IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        scores = _unit(np.array(vectors.tolist(), float)) @ centres.T
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return df.withColumn("cell", F.explode(nearest(F.col(column))))


def _cell_blocks(asked: DataFrame, filed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers ``asked_b`` and ``filed_b``, copied so that the blocks of a cell meet in pairs.

    A cell has as many blocks as its own rows fill, so a hot one meets in many tasks and others are not copied.
    """
    count = lambda df, block, out: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(out))
    sizes = count(asked, QUERY_BLOCK, "qn").join(count(filed, VECTOR_BLOCK, "vn"), "cell")  # a row a cell
    own = lambda df, key, n, out: df.withColumn(out, F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
    every = lambda df, n, out: df.withColumn(out, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop("qn", "vn")
    left = every(own(asked.join(F.broadcast(sizes), "cell"), name, "qn", "asked_b"), "vn", "filed_b")
    return left, every(own(filed.join(F.broadcast(sizes), "cell"), "id", "vn", "filed_b"), "qn", "asked_b")


def cell_count(n: int) -> int:
    """Cells of an index over n vectors: about the square root, 8 to 1024."""
    return int(min(1024, max(8, round(n**0.5))))


def _drawn(df: DataFrame, most: int, column: str) -> DataFrame:
    """About ``most`` rows at most, drawn by a hash of the vector."""
    share = most / max(1, df.count())
    return df if share >= 1 else df.where(F.xxhash64(column) < F.lit(-(1 << 63) + int(share * (1 << 64))).cast("long"))


def _home_ranks(x: np.ndarray, y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For unit vectors x and y, row by row: the how-manieth cell of x's order is the one that y is filed in."""
    home = np.argmax(y @ centres.T, axis=1)
    order = x @ centres.T
    own = order[np.arange(len(x)), home]
    before = (order > own[:, None]) | ((order == own[:, None]) & (np.arange(len(centres)) < home[:, None]))
    return before.sum(axis=1)


def _enough(counts: dict[int, int], cells: int, target: float) -> int:
    """The least number of cells within which ``target`` of the counted neighbours lie."""
    total, seen = sum(counts.values()), 0
    for rank in range(cells):
        seen += counts.get(rank, 0)
        if seen >= target * total:
            return rank + 1
    return cells


def probes_for(vectors: DataFrame, centres: np.ndarray, k: int, target: float, id_col: str = "id", column: str = "embedding", sample: int = 400) -> int:
    """Cells to look into so that ``target`` of the k nearest are found, measured on about ``sample`` vectors against all."""
    own = vectors.where(F.col(column).isNotNull())
    truth = knn_join(_drawn(own, sample, column).withColumnRenamed(id_col, "__q"), own, k + 1, "__q", id_col, column).where(F.col("__q") != F.col(id_col))
    vector = lambda key, name: own.select(F.col(id_col).alias(key), F.col(column).alias(name))

    @F.pandas_udf("int")
    def rank(q: pd.Series, v: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype="int32")
        return pd.Series(_home_ranks(_unit(np.array(q.tolist(), float)), _unit(np.array(v.tolist(), float)), centres).astype("int32"))

    pairs = truth.join(vector("__q", "__x"), "__q").join(vector(id_col, "__y"), id_col)
    counts = pairs.select(rank("__x", "__y").alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()  # a row a cell
    return _enough({r["r"]: r["n"] for r in counts}, len(centres), target)


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", column: str = "embedding", cells: int | None = None, probes: int | None = None, target: float = 0.95) -> DataFrame:
    """Neighbours from an inverted file: each query looks into the ``probes`` nearest of ``cells`` cells, ranked by exact cosine.

    The cells are fitted on a bounded sample, every vector is filed. Without ``probes`` they are chosen so
    that a sample of vectors finds the share ``target`` of its true neighbours; about probes / cells of all pairs
    are looked at. On vectors without clusters that comes near to all of them, on clustered ones it is a few hundredths.
    """
    centres = fit_cells(vectors, cells or cell_count(vectors.count()), column)
    probes = probes or probes_for(vectors, centres, k, target, id_col, column)
    kept = lambda df, key, name: df.where(F.col(column).isNotNull()).select(F.col(key).alias(name), F.col(column).alias(f"{name}_v"))
    filed = _to_cells(kept(vectors, id_col, "id"), centres, 1, "id_v")
    asked = _to_cells(kept(queries, query_id, "query"), centres, probes, "query_v")
    left, right = _cell_blocks(asked, filed, "query")
    return _top(left, right, ["cell", "asked_b", "filed_b"], k, query_id, id_col)


def near_links(vectors: DataFrame, least: float, id_col: str = "id", column: str = "embedding", cells: int | None = None, target: float = 0.95, sample: int = 400) -> DataFrame:
    """``neighbour_links`` without all pairs: links are looked for in the nearest cells of each vector only.

    How many cells is measured: for about ``sample`` vectors all links are counted by the cell in which the
    other end is filed, and as many cells are taken as hold the share ``target`` of them. A link is found from
    either end, so more than that share is. ``neighbour_links`` is the exact way.
    """
    own = vectors.where(F.col(column).isNotNull())
    centres = fit_cells(own, cells or cell_count(own.count()), column)
    v, m = _blocked(own, id_col, column, "id", VECTOR_BLOCK)
    drawn = _drawn(own, sample, column).select(F.col(id_col).alias("query"), F.col(column).alias("query_v")).withColumn("id_b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(len(centres), np.int64)
        if left.num_rows and right.num_rows:
            x, y = _matrix(left, "query_v"), _matrix(right, "id_v")
            for at in range(0, len(x), 16):
                i, j = np.nonzero(np.round(x[at : at + 16] @ y.T, 12) >= least)
                for part in range(0, len(i), 1 << 14):
                    found += np.bincount(_home_ranks(x[i[part : part + (1 << 14)] + at], y[j[part : part + (1 << 14)]], centres), minlength=len(centres))
        return pa.table([pa.array(np.arange(len(centres)), pa.int32()), pa.array(found)], names=["r", "n"])

    counts = _block_pairs(drawn, v, ["id_b"], measure, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()  # a row a cell
    # two at least, or a border through a cluster would part it
    probes = max(2, _enough({r["r"]: r["n"] for r in counts}, len(centres), target))
    slim = v.select("id", "id_v")
    asked = _to_cells(slim.select(F.col("id").alias("query"), F.col("id_v").alias("query_v")), centres, probes, "query_v")
    left, right = _cell_blocks(asked, _to_cells(slim, centres, 1, "id_v"), "query")
    kind = v.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = _forest(left.rename_columns(["id_v" if c == "query_v" else c for c in left.column_names]), right, least, False) if left.num_rows and right.num_rows else []
        i, j = (pa.array([x[n] for x in links], pa.int64()) for n in (0, 1))
        return pa.table([left.column("query").take(i), right.column("id").take(j)], names=["source", "target"])

    return _block_pairs(left, right, ["cell", "asked_b", "filed_b"], run, f"source {kind}, target {kind}").where("source <> target")


def evidence_units(sentences: DataFrame, extractions: DataFrame, papers: DataFrame) -> DataFrame:
    """Sentences and extractions as units of evidence, blanks dropped, places inherited from the sentence."""
    s = sentences.select(F.concat(F.lit("s"), F.col("id")).alias("unit_id"), "paper_id", F.col("id").alias("sentence_id"), F.lit("SENTENCE").alias("extraction_type"), F.col("source_text").alias("text"), "section_name", "page_number")
    place = sentences.select(F.col("id").alias("sentence_id"), "section_name", "page_number")
    e = extractions.join(place, "sentence_id", "left").select(F.concat(F.lit("e"), F.col("id")).alias("unit_id"), "paper_id", "sentence_id", "extraction_type", F.col("extracted_text").alias("text"), "section_name", "page_number")
    both = s.unionByName(e).where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    named = both.join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"), F.col("publication_year").alias("year")), "paper_id", "left")
    return named.withColumns({"section": F.coalesce("section_name", F.lit("Unknown")), "page": F.coalesce("page_number", F.lit(1))}).drop("section_name", "page_number")


def embed_collection(units: DataFrame) -> DataFrame:
    """Evidence units of each paper, and all of them."""
    return units.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_distinct("sentence_id").alias("sentences"))


def store_stats(vectors: DataFrame, column: str = "embedding", group: str = "paper_id") -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.max(F.size(column)).alias("dimension"), F.count_distinct(group).alias("documents"))
