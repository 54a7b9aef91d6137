"""Language identification by a multilingual mixture over character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import below_share, map_arrow, remainder

UNKNOWN = "und"
DIM = 1 << 15
SEGMENT = 24
ROUNDS = 12
PRIOR = 0.05
#: Labelled documents that the n-gram tables are learnt from, at most about; languages share it evenly.
MAX_TRAIN = 20_000
#: Bytes of text that a task works on in one go.
BLOCK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def _table() -> np.ndarray:
    """ASCII letters in lower case and bytes of other characters stay; all else becomes a space."""
    t = np.arange(256, dtype=np.uint32)
    t[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)]
    return t


def codes(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text in lower case, a space before and after it; a long text is hashed BLOCK bytes at a time."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    out = []
    for at in range(0, max(1, len(b) - 2), BLOCK):
        x = _TABLE[b[at : at + BLOCK + 2]]
        word = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        word = word[(x[1:-1] != 32) | (x[2:] != 32)]
        out.append(((word * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int16))
    return np.concatenate(out) if len(out) > 1 else out[0]


def segment_logs(codes_: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihoods of segments, which begin at ``bounds``: a row each, the table looked up for BLOCK codes or so at a time."""
    out = np.empty((len(bounds), table.shape[1]), np.float32)
    step = BLOCK // SEGMENT
    for i in range(0, len(bounds), step):
        own = bounds[i : i + step]
        stop = bounds[i + step] if i + step < len(bounds) else len(codes_)
        out[i : i + step] = np.add.reduceat(table[codes_[own[0] : stop]], own - own[0], axis=0)
    return out


_TABLE = _table()


def has_letters(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihood tables (DIM x languages), from labelled documents.

    Rows come from at most about ``max_train`` documents, drawn by a hash of the id; every language
    gets an equal part of them, a rare one all its documents. Their n-grams are counted in Spark
    and the driver gets one row a language and n-gram hash.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    drawn = F.lit(False)
    for lang, n in sorted(sizes.items()):
        drawn = drawn | ((F.col(lang_col) == F.lit(lang)) & below_share(F.xxhash64(id_col), max_train / len(sizes) / n))
    rows = rows.where(drawn)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letters(text):
                    c = codes(text)
                    counts[lang] = counts.get(lang, 0) + np.bincount(c, minlength=DIM)
        for lang, c in counts.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "code", "n"])

    found = rows.select(F.col(lang_col), F.col(text_col)).transform(map_arrow, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((DIM, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[own["code"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32) if langs else table


def _em(seg: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Language shares of each document and their log-likelihood; segments (rows) belong to documents."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(np.append(starts, len(seg)))[:, None]
    for _ in range(rounds):
        r = seg * share[doc]
        total = r.sum(axis=1)
        r /= total[:, None]
        share = (np.add.reduceat(r, starts, axis=0) + PRIOR) * allowed / (n + PRIOR * allowed.sum(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    return share, np.add.reduceat(np.log((seg * share[doc]).sum(axis=1)), starts)


def mixtures(texts: list[str], table: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """For each text its language shares within the chosen set, and that set, as 0/1 rows.

    A text is cut into segments of SEGMENT n-grams, each drawn from one language; expectation
    maximisation estimates the shares. The set is the one of the k most frequent languages whose
    likelihood, less ``penalty`` times half the logarithm of the segments for each further
    language, is best.
    """
    parts = [codes(t) for t in texts]
    cuts = [np.arange(0, len(p), SEGMENT) for p in parts]
    offsets = np.cumsum([0] + [len(p) for p in parts[:-1]])
    bounds = np.concatenate([c + o for c, o in zip(cuts, offsets)])
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
    starts = np.cumsum([0] + [len(c) for c in cuts[:-1]])
    log = segment_logs(np.concatenate(parts), bounds, table).astype(np.float64)
    top = log.max(axis=1, keepdims=True)
    seg = np.exp(np.maximum(log - top, -600))
    n = np.array([len(c) for c in cuts])
    langs = table.shape[1]
    share, _ = _em(seg, doc, starts, np.ones((len(texts), langs)), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    chosen = (rank == 0).astype(float)
    best = np.add.reduceat(np.log(np.maximum((seg * chosen[doc]).sum(axis=1), 1e-260)), starts)
    final = chosen.copy()
    todo = np.nonzero(share.max(axis=1) < 0.995)[0]
    for k in range(2, langs + 1):
        if not len(todo):
            break
        rows = np.concatenate([np.arange(starts[d], starts[d] + n[d]) for d in todo])
        own = np.repeat(np.arange(len(todo)), n[todo])
        at = np.cumsum(np.append(0, n[todo][:-1]))
        allowed = (rank[todo] < k).astype(float)
        part, like = _em(seg[rows], own, at, allowed, ROUNDS)
        value = like - penalty * (k - 1) * 0.5 * np.log(n[todo] + 1)
        better = value > best[todo]
        best[todo[better]], chosen[todo[better]], final[todo[better]] = value[better], allowed[better], part[better]
        todo = todo[better]
    return final, chosen


def guess(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], list[float], list[list[str]]]:
    """Predicted language, its share, and the chosen set of each text, worked on in blocks of BLOCK characters."""
    pred, score, sets = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    todo, size = [], 0

    def work():
        share, chosen = mixtures([texts[i] for i in todo], table)
        for i, s, c in zip(todo, share, chosen):
            own = sorted(np.nonzero(c)[0].tolist(), key=lambda k: (-s[k], k))
            pred[i], score[i], sets[i] = langs[own[0]], float(s[own[0]]), [langs[k] for k in own]

    for i, t in enumerate(texts):
        if langs and has_letters(t):
            todo.append(i)
            size += len(t)
            if size >= BLOCK:
                work()
                todo, size = [], 0
    if todo:
        work()
    return pred, score, sets


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, the ``keep`` columns, lang_pred, score, languages.

    ``languages`` is the chosen set, the most frequent first; lang_pred is the first of it and
    score its share of the text (0 to 1). A null text and a text without letters get `und`,
    score 0 and no languages, and so does every text if no language was learnt. Equal texts get
    equal results; repeated ids stay as rows.
    """

    def run(batches):
        for b in batches:
            pred, score, sets = guess(b.column("__text").to_pylist(), langs, table)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (id_col, *keep)), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=[id_col, *keep, "lang_pred", "score", "languages"])

    rows = docs.select(id_col, *keep, F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col, *keep).schema)
    return rows.transform(map_arrow, run, f"{fields}, lang_pred string, score double, languages array<string>")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all: id, held_out, lang_pred, score, languages."""
    fold = remainder(id_col, folds)
    langs, table = train(docs.where(fold != held), id_col, text_col, lang_col)
    found = identify(docs.withColumn("held_out", fold == held), langs, table, id_col, text_col, ("held_out",))
    return found.select(id_col, "held_out", "lang_pred", "score", "languages")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] | None = None) -> DataFrame:
    """The documents whose predicted language is among ``languages`` (None: any learnt one), with all their columns.

    Documents without letters, or null, go, and so do those in which another language prevails. If
    no document is labelled nothing can be told, so those with letters stay. Repeated rows stay; an
    empty table gives no rows.
    """
    langs, table = train(docs, id_col, text_col, lang_col)
    wanted = set(langs if languages is None else languages)

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            known = [p in wanted for p in guess(texts, langs, table)[0]] if langs else [has_letters(t) for t in texts]
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.transform(map_arrow, run, docs.schema)
