"""A hidden Markov language model: states emit word classes, classes emit words."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import below_share, cut, cut_at, discard, map_arrow, remainder

STATES = 6
CLASSES = 2048
ROUNDS = 2
#: Tokens of a stretch, the unit of work in Baum-Welch; what passes over its ends is carried exactly.
STRETCH = 64
#: Distinct pieces of texts of the warm start on the driver, about, and their length in bytes, at most.
WARM_PIECES, WARM_BYTES, WARM_ROUNDS = 400, 8000, 12
#: Bytes of text that share one dictionary, about.
CHUNK_BYTES = 24 << 20
#: Tasks that score chunks, at most; beyond that a task works through several chunks one by one.
MOST_TASKS = 20_000
#: Tokens that Baum-Welch works on in one go.
TOGETHER = 1 << 18
CACHE_WORDS = 1_000_000
END_CLASS = 0


class Classes(dict):
    """Class of a word: a hash of its last three bytes and whether it is longer; 0 is the end token's.

    States tell classes apart, not words: within a class words keep their shares of the whole corpus.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        c = self[word] = 1 + zlib.crc32(word[-3:] + (b"+" if len(word) > 5 else b"")) % (CLASSES - 1)
        return c


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; white space is the six ASCII kinds. The end token is not among them."""
    return (text or b"").lower().split()


def word_key(word: bytes) -> int:
    """A word's 64-bit key, signed (two words in 2**64 pairs share one); the end token is the empty word."""
    import xxhash

    k = xxhash.xxh64_intdigest(word, 7)
    return k - (1 << 64) if k >= 1 << 63 else k


def stretches(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences cut into rows of STRETCH: classes, row lengths, and whether a text starts there."""
    counts = [-(-len(c) // STRETCH) for c in classes]
    rows = np.zeros((sum(counts), STRETCH), np.int32)
    sizes, first, at = np.empty(len(rows), np.int32), np.zeros(len(rows), bool), 0
    for c, n in zip(classes, counts):
        flat = rows[at : at + n].reshape(-1)
        flat[: len(c)] = c
        sizes[at : at + n] = STRETCH
        sizes[at + n - 1] = len(c) - (n - 1) * STRETCH
        first[at] = True
        at += n
    return rows, sizes, first


def _carried(model, rows: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What passes over the ends of stretches, each row up to a factor.

    Returns the state shares before each stretch's first token, given all tokens before it, and for
    each state the likelihood of all tokens after the stretch, given its last state. A stretch
    turns the shares before it into those after it by one matrix, the product of its tokens'
    steps; texts then run through their stretches' matrices in order, all texts side by side.
    """
    start, move, emit = model
    n, k = len(rows), len(start)
    heads = np.nonzero(first)[0]
    count = np.diff(np.append(heads, n))
    by_count = np.argsort(-count, kind="stable")
    heads, count = heads[by_count], count[by_count]
    inner = np.nonzero(~np.append(first[1:], True))[0]  # stretches with another one after them, all full
    through = np.zeros((n, k, k))
    if len(inner):
        m = np.broadcast_to(np.eye(k), (len(inner), k, k))
        for t in range(STRETCH):
            m = ((m * emit[rows[inner, t]][:, None, :]).reshape(-1, k) @ move).reshape(-1, k, k)
            if t % 8 == 7:
                m = m / m.max(axis=(1, 2), keepdims=True)
        through[inner] = m
    before = np.empty((n, k))
    before[heads] = start
    for s in range(1, int(count.max())):
        at = heads[: int(np.searchsorted(-count, -s, "left"))] + s
        v = (before[at - 1][:, None, :] @ through[at - 1])[:, 0]
        before[at] = v / v.sum(axis=1, keepdims=True)
    last = heads + count - 1
    end = np.ones((len(last), k))
    for t in range(STRETCH - 1, -1, -1):
        here = sizes[last] > t
        v = emit[rows[last[here], t]] * (end[here] if t == STRETCH - 1 else np.where((sizes[last[here]] > t + 1)[:, None], end[here] @ move.T, 1.0))
        end[here] = v / v.sum(axis=1, keepdims=True)
    own = np.empty((n, k))  # likelihood of a stretch and all after it by the state of its first token
    own[last] = end
    after = np.ones((n, k))
    for s in range(int(count.max()) - 1, 0, -1):
        at = heads[: int(np.searchsorted(-count, -s, "left"))] + s
        after[at - 1] = own[at] @ move.T
        v = (through[at - 1] @ own[at][:, :, None])[:, :, 0]
        own[at - 1] = v / v.sum(axis=1, keepdims=True)
    return before, after


def expectations(model, rows: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Baum-Welch counts as one table: CLASSES rows of emissions, then STATES of transitions, then one of starts.

    They are those of whole texts: stretches run side by side, each from the shares that its text
    brings to it and back from the likelihood of all that follows.
    """
    start, move, emit = model
    k, n = len(start), len(rows)
    out = np.zeros((CLASSES + k + 1, k))
    before, after = _carried(model, rows, sizes, first)
    follows = ~np.append(first[1:], True)
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(n, int)
    place[order] = np.arange(n)
    ahead = order[follows[order]]  # stretches with another one after them, and where these stand
    here, there = place[ahead], place[np.minimum(ahead + 1, n - 1)]
    rows, sizes, first, before, after = rows[order], sizes[order], first[order], before[order], after[order]
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(STRETCH)]  # rows longer than t
    alpha, e = np.zeros((STRETCH, n, k)), emit[rows.T]
    scale = np.ones((STRETCH, n))
    for t in range(STRETCH):
        m = live[t]
        if not m:
            break
        a = (before if t == 0 else alpha[t - 1, :m] @ move) * e[t, :m]
        s = a.sum(axis=1)
        alpha[t, :m], scale[t, :m] = a / s[:, None], s
    beta = after / (alpha[sizes - 1, np.arange(n)] * after).sum(axis=1, keepdims=True)
    gamma = np.zeros((STRETCH, n, k))
    for t in range(STRETCH - 1, -1, -1):
        m = live[t]
        if not m:
            continue
        if t + 1 < STRETCH and live[t + 1]:
            q = live[t + 1]
            w = e[t + 1, :q] * beta[:q] / scale[t + 1, :q, None]
            out[CLASSES : CLASSES + k] += move * (alpha[t, :q].T @ w)
            beta[:q] = w @ move.T
        g = alpha[t, :m] * beta[:m]
        gamma[t, :m] = g / g.sum(axis=1, keepdims=True)
    if len(here):
        tail, w = alpha[STRETCH - 1, here], e[0, there] * beta[there]
        w /= ((tail @ move) * w).sum(axis=1, keepdims=True)
        out[CLASSES : CLASSES + k] += move * (tail.T @ w)
    flat = rows.T.reshape(-1)
    for j in range(k):
        out[:CLASSES, j] = np.bincount(flat, gamma[:, :, j].reshape(-1), minlength=CLASSES)
    out[-1] = gamma[0][first].sum(axis=0)
    return out


def maximise(counts: np.ndarray):
    """Start, transition and emission (CLASSES x STATES) probabilities from Baum-Welch counts, smoothed."""
    k = counts.shape[1]
    emit = counts[:CLASSES]
    share = (emit.sum(axis=1, keepdims=True) + 1) / (emit.sum() + CLASSES)
    emit = emit + 50 * share
    move, start = counts[CLASSES : CLASSES + k] + 1, counts[-1] + 1
    return start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True)


def likelihood(model, rows: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> float:
    """Log10 likelihood of stretches of whole texts."""
    _, move, emit = model
    a, total = _carried(model, rows, sizes, first)[0], 0.0
    for t in range(STRETCH):
        a = (a if t == 0 else a @ move) * emit[rows[:, t]]
        s = a.sum(axis=1)
        total += float(np.log10(s[sizes > t]).sum())
        a /= s[:, None]
    return total


def warm_start(texts: list[bytes], states: int = STATES):
    """A first model from a few texts; states differ even without any.

    Two starts are tried, and the one that makes the texts likelier after WARM_ROUNDS goes on: states
    that begin as random groups of texts and seldom change, which finds languages and topics, and states
    with random shares of every class, which finds what alternates within a text.
    """
    known, rng = Classes(), np.random.default_rng(11)
    seqs = [np.array([known[w] for w in tokens(t)] + [END_CLASS], np.int32) for t in texts]
    grouped = np.ones((CLASSES + states + 1, states)) * 0.01
    for s in seqs:
        grouped[:CLASSES, rng.integers(states)] += np.bincount(s, minlength=CLASSES)
    mixed = grouped.copy()
    mixed[:CLASSES] = grouped[:CLASSES].sum(axis=1, keepdims=True) * rng.gamma(0.5, size=(CLASSES, states))
    mixed[CLASSES : CLASSES + states] += 50 * rng.gamma(1.0, size=(states, states))
    grouped[CLASSES : CLASSES + states] += 1 + 40 * states * np.eye(states)
    models = [maximise(grouped), maximise(mixed)]
    if not seqs:
        return models[1]
    data = stretches(seqs)
    for _ in range(WARM_ROUNDS):
        models = [maximise(expectations(m, *data)) for m in models]
    return max(models, key=lambda m: likelihood(m, *data))


def classed(rows: DataFrame) -> DataFrame:
    """The classes of the words of each text (a binary column ``t``), its end included, as the bytes ``c`` of 16-bit numbers."""

    def run(batches):
        known = Classes()
        for b in batches:
            found = [np.array([known[w] for w in tokens(text)] + [END_CLASS], np.int16).tobytes() for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["c"])

    return rows.transform(map_arrow, run, "c binary")


def baum_welch(rows: DataFrame, model, rounds: int = ROUNDS):
    """Baum-Welch over all rows (a binary column ``t``): counts add up across partitions, then the driver normalises.

    Words are classed once; the rounds read the classes. The driver gets CLASSES + STATES + 1 rows a round,
    whatever the size of the corpus.
    """
    coded, path = cut_at(classed(rows), "classes")
    for _ in range(rounds):

        def run(batches, model=model):
            total, held, size = 0, [], 0

            def work():
                return expectations(model, *stretches(held))

            for b in batches:
                for c in b.column(0).to_pylist():
                    held.append(np.frombuffer(c, np.int16))
                    size += len(held[-1])
                    if size >= TOGETHER:
                        total = total + work()
                        held, size = [], 0
            if held:
                total = total + work()
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), *(pa.array(total[:, j]) for j in range(total.shape[1]))], names=["row", *(f"s{j}" for j in range(total.shape[1]))])

        k = len(model[0])
        got = coded.transform(map_arrow, run, "row long, " + ", ".join(f"s{j} double" for j in range(k))).groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toPandas()
        counts = np.zeros((CLASSES + k + 1, k))
        counts[got["row"].to_numpy()] = got[[f"s{j}" for j in range(k)]].to_numpy()
        model = maximise(counts)
    discard(rows.sparkSession, path)
    return model


def warm_pieces(training: DataFrame, pieces: int = WARM_PIECES, size: int = WARM_BYTES) -> list[bytes]:
    """About ``pieces`` distinct pieces of training texts (a binary column ``t``) of any length, drawn by a hash.

    A text has a piece for each ``size`` bytes begun, all with the same chance, and is hashed once.
    """
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("t") / size)).cast("int")
    known = training.where("t is not null").select("t", F.xxhash64("t").alias("h"), count.alias("k"))
    total = known.agg(F.sum("k")).first()[0] or 1
    placed = known.select("t", "h", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).where(below_share(F.xxhash64("h", "i"), pieces / total))
    found = placed.select(F.substring("t", F.col("i") * size + 1, F.lit(size)).alias("t")).distinct().collect()
    return sorted(r["t"] for r in found)


def chunked(rows: DataFrame, mean_bytes: float, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows, written with the number of their chunk: neighbouring rows of about ``chunk_bytes`` together.

    Numbers run from zero without large holes. Rows that repeat lie in as many chunks as they fill.
    """
    parts = rows.rdd.getNumPartitions()
    place = F.monotonically_increasing_id()  # partition, then place in it; fixed by writing it
    nth = F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / max(1, int(chunk_bytes / mean_bytes)))
    return cut(rows.withColumn("chunk", nth * parts + F.shiftright(place, 33)), "texts")


def word_counts(texts: DataFrame) -> DataFrame:
    """(chunk, word, class, n): each word of each chunk with its count in the chunk's training texts."""

    def run(batches):
        known = Classes()

        def out(chunk, own):
            words = list(own)
            for i in range(0, len(words), 100_000):
                part = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(part), pa.int64()), pa.array([word_key(w) for w in part], pa.int64()), pa.array([known[w] if w else END_CLASS for w in part], pa.int16()), pa.array([own[w] for w in part], pa.int64())],
                    names=["chunk", "word", "class", "n"],
                )

        at, own = None, Counter()
        for b in batches:
            for chunk, held, text in zip(*(b.column(c).to_pylist() for c in ("chunk", "held_out", "t"))):
                if chunk != at:
                    yield from out(at, own)
                    at, own = chunk, Counter()
                words = [*tokens(text), b""]
                if held:
                    for w in words:
                        own.setdefault(w, 0)
                else:
                    own.update(words)
        yield from out(at, own)

    return texts.transform(map_arrow, run, "chunk long, word long, class short, n long")


def _score_chunk(texts, words, counts, model, rest, base_log):
    """Scores of texts of one chunk, whose words come sorted; ``rest`` is the log10 denominator of each class."""
    known, local, local_ids = Classes(), {}, []
    known[b""] = END_CLASS
    classes = []
    for text in texts:
        own = tokens(text)
        own.append(b"")
        at = []
        for w in own:
            i = local.get(w)
            if i is None:
                i = local[w] = len(local)
                classes.append(known[w])
            at.append(i)
        local_ids.append(np.array(at, np.int32))
    keys = np.array([word_key(w) for w in local], np.int64)
    c = counts[np.searchsorted(words, keys)]
    log_c, of_class, seen = np.log10(c + 1), np.array(classes, np.int32), c > 0
    start, move, emit = model
    sizes = np.array([len(s) for s in local_ids])
    by_size = np.argsort(-sizes, kind="stable")
    flat, begin = np.concatenate(local_ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    live = np.searchsorted(-sizes[by_size], -np.arange(sizes.max()), "left")
    out, a = np.zeros(len(sizes)), None
    for t in range(int(sizes.max())):
        m = int(live[t])
        e = emit[of_class[flat[begin[by_size[:m]] + t]]]
        a = (start if t == 0 else a[:m] @ move) * e
        s = a.sum(axis=1)
        a = a / s[:, None]
        out[by_size[:m]] += np.log10(s)
    sums = np.add.reduceat(log_c[flat], begin)
    score = out + sums - np.add.reduceat(rest[of_class[flat]], begin)
    return sizes, np.add.reduceat(seen[flat].astype(np.int64), begin), sums - sizes * base_log, score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the documents outside the held-out fold and score all: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (both log10 probabilities of the whole text with its end).

    A state emits a class of words, a class emits its words by their training counts plus one,
    with one share for all unknown words, so every text has a likelihood that sums to one over
    texts. Null texts count as empty (the end token alone); repeated rows count and are scored
    each; an empty table gives no rows. The forward recursion runs over whole texts.

    Texts are dealt to chunks. A chunk sends each of its words once with its own count; these are
    added up per word and joined back, so a frequent word has a row for each chunk at most and no
    window over it. A chunk's words, then its texts, come to one task, which scores text by batch.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t"), (remainder(id_col, folds) == held).alias("held_out"))
    sized = rows.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.lit(16)).alias("b")).first()
    texts = chunked(rows, (sized["b"] or 16) / max(1, sized["n"]))
    chunks = (texts.agg(F.max("chunk")).first()[0] or 0) + 1
    training = texts.where(~F.col("held_out")).select("t")
    model = baum_welch(training, warm_start(warm_pieces(training), states), rounds)
    words = cut(word_counts(texts), "words")
    totals = cut(words.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("c")), "totals")
    stats = totals.groupBy("class").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).toPandas()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    n[stats["class"].to_numpy()], v[stats["class"].to_numpy()] = stats["n"].to_numpy(), stats["v"].to_numpy()
    total = int(n.sum())
    rest, base_log = np.log10(n + v + 1), float(np.log10(total + v.sum() + 1))
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        at, keys, counts, merged = None, [], [], False
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            edges = [0, *(np.nonzero(np.diff(chunk))[0] + 1).tolist(), len(chunk)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if chunk[lo] != at:
                    at, keys, counts, merged = chunk[lo], [], [], False
                part = batch.slice(lo, hi - lo)
                own = part.filter(part.column("word").is_valid())
                if own.num_rows:
                    keys.append(own.column("word").to_numpy())
                    counts.append(own.column("c").to_numpy())
                scored = part.filter(part.column("word").is_null())
                if not scored.num_rows:
                    continue
                if not merged:
                    word, count = np.concatenate(keys), np.concatenate(counts)
                    order = np.argsort(word)
                    keys, counts, merged = [word[order]], [count[order]], True
                sizes, known, base, own = _score_chunk(scored.column("t").to_pylist(), keys[0], counts[0], model, rest, base_log)
                yield pa.RecordBatch.from_arrays([scored.column(id_col), scored.column("held_out"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array([total] * len(sizes), pa.int64()), pa.array(base), pa.array(own)], names=names)

    counted = words.join(totals.select("word", "c"), "word").select("chunk", "word", "c")
    both = counted.unionByName(texts.select("chunk", id_col, "held_out", "t"), allowMissingColumns=True)
    tasks = int(min(chunks, MOST_TASKS))
    near = both.repartitionById(tasks, (F.col("chunk") % tasks).cast("int")).sortWithinPartitions("chunk", F.col("word").asc_nulls_last())
    return near.transform(map_arrow, run, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
