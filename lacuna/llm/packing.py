"""Best-fit decreasing packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import cut, map_arrow

END_ID = 1
#: A worker's memory of word ids is emptied at this many words (about 120 MB).
CACHE_WORDS = 600_000
#: A stop or comma between a letter and a blank: it is a token of its own, as a blank before it shows.
_STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=\s|\Z)")
_MARK = b"\x01"
_cache: dict[str, dict[bytes, bytes]] = {}
_tokenizers: dict[str, object] = {}
#: Bytes of text whose new words are looked up together.
TOGETHER_BYTES = 1 << 20


def _words(model, new: list[bytes], together: int = 2000):
    """(word, ids) of new words, many in one call: a mark that has an id of its own stands between them."""
    ids = lambda t: np.array(model.encode_batch_fast([t.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
    mark = ids(_MARK)
    plain = [w for w in new if _MARK not in w] if len(mark) == 1 else []
    for i in range(0, len(plain), together):
        part = plain[i : i + together]
        found = ids((b" " + _MARK + b" ").join(part))
        at = np.nonzero(found == mark[0])[0]
        body = found.tobytes()
        if len(at) == len(part) - 1:
            yield from zip(part, (body[a:b] for a, b in zip([0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(body)])))
        else:
            yield from ((w, ids(w).tobytes()) for w in part)
    if len(plain) < len(new):
        done = set(plain)
        yield from ((w, ids(w).tobytes()) for w in new if w not in done)


def encode(tokenizer: str, texts: list[bytes | None]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, without the end id.

    The tokenizer drops white space, ignores case, and never joins characters across blanks or a
    letter with a stop, so the ids of a text are those of its words in a row; each worker
    remembers the words it has met.
    """
    if tokenizer not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _tokenizers[tokenizer], _cache[tokenizer] = Tokenizer.from_file(str(public_tokenizers.path(tokenizer))), {}
    model, known = _tokenizers[tokenizer], _cache[tokenizer]
    out, held, size = [], [], 0

    def work():
        new = set().union(*held).difference(known)
        if new:
            if len(known) > CACHE_WORDS:
                known.clear()
                new = set().union(*held)
            known.update(_words(model, list(new)))
        out.extend(b"".join(map(known.__getitem__, words)) for words in held)

    for text in texts:
        text = text or b""
        # special tokens are spelt in lower case, so texts that may hold their like stay as they are
        held.append(text.split() if b"<|" in text else _STOP.sub(rb" \g<0>", text.lower()).split())
        size += len(text)
        if size >= TOGETHER_BYTES:
            work()
            held, size = [], 0
    if held:
        work()
    return out


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Documents cut into full windows and a rest: id, start, length, ids_crc32, doc_tokens.

    A document is its token ids and one end id; a null or empty text is the end id alone.
    With ``with_ids`` a column ids (array of int) carries the token ids themselves.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        for b in batches:
            ids, starts, sizes, crcs, totals, bodies = [], [], [], [], [], []
            for doc, body in zip(b.column(0).to_pylist(), encode(tokenizer, b.column(1).to_pylist())):
                body += end
                n = len(body) // 4
                for at in range(0, n, capacity):
                    part = body[4 * at : 4 * (at + capacity)]
                    ids.append(doc)
                    starts.append(at)
                    sizes.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(n)
                    if with_ids:
                        bodies.append(np.frombuffer(part, "<i4"))
            columns = [pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs, totals)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(bodies, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t"))
    return rows.transform(map_arrow, run, f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


class CapacityTree:
    """A segment tree over remaining capacities; finds the smallest one that is at hand and fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room >= need with an open window, or -1."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over piece lengths, all pieces of one length and all alike windows at once.

    Returns rows (length, lo, hi, each, sequence, offset): the pieces of that length with ranks
    lo to hi - 1 go to the windows from ``sequence`` on, ``each`` to a window, the first of a
    window at ``offset``. This is what placing the pieces singly gives: once a window is the
    tightest that fits it stays so until it is too small. The rows depend on the number of
    lengths, not on the number of pieces.
    """
    tree, open_, rows, made = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, first, n = capacity, made, -(-left // (capacity // size))
                made += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            each = room // size
            full = min(n, left // each)
            if full:
                rows.append((size, rank, rank + full * each, each, first, capacity - room))
                put(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rows.append((size, rank, rank + left, left, first + full, capacity - room))
                put(room - left * size, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return rows


def place(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 2048, salts: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces (id, start, length, ...), which should be a written table.

    The driver sees the count of each length, at most ``capacity`` rows. A piece's rank among
    those of its length comes from its place in a salted share and the sizes of the shares
    before, so a frequent length is never sorted in one task.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "start"), F.lit(salts)).cast("int"))
    shares = cut(salted.groupBy("length", "salt").count(), "shares")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    moves = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "lo", "hi", "each", "sequence", "first")])
    table = spark.createDataFrame(plan(counts, capacity), moves)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = [F.col(id_col), F.col("start")] + ([F.col("ids_crc32")] if "ids_crc32" in pieces.columns else [])
    within = Window.partitionBy("length", "salt").orderBy(*order)
    # both small tables are bounded by the capacity, whatever the number of pieces
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(shares), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    t = F.broadcast(table.withColumnRenamed("length", "size"))
    placed = ranked.join(t, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("sequence") + F.floor(nth / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("first") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack all documents: one row a piece, with its sequence_id and offset there.

    Ties between pieces of one length go by id and start. Rows with equal ids are packed each
    for itself. An empty table gives no rows; extra columns are ignored.
    """
    return place(cut(token_pieces(docs, id_col, text_col, tokenizer, capacity, with_ids), "pieces"), id_col, capacity)
