"""Fill-in-the-middle: documents cut at line ends into prefix, middle and suffix, and put in a new order.

Line ends are found by content-defined chunks: a rolling hash over bytes ends a chunk where its upper
bits are zero, so equal passages of different documents give equal chunks. What a chunk says about line
ends is remembered by its content; the counts of the chunks, added up, tell in which one a cut lies.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A chunk has 2^12 bytes on average, 256 at least, 65,536 at most; the rolling hash sees 32 bytes.
CHUNK_BITS, LEAST, MOST, STRETCH = 12, 256, 1 << 16, 1 << 20
#: Bytes of chunks that a worker remembers before it starts anew.
MEMORY = 16 << 20
#: One odd 32-bit number a byte value, by a multiplicative rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes up to each place: sum of GEAR[byte] << distance, by doubling the window five times."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end; it is hashed a stretch at a time, so a long text needs little memory."""
    ends, start = [], 0
    for at in range(0, len(data), STRETCH):
        lead = min(at, 31)
        h = rolling(np.frombuffer(data, np.uint8, min(STRETCH, len(data) - at) + lead, at - lead))[lead:]
        for end in (np.nonzero(h >> np.uint32(32 - CHUNK_BITS) == 0)[0] + at + 1).tolist():
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end - start >= LEAST:
                ends.append(end)
                start = end
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    return ends + [len(data)] * (start < len(data))


class Lines:
    """Line ends of texts, with a memory of chunks that were seen before."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.known, self.held, self.hits = memory, {}, 0, 0

    def summary(self, chunk: bytes) -> tuple[int, np.ndarray]:
        """Characters of a chunk, and after how many of them each of its lines ends; the chunk itself is the key, so equal hashes can't mislead."""
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        b = np.frombuffer(chunk, np.uint8)
        chars = np.cumsum((b & 0xC0) != 0x80, dtype=np.int32)
        found = int(chars[-1]), chars[b == 10]
        if self.held > self.memory:
            self.known, self.held = {}, 0
        self.known[chunk] = found
        self.held += len(chunk) + found[1].nbytes + 200
        return found

    def cuts(self, data: bytes, h1: int, h2: int) -> tuple[int, int, int]:
        """Number of lines, and the characters before the two cuts, after h1 % (n + 1) and h2 % (n + 1) lines in order."""
        chars, lines, parts, start = [0], [0], [], 0
        for end in chunk_ends(data):
            size, ends = self.summary(data[start:end])
            chars.append(chars[-1] + size)
            lines.append(lines[-1] + len(ends))
            parts.append(ends)
            start = end
        n = lines[-1] + (len(data) > 0 and data[-1] != 10)

        def place(k: int) -> int:
            if k == 0 or k > lines[-1]:
                return chars[-1] if k else 0
            part = bisect.bisect_left(lines, k) - 1
            return chars[part] + int(parts[part][k - lines[part] - 1])

        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, place(a), place(b)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", share: int = 100, spm: int = 50) -> DataFrame:
    """The documents with n (lines), form, prefix_chars, middle_chars and output.

    Four numbers of each document come from sha256 of ``seed``, a colon and its id. Form is plain
    (output is the text, the counts null) for empty texts, texts that hold a marker, and those beyond
    ``share`` percent; ``spm`` percent of the rest are spm, the others psm. A null text counts as empty,
    a null id as an empty one; rows that repeat an id are cut by the same numbers; columns of the input
    named like the new ones give way to them, others pass through; an empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[number(k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    new = [("n", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("marked", pa.bool_())]

    def run(batches):
        lines = Lines()
        for b in batches:
            found = []
            for data, h1, h2 in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("h1").to_pylist(), b.column("h2").to_pylist()):
                found.append((*lines.cuts(data, h1, h2), any(m in data for m in marks)))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, (_, t) in zip(columns, new)]], names=[*b.schema.names, *[k for k, _ in new]])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, T.BooleanType() if k == "marked" else T.LongType()) for k, _ in new]])
    cut = rows.transform(map_arrow, run, schema)
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= share)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    before, middle = F.col("start"), F.col("stop") - F.col("start")
    piece = lambda at, size: F.substring("text", (at + 1).cast("int"), size.cast("int"))
    p, m, s = piece(F.lit(0), before), piece(before, middle), piece(F.col("stop"), F.lit((1 << 31) - 1))
    psm, spm_ = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m), F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    formed = cut.withColumn("form", form)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    made = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(~plain, before), "middle_chars": F.when(~plain, middle), "output": output}
    return formed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in COLUMNS], *[c.alias(k) for k, c in made.items()])


def restore(output: Column, form: Column) -> Column:
    """The text that was cut, from output and form alone: each marker occurs once, as texts that hold one stay plain."""
    between = lambda stop, start: F.substring_index(F.substring_index(output, stop, 1), start, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(SUFFIX, PREFIX), middle, between(MIDDLE, SUFFIX))
    spm = F.concat(between(MIDDLE, PREFIX), middle, between(PREFIX, SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
