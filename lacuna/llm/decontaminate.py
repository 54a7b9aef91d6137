"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_arrow

Q = 8
EDIT_RATE = 0.1
#: Characters of benchmark text that one pass takes to the executors (about 100 MB of index).
BLOCK_CHARS = 2_000_000
#: Characters of documents that a task looks at in one go.
TEXT_CHARS = 1_000_000
#: Shared q-grams that are counted in one go.
HITS = 1 << 20
FILTER_BITS = 22
BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _letters() -> np.ndarray:
    """For each code point below 65,536 its lower case, or 0 if it is no letter or digit; one more place for all above."""
    return np.array([_letter(c) for c in range(65536)] + [0], np.uint32)


@functools.cache
def _letter(c: int) -> int:
    x = chr(c)
    low = x.lower()
    return (ord(low) if len(low) == 1 else c) if x.isalnum() else 0


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a text in lower case, and the place of each in the text (code points)."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    table = _letters()
    low = table[np.minimum(codes, 65536)]
    high = codes > 65535
    if high.any():
        every, owner = np.unique(codes[high], return_inverse=True)
        low[high] = np.array([_letter(int(c)) if c < 0x110000 else 0 for c in every], np.uint32)[owner]
    at = np.nonzero(low)[0]
    return low[at], at


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on; q is a power of two."""
    h, span, base = codes.astype(np.uint64) + np.uint64(0x51ED), 1, BASE
    with np.errstate(over="ignore"):
        while span < q:
            if len(h) <= span:
                return np.empty(0, np.uint64)
            h = h[:-span] * np.uint64(base) + h[span:]
            base = base * base % (1 << 64)
            span *= 2
        h = h ^ (h >> np.uint64(29))
        return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """q-grams of benchmark passages with their places, and the edit budget of each passage."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, kept = q, []
        for item, text in items:
            codes, _ = normalise(text)
            if len(codes) >= q:
                kept.append((item, codes))
        self.ids = [i for i, _ in kept]
        self.codes = [c for _, c in kept]
        size = np.array([len(c) for c in self.codes], np.int64)
        # with more edits than this a passage need not share a single q-gram
        self.budget = np.minimum((size * rate).astype(np.int64), (size - q) // q)
        self.least = size - q + 1 - q * self.budget
        self.size = size
        if not kept:
            return
        hashes = [grams(c, q) for c in self.codes]
        all_ = np.concatenate(hashes)
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(all_, kind="stable")
        self.keys, first = np.unique(all_[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the diagonal bands that meet the q-gram lemma's count.

        A match within the budget e keeps its q-grams on e + 1 diagonals side by side. Cells are
        e + 1 diagonals wide and a band is two cells, so some band holds them all.
        """
        h = grams(codes, self.q)
        at = np.nonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[key] == h[at]
        at, key = at[hit], key[hit]
        n = self.first[key + 1] - self.first[key]
        if not n.sum():
            return []
        cells = len(codes) + int(self.size.max()) + 4
        found, count = self._cells(at, key, n, cells)
        follow = np.searchsorted(found, found + 1)
        second = np.where((follow < len(found)) & (found[np.minimum(follow, len(found) - 1)] == found + 1), count[np.minimum(follow, len(found) - 1)], 0)
        before = np.searchsorted(found, found - 1)
        alone = ~((found[before] == found - 1) & (before < len(found)))
        out = []
        for cell_key, total, own, single in zip(found.tolist(), (count + second).tolist(), count.tolist(), alone.tolist()):
            i, c = divmod(cell_key, cells)
            c -= int(self.size.max()) + 1
            if total >= self.least[i]:
                out.append((i, c * int(self.budget[i] + 1)))
            elif single and own >= self.least[i]:
                out.append((i, (c - 1) * int(self.budget[i] + 1)))
        return out

    def _cells(self, at: np.ndarray, key: np.ndarray, n: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells (item and diagonal cell as one number) with shared q-grams, and the count of these.

        A repetitive text and passage share each q-gram at many places, so places are expanded
        HITS at a time, and only counts of cells are held.
        """
        ends = np.cumsum(n)
        parts, held = [], 0

        def merged():
            every, owner = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
            return every, np.bincount(owner, np.concatenate([c for _, c in parts])).astype(np.int64)

        for lo in range(0, int(ends[-1]), HITS):
            hit = np.arange(lo, min(lo + HITS, int(ends[-1])))
            own = np.searchsorted(ends, hit, "right")
            row = self.first[key[own]] + hit - (ends[own] - n[own])
            item = self.item[row]
            cell = (at[own] - self.place[row]) // (self.budget[item] + 1) + int(self.size.max()) + 1
            parts.append(np.unique(item * cells + cell, return_counts=True))
            held += len(parts[-1][0])
            if held > 4 * HITS and len(parts) > 1:
                parts = [merged()]
                held = len(parts[0][0])
        return parts[0] if len(parts) == 1 else merged()


def align(item: np.ndarray, text: np.ndarray, first: int, width: int) -> tuple[int, int, int]:
    """Fewest edits that turn ``item`` into a stretch of ``text``, on diagonals first .. first + width - 1.

    Returns (edits, start, end) of the leftmost best stretch; a stretch that leaves the text costs too much.
    """
    step = 1 << 32
    d = np.arange(first, first + width)
    row = np.where((d >= 0) & (d <= len(text)), d - first, step * 10**6)
    slide = np.arange(width, dtype=np.int64) * step
    for i, c in enumerate(item.tolist()):
        j = d + i
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == c
        across = np.where(inside, row + np.where(same, 0, step), step * 10**6)
        skipped = np.append(row[1:] + step, step * 10**6)
        row = np.minimum(across, skipped)
        row = np.minimum.accumulate(row - slide) + slide
    row = np.where((d + len(item) <= len(text)) & (d + len(item) >= 0), row, step * 10**6)
    best = int(np.argmin(row // step * width + np.arange(width)))
    edits, start = divmod(int(row[best]), step)
    return edits, start + first, first + best + len(item)


def matches(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text its best match of each passage within the budget: (item, start, end, edits, letters)."""
    out: list[dict[int, tuple]] = [{} for _ in texts]
    parts, places, ends, block = [], [], [], []

    def flush():
        if not block:
            return
        codes, starts = np.concatenate(parts), np.array([0, *ends[:-1]])
        for i, low in index.bands(codes):
            budget, item = int(index.budget[i]), index.codes[i]
            # the band may touch several texts, as those are joined
            for k in range(max(0, int(np.searchsorted(starts, low, "right")) - 1), len(block)):
                if starts[k] > low + 2 * budget + 2 + len(item):
                    break
                doc, own = block[k], places[k]
                text, at = codes[starts[k] : ends[k] - 1], low - int(starts[k])
                had = out[doc].get(i)
                if had and had[2] == 0 or not len(own):
                    continue
                area = text[max(0, at) : max(0, at + 2 * budget + 2 + len(item) + budget)]
                exact = area.tobytes().find(item.tobytes())
                if exact >= 0 and exact % 4 == 0:
                    found = (0, exact // 4 + max(0, at), exact // 4 + max(0, at) + len(item))
                else:
                    found = align(item, text, at - budget, 2 * budget + 2 + 2 * budget)
                edits, start, end = found
                if edits <= budget and end > start and (not had or (edits, start) < (had[2], had[3])):
                    out[doc][i] = (int(own[start]), int(own[min(end, len(own)) - 1]) + 1, edits, start)
        parts.clear(), places.clear(), ends.clear(), block.clear()

    for n, text in enumerate(texts):
        codes, at = normalise(text)
        parts.append(np.append(codes, 0))
        places.append(at)
        block.append(n)
        ends.append((ends[-1] if ends else 0) + len(codes) + 1)
        if ends[-1] >= TEXT_CHARS:
            flush()
    flush()
    return [[(index.ids[i], *m[:3], int(index.size[i])) for i, m in sorted(found.items())] for found in out]


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE, q: int = Q) -> DataFrame:
    """Each (document, passage) pair where the document holds the passage within the edit budget.

    Columns: id, item_id, match_start, match_end (code points, end exclusive), edits, similarity
    (1 - edits / length). Letters and digits are compared, in lower case. The budget is ``rate``
    of the passage's letters, or less where the lemma would ask for no common q-gram. A passage
    of fewer than q letters and digits, or none, never matches; null texts match nothing; of
    several places of one passage the one with the fewest edits, then the first, is returned.
    Rows with equal ids count as one document. An empty table on either side gives no rows.

    The benchmark goes to the executors in blocks of BLOCK_CHARS characters at most (besides
    the last passage of a block), one pass over the documents for each.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")).where("t is not null")
    found = None
    for n in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == n) if blocks > 1 else items
        one = _search(rows, Index([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()], q, rate), id_col, item_col)
        found = one if found is None else found.unionByName(one)
    order = F.struct(F.col("edits"), F.col("match_start"), F.col("match_end"), F.col("similarity"))
    best = found.groupBy(id_col, item_col).agg(F.min(order).alias("m"))
    return best.select(id_col, item_col, "m.match_start", "m.match_end", "m.edits", "m.similarity")


def _search(rows: DataFrame, index: Index, id_col: str, item_col: str) -> DataFrame:
    schema = pa.schema([(id_col, pa.int64()), (item_col, pa.int64()), ("match_start", pa.int64()), ("match_end", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        for b in batches:
            out = []
            if index.ids:
                for doc, found in zip(b.column(0).to_pylist(), matches(index, b.column(1).to_pylist())):
                    out += [(doc, item, start, end, edits, 1 - edits / letters) for item, start, end, edits, letters in found]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.transform(map_arrow, run, f"{id_col} long, {item_col} long, match_start long, match_end long, edits long, similarity double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no passage of the benchmark (documents without an id are kept)."""
    found = find_passages(docs, benchmark, id_col, text_col, **options).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")
