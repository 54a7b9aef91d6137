"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import below_share, map_arrow

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Atoms (runs of letters and digits, runs of blanks, single signs) of an entity, at most.
MAX_ATOMS = 14
#: Documents whose spans the field is trained on, at most about; regions of them, at most; passes over the regions.
MAX_TRAIN, MAX_REGIONS, EPOCHS = 2000, 500, 6
#: Longer regions are trained on in parts of about so many characters.
REGION_CHARS = 200

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match can only start where a run of digits does, and possessive runs keep the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        at = done = domain.end() if domain else at + 1
        if domain:
            yield start, done


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base patterns, leftmost and without overlap in a kind, failing matches dropped."""
    out = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


_ATOM = re.compile(r"[^\W_]+|\s+|[\W_]")
_ANCHOR = re.compile(r"\S*[0-9@]\S*")
#: Words before a region that are shown to the field as well.
_BEFORE = re.compile(r"\S+\s+\S+\s+\Z|\S+\s+\Z")
_SEED_SECRET = re.compile(r"(?i)\b(?:token|secret|password|api_?key)\s*[=:]\s*[\"']?([0-9A-Za-z]{16,})")


def regions(text: str):
    """(start, end) of the parts of a text with digits or at-signs, blank-separated neighbours joined, two words before."""
    held = None
    for m in _ANCHOR.finditer(text):
        start, end = m.span()
        if held and start - held[1] <= 3:
            held[1] = end
            continue
        if held:
            yield tuple(held)
        before = _BEFORE.search(text, max(0, start - 40), start)
        held = [max(before.start() if before else start, held[1] if held else 0), end]
    if held:
        yield tuple(held)


def _shape(atom: str) -> str:
    """a for letters, 9 for digits, x for both together; signs and blanks stand for themselves."""
    if not atom[0].isalnum():
        return atom
    digits = sum(map(str.isdigit, atom))
    return "a" if not digits else "9" if digits == len(atom) else "x"


def candidates(atoms: list[str]):
    """(i, j, features) of the spans that may be entities: they start and end on a sign or letter and hold a digit or @."""
    n = len(atoms)
    blank = [a.isspace() for a in atoms]
    shapes = [_shape(a) for a in atoms]
    sums = lambda xs: [0, *itertools.accumulate(xs)]
    digits = sums(sum(map(str.isdigit, a)) for a in atoms)
    ats, stops = sums(a == "@" for a in atoms), sums(a == "." for a in atoms)
    for i in range(n):
        if blank[i]:
            continue
        left = next((atoms[k].lower() for k in range(i - 1, max(-1, i - 5), -1) if not blank[k] and atoms[k] not in "\"'=:"), "^")
        before = ("t:" + (shapes[i - 1] if i else "^"), "l:" + (left[:8] if not left.isdigit() else "9"))
        shape = ""
        for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
            shape += shapes[j - 1]
            own = digits[j] - digits[i]
            if blank[j - 1] or not own and ats[j] == ats[i]:
                continue
            size = len(atoms[i])
            hexes = size if j == i + 1 and 0 < own < size else 0
            valid = 13 <= own <= 19 and luhn("".join(c for a in atoms[i:j] for c in a if c in "0123456789"))
            yield i, j, (
                "one", "s:" + shape[:24], f"d:{min(own, 20)}", f"n:{j - i}", *before, "r:" + (shapes[j][:1] if j < n else "$"),
                f"h:{min(hexes // 8, 6)}", f"@:{ats[j] - ats[i]}.{min(stops[j] - stops[i], 4)}", f"v:{valid}",
            )


class Field:
    """Semi-Markov CRF: spans of up to MAX_ATOMS atoms with a kind, single atoms outside, kinds following one another."""

    def __init__(self):
        self.weight: dict[tuple[str, str], float] = defaultdict(float)
        self.follow: dict[tuple[str, str], float] = defaultdict(float)
        self.table = None

    def _scored(self, atoms):
        spans = defaultdict(list)
        for i, j, feats in candidates(atoms):
            spans[j].append((i, feats, [sum(self.weight.get((k, f), 0.0) for f in feats) for k in KINDS]))
        return spans

    def freeze(self) -> None:
        """Lay the weights out for decoding: a row of kinds for each feature, and what a span must score to matter."""
        names = sorted({f for _, f in self.weight})
        self.index = {f: n for n, f in enumerate(names, 1)}
        self.table = np.zeros((len(names) + 1, len(KINDS)))
        for (k, f), w in self.weight.items():
            self.table[self.index[f], KINDS.index(k)] = w
        states = ("O", *KINDS)
        self.steps = [[self.follow.get((p, k), 0.0) for p in states] for k in KINDS]
        gain = [max(0.0, *(self.follow.get((p, k), 0.0) - self.follow.get(("O", k), 0.0) for k in KINDS)) for p in KINDS]
        # a span below this never beats leaving its atoms outside, whatever stands before and after it
        self.floor = -np.array([max(own) + g for own, g in zip(self.steps, gain)])

    def decode(self, atoms: list[str]) -> list[tuple[str, int, int]]:
        """The best segmentation's entities, as (kind, first atom, end atom)."""
        if self.table is None:
            self.freeze()
        places, rows, known = [], [], self.index.get
        for i, j, feats in candidates(atoms):
            places.append((i, j))
            rows.append([known(f, 0) for f in feats])
        if not rows:
            return []
        scores = np.concatenate([self.table[np.array(rows[at : at + 4096])].sum(axis=1) for at in range(0, len(rows), 4096)])
        ending = defaultdict(list)
        for c, k in zip(*(x.tolist() for x in np.nonzero(scores > self.floor))):
            ending[places[c][1]].append((places[c][0], k, scores[c, k]))
        if not ending:
            return []
        # the best value of each state (outside, then the kinds) after each atom, and where it comes from
        best = [[0.0] + [-math.inf] * len(KINDS)]
        back: list[list] = [[None] * (len(KINDS) + 1)]
        for j in range(1, len(atoms) + 1):
            had = best[j - 1]
            top = max(range(len(had)), key=had.__getitem__)
            now, how = [had[top]] + [-math.inf] * len(KINDS), [(j - 1, top)] + [None] * len(KINDS)
            for i, k, s in ending.get(j, ()):
                come = [v + f for v, f in zip(best[i], self.steps[k])]
                p = max(range(len(come)), key=come.__getitem__)
                if come[p] + s > now[k + 1]:
                    now[k + 1], how[k + 1] = come[p] + s, (i, p)
            best.append(now)
            back.append(how)
        out, j = [], len(atoms)
        state = max(range(len(best[j])), key=best[j].__getitem__)
        while j:
            i, p = back[j][state]
            if state:
                out.append((KINDS[state - 1], i, j))
            j, state = i, p
        return out[::-1]

    def learn(self, atoms: list[str], gold: set[tuple[str, int, int]], rate: float) -> None:
        """One gradient step on the conditional log-likelihood of the gold entities (forward and backward sums)."""
        spans, n = self._scored(atoms), len(atoms)
        states = ("O", *KINDS)
        log_sum = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        fwd: list[dict[str, float]] = [{"O": 0.0}]
        for j in range(1, n + 1):
            paths = {"O": [log_sum(list(fwd[j - 1].values()))]}
            for i, _, scores in spans[j]:
                for k, s in zip(KINDS, scores):
                    paths.setdefault(k, []).append(s + log_sum([v + self.follow.get((p, k), 0.0) for p, v in fwd[i].items()]))
            fwd.append({k: log_sum(v) for k, v in paths.items()})
        starts = defaultdict(list)
        for j, own in spans.items():
            for i, feats, scores in own:
                starts[i].append((j, feats, scores))
        bwd: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(states, 0.0)]
        for i in range(n - 1, -1, -1):
            for p in fwd[i]:
                bwd[i][p] = log_sum([bwd[i + 1]["O"], *(s + self.follow.get((p, k), 0.0) + bwd[j][k] for j, _, scores in starts[i] for k, s in zip(KINDS, scores))])
        total = log_sum([v for v in fwd[n].values()])
        prior = {end: kind for kind, _, end in gold}
        for i, own in starts.items():
            for j, feats, scores in own:
                for k, s in zip(KINDS, scores):
                    known = (k, i, j) in gold
                    for p, v in fwd[i].items():
                        share = math.exp(min(0.0, v + s + self.follow.get((p, k), 0.0) + bwd[j][k] - total))
                        if share > 1e-4:
                            self.follow[p, k] -= rate * share
                            for f in feats:
                                self.weight[k, f] -= rate * share
                    if known:
                        self.follow[prior.get(i, "O"), k] += rate
                        for f in feats:
                            self.weight[k, f] += rate

    def spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Entities of the field that touch no base span, with their places in the text."""
        out = []
        if not self.weight:
            return out
        taken = sorted((x, y) for _, x, y in base)
        starts, ends = [x for x, _ in taken], list(itertools.accumulate((y for _, y in taken), max))
        for start, end in regions(text):
            atoms = _ATOM.findall(text[start:end])
            places = [start]
            for a in atoms:
                places.append(places[-1] + len(a))
            for kind, i, j in self.decode(atoms):
                s, e = places[i], places[j]
                near = bisect.bisect_left(starts, e)  # base spans that start before e; does the farthest end after s?
                if not near or ends[near - 1] <= s:
                    out.append((kind, s, e))
        return out


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Spans that the field learns from: the base spans and quoted secrets, without overlaps.

    Of spans that overlap the one of the kind listed first stays, then the one that starts first.
    """
    found = base_spans(text) + [("secret", *m.span(1)) for m in _SEED_SECRET.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for kind, s, e in found:
        at = bisect.bisect_left(out, (s, e, kind))
        if (at == 0 or out[at - 1][1] <= s) and (at == len(out) or out[at][0] >= e):
            out.insert(at, (s, e, kind))
    return [(k, s, e) for s, e, k in out]


def _trained_parts(text: str):
    """(start, end) of the text's regions, long ones in parts that end at blanks."""
    for start, end in regions(text):
        while end - start > REGION_CHARS and (blank := re.compile(r"\s").search(text, start + REGION_CHARS, end)):
            yield start, blank.start()
            start = blank.end()
        yield start, end


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, max_regions: int = MAX_REGIONS, epochs: int = EPOCHS) -> Field:
    """Fit the field on regions of about ``max_train`` documents that hold digits or at-signs, drawn by a hash of the text.

    The documents are read in Spark; regions, not texts, come to the driver, ``max_regions`` at most.
    """
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rows = rows.where(below_share(F.col("h"), max_train / max(1, rows.count())))

    def run(batches):
        for b in batches:
            texts, golds = [], []
            for text in b.column(1).to_pylist():
                own = seeds(text)
                for start, end in _trained_parts(text):
                    texts.append(text[start:end])
                    at = bisect.bisect_left(own, start, key=lambda x: x[1])
                    golds.append(",".join(f"{k}:{s - start}:{e - start}" for k, s, e in itertools.takewhile(lambda x: x[1] < end, own[at:]) if e <= end))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(golds, pa.string())], names=["t", "g"])

    found = rows.transform(map_arrow, run, "t string, g string").distinct().orderBy(F.xxhash64("t"), "t", "g").limit(max_regions).collect()
    field, data = Field(), []
    for r in found:
        atoms, at, gold = _ATOM.findall(r["t"]), {0: 0}, set()
        place = 0
        for n, a in enumerate(atoms, 1):
            place += len(a)
            at[place] = n
        for g in filter(None, r["g"].split(",")):
            k, s, e = g.split(":")
            if int(s) in at and int(e) in at and 0 < at[int(e)] - at[int(s)] <= MAX_ATOMS:
                gold.add((k, at[int(s)], at[int(e)]))
        data.append((atoms, gold))
    if any(g for _, g in data):
        for k in KINDS:
            field.weight[k, "one"] = -2.0
        for epoch in range(epochs):
            for atoms, gold in data:
                field.learn(atoms, gold, 0.3 / (1 + epoch / 2))
        field.weight = {k: v for k, v in field.weight.items() if abs(v) > 1e-3}
        field.follow = dict(field.follow)
    return field


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and spans, an array of (kind, start, stop, base), base spans marked.

    Places are code points, the end exclusive. A null text counts as empty; repeated rows stay.
    """
    fields = [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = field.spans(text or "", base)
                out.append([{"kind": k, "start": s, "stop": e, "base": x} for own, x in ((base, True), (more, False)) for k, s, e in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct(fields)))], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t"))
    return rows.transform(map_arrow, run, f"{id_col} long, spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of found spans: n_email .. n_phone of base spans, base_sha256, all spans joined."""
    rank = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])

    def joined(spans):
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("a"), s["stop"].alias("b"), s["kind"].alias("k"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``count_col`` gets the new length."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                base = base_spans(text)
                parts, done = [], 0
                for kind, s, e in sorted(base + field.spans(text, base), key=lambda x: (x[1], -x[2])):
                    if s >= done:
                        parts += [text[done:s], f"[{kind.upper()}]"]
                    done = max(done, e)
                out.append("".join([*parts, text[done:]]) if done else text)
            others = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *others], names=[text_col, *names])

    names = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(text_col, *names).schema)
    done = docs.select(text_col, *names).transform(map_arrow, run, schema)
    if count_col and count_col in names:
        done = done.withColumn(count_col, F.char_length(text_col).cast(docs.schema[count_col].dataType))
    return done.select(*docs.columns)
