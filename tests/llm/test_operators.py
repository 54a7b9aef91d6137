"""Each training-text operator against brute force, and its edge cases."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from lacuna.llm import decontaminate, hmm, langid, licenses, ordermin, packing, pii, simhash, toxicity, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string"
LONG = " ".join(f"word{i % 977} the" for i in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "the same words again and again here"), (6, "the same words again and again here"), (6, "the same words again and again here"), (None, "no id at all but text"), (7, "12345 !!! ***"), (8, "é"), (9, "x" * 50_000)]
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, 0.5, 1, "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# 1


def brute_sketch(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)] or ([tuple(tokens)] if tokens else [])


def test_order_minhash_on_documents(docs, texts):
    rows = {r["doc_id"]: r for r in ordermin.fingerprint_edits(docs).withColumn("near", ordermin.likeness(F.col("fp"), F.col("edited_fp"))).collect()}
    ids = sorted(texts)
    for n, d in enumerate(ids):
        t, after = texts[d], texts[ids[(n + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = set(brute_sketch(t)), set(brute_sketch(edited))
        if not a & b:
            assert rows[d]["near"] <= 0.02
    same = collections.defaultdict(set)
    for d in ids:
        same[texts[d]].add(tuple(rows[d]["fp"]))
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) == len(same)


def true_order_minhash(text, orders=600):
    """Tuples of the two least occurrence-numbered k-mers in text order, under many independent random orders."""
    kmers, seen, numbered = brute_sketch(text), collections.Counter(), []
    for k in kmers:
        numbered.append(xxhash.xxh64_intdigest(repr((k, seen[k])).encode()))
        seen[k] += 1
    h, rng, out = np.array(numbered, np.uint64), np.random.default_rng(3), []
    flips, factors = rng.integers(0, 1 << 63, (2, orders), dtype=np.uint64)
    for flip, factor in zip(flips, factors | np.uint64(1)):
        x = (h ^ flip) * factor
        x ^= x >> np.uint64(29)
        out.append(tuple(kmers[i] for i in sorted(np.argsort(x)[:2].tolist())))
    return out


def test_order_minhash_likeness_is_that_of_independent_orders(spark, texts):
    """The ring's 64 sketches estimate what 600 independent orders give, as closely as 64 independent ones would."""
    rng, rows = np.random.default_rng(1), []
    for d in [d for d, t in texts.items() if 1500 < len(t) < 6000][:8]:
        for rate in (0.005, 0.02, 0.05):
            w = texts[d].split()
            for _ in range(max(1, int(len(w) * rate))):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w[at : at + (kind != 1)] = [[w[at] + "x"], ["new"], []][kind]
            rows.append((len(rows), " ".join(texts[d].split()), " ".join(w)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r["i"]: r["n"] for r in df.select("i", ordermin.likeness(ordermin.order_minhash(F.col("a")), ordermin.order_minhash(F.col("b"))).alias("n")).collect()}
    errors = []
    for i, a, b in rows:
        exact = np.mean([x == y for x, y in zip(true_order_minhash(a), true_order_minhash(b))])
        errors.append(got[i] - exact)
    assert len(rows) >= 15 and np.abs(errors).mean() < 0.06 and abs(np.mean(errors)) < 0.03


def test_order_minhash_numbers_repeats_and_sees_order(spark):
    base = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(3)
    moved = base[200:] + base[:200]
    rows = [("base", " ".join(base)), ("moved", " ".join(moved)), ("shuffled", " ".join(rng.permutation(base))), ("edited", " ".join(base[:390] + ["x"] * 10)), ("loop", " ".join(["a b c d e f"] * 300)), ("loop2", " ".join(["a b c d e f"] * 150))]
    fp = {r["k"]: r["fp"] for r in spark.createDataFrame(rows, "k string, t string").select("k", ordermin.order_minhash(F.col("t")).alias("fp")).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(fp[a], fp[b])) / len(fp[a])
    assert like("base", "edited") > 0.8 > like("base", "moved") > like("base", "shuffled") == 0
    assert 0 < like("loop", "loop2") < 1  # occurrence numbers tell the lengths apart


def test_order_minhash_occurrences_by_doubling(spark):
    tokens = (["a"] * 37 + ["b", "c"] * 21 + ["a"] * 5) * 3
    df = spark.createDataFrame([(tokens,)], "t array<string>").select(ordermin.shingle_hashes(F.col("t"), 1).alias("k"))
    k = df.first()["k"]
    got = df.select(ordermin._numbered(F.col("k")).alias("n")).first()["n"]
    seen, expected = collections.Counter(), {}
    for i, h in enumerate(k):
        expected[i] = (h, seen[h])
        seen[h] += 1
    pairs = spark.createDataFrame([(i, h, c) for i, (h, c) in expected.items()], "i long, h long, c int").select("i", F.xxhash64("h", "c").alias("x")).collect()
    assert {x & ordermin.PLACE: x & ~ordermin.PLACE for x in got} == {r["i"]: r["x"] & ~ordermin.PLACE for r in pairs}


def test_order_minhash_edges(odd, nothing):
    rows = ordermin.fingerprint_edits(odd).collect()
    assert len(rows) == odd.count() and all(len(r["fp"]) == ordermin.SKETCHES for r in rows)
    assert all(set(r["fp"]) == {0} for r in rows if r["doc_id"] in (1, 2, 3))
    assert ordermin.fingerprint_edits(nothing).count() == 0
    one = ordermin.fingerprint_edits(odd.where("doc_id = 5")).first()
    assert one["fp"] == one["next_fp"]


@pytest.mark.parametrize("rows", [1, 7, 50])
def test_next_row_over_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(ordermin, "BUCKET_ROWS", rows)
    ids = [int(x) for x in np.random.default_rng(1).choice(10_000, 60, replace=False)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, t string")
    got = {r["doc_id"]: r["next_t"] for r in ordermin.with_next(df, "doc_id", "t").collect()}
    order = sorted(ids)
    assert got == {d: f"t{order[(n + 1) % 60]}" for n, d in enumerate(order)}


# 2


def brute_bfd(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_single_placement(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
    rows = packing.plan(dict(collections.Counter(sizes)), capacity)
    used, ranks = collections.Counter(), collections.defaultdict(set)
    for size, lo, hi, each, seq, first in rows:
        for r in range(lo, hi):
            assert r not in ranks[size]
            ranks[size].add(r)
            w = seq + (r - lo) // each
            assert used[w] == first + (r - lo) % each * size
            used[w] += size
    assert {s: len(r) for s, r in ranks.items()} == collections.Counter(sizes)
    assert sorted(capacity - u for u in used.values()) == brute_bfd(sizes, capacity)


def test_packing_round_trip(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = packing.pack_documents(docs, with_ids=True, capacity=256).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in texts.items():
        own = sorted(pieces[d], key=lambda r: r["start"])
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r["ids"]] == ids
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(256 - sum(x for _, x in w) for w in windows.values()) == brute_bfd([r["length"] for r in rows], 256)


def test_packing_edges(odd, nothing):
    rows = packing.pack_documents(odd).collect()
    by = collections.Counter(r["doc_id"] for r in rows)
    assert by[1] == by[2] == by[3] == 1 and by[6] == 2 and by[4] > 10 and by[None] == 1
    assert all(r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    assert packing.pack_documents(nothing).count() == 0


# 3


def slow_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[ -]", "", m[0])
        if 13 <= len(g) <= 19 and pii.luhn(g):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_of_documents(texts):
    for t in texts.values():
        assert pii.base_spans(t) == slow_spans(t)


@pytest.mark.parametrize("seed", range(300))
def test_base_spans_of_noise(seed):
    rng = np.random.default_rng(seed)
    t = "".join(rng.choice(list("aZ09.@-_+ ()5é\n"), 80))
    assert pii.base_spans(t) == slow_spans(t)


def test_field_segments_equal_enumeration():
    """The Viterbi segmentation scores what the best of all segmentations scores."""
    field = pii.Field()
    rng = np.random.default_rng(5)
    atoms = pii._ATOM.findall("call 12 a@b 7 now")
    spans = list(pii.candidates(atoms))
    for _, _, feats in spans:
        for f in feats:
            for k in pii.KINDS:
                field.weight[k, f] = float(rng.normal(0, 0.4))
    score = lambda seg: sum(sum(field.weight[k, f] for f in feats) for k, (_, _, feats) in seg)
    best = 0.0
    for n in range(1, 4):
        for combo in itertools.combinations(spans, n):
            ordered = sorted(combo, key=lambda s: s[0])
            if all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])):
                best = max(best, sum(max(score([(k, s)]) for k in pii.KINDS) for s in ordered))
    found = {(i, j): k for k, i, j in field.decode(atoms)}
    total = score([(k, next(s for s in spans if s[:2] == (i, j))) for (i, j), k in found.items()])
    assert len(found) <= 3 and total == pytest.approx(best)


def test_field_learns_spans(spark):
    def text(i):
        return f"Some words stand here {i} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and version {i}.0 then 4{i:03d}12345678901{i % 10} ends, page {i}; mail a{i}@b.org."

    train = spark.createDataFrame([(i, text(i)) for i in range(150)], "doc_id long, text string")
    test = spark.createDataFrame([(i, text(i)) for i in range(500, 560)], "doc_id long, text string")
    field = pii.train(train)
    hits = 0
    for r in pii.find(test, field).collect():
        found = collections.Counter((s["kind"], s["base"]) for s in r["spans"])
        base = collections.Counter((k, True) for k, _, _ in slow_spans(text(r["doc_id"])))
        hits += found == base + collections.Counter([("secret", False)])  # numbers that fail Luhn stay
    assert hits >= 58


def test_field_splits_what_a_pattern_joins():
    """Two cards side by side are one failing match of the base pattern; the field cuts them apart."""
    field = pii.Field()
    for f, w in (("one", -2.0), ("v:True", 4.0), ("n:1", 1.0)):
        field.weight["card", f] = w
    text = "pay 4111111111111111 5500005555555559 now"
    assert pii.base_spans(text) == slow_spans(text) == []
    assert field.spans(text, []) == [("card", 4, 20), ("card", 21, 37)]


def test_field_on_hard_texts():
    """A megabyte of numbers, addresses and signs is read in linear time and space."""
    import time

    rng = np.random.default_rng(2)
    field = pii.Field()
    for _, _, feats in pii.candidates(pii._ATOM.findall("call 12 a@b.c 7 10.0.0.1 now")):
        for f in feats:
            for k in pii.KINDS:
                field.weight[k, f] = float(rng.normal(0, 0.4))
    numbers = " ".join(map(str, rng.integers(10**5, 10**6, 140_000)))
    began = time.time()
    field.spans(numbers, pii.base_spans(numbers))
    mails = " ".join(f"a{i}@b.c 10.0.{i % 300}.1" for i in range(3000))
    base = pii.base_spans(mails)
    assert len(base) > 5000
    field.spans(mails, base)
    assert time.time() - began < 90


def test_pii_report_and_redaction(odd, nothing, docs, texts):
    field = pii.train(docs)
    rows = {r["doc_id"]: r for r in pii.report(pii.find(docs, field)).collect()}
    for d, t in texts.items():
        base = slow_spans(t)
        assert rows[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [rows[d][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]
        listed = rows[d]["spans"].split(",") if rows[d]["spans"] else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(listed)
    clean = {r["doc_id"]: r for r in pii.redact(docs, field, count_col="n_chars").collect()}
    assert all(not slow_spans(r["text"] or "") for r in clean.values())
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.values())
    assert pii.report(pii.find(odd, field)).count() == odd.count()
    assert pii.redact(odd, field, count_col="n_chars").columns == odd.columns
    assert pii.report(pii.find(nothing, pii.train(nothing))).count() == 0 == pii.redact(nothing, pii.Field()).count()


def test_pii_long_runs_stay_linear():
    import time

    began = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(t)
    assert time.time() - began < 20


# 4


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrst")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(2, 8))))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(6, 30))))) for i in range(25)]
    rows, n = [], 0
    for i, t in items:
        for rate in (0.0, 0.05, 0.09, 0.14):
            chars = list(t)
            for _ in range(int(len(chars) * rate)):
                at, kind = int(rng.integers(len(chars))), int(rng.integers(3))
                if kind == 0:
                    chars[at] = rng.choice(letters)
                elif kind == 1:
                    del chars[at]
                else:
                    chars.insert(at, rng.choice(letters))
            around = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(60))
            rows.append((n, f"{around[0]} {''.join(chars)} {around[1]}".upper() if n % 2 else f"{around[0]}, {''.join(chars)} ### {around[1]}"))
            n += 1
    return items, rows


def test_passages_equal_brute_force(spark, passages):
    items, rows = passages
    found = decontaminate.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found.collect()}
    index = decontaminate.Index(items, decontaminate.Q, decontaminate.EDIT_RATE)
    plain = lambda t: decontaminate.normalise(t)[0].tolist()
    expected = {}
    for d, t in rows:
        body = plain(t)
        for k, (i, item) in enumerate(items):
            if d // 4 == i or d % 10 == 0:
                e = edit_distance_inside(plain(item), body)
                if e <= index.budget[k]:
                    expected[d, i] = e
    assert {k: v for k, v in got.items() if k[0] // 4 == k[1] or k[0] % 10 == 0} == expected
    assert len(expected) >= 60


def test_passages_place_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog today"), (2, "abc"), (3, None), (4, "")], "item_id long, text string")
    text = "start!! THE QUICK, brown fox jumps over the lazy dog today... end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "abc abc"), (None, text), (1, text)], "doc_id long, text string")
    for chars in (10**6, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        rows = decontaminate.find_passages(docs, items).collect()
        assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows) == [(0, 1), (1, 1)]
        assert all(text[r["match_start"] : r["match_end"]] == "THE QUICK, brown fox jumps over the lazy dog today" for r in rows)
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4]
    assert decontaminate.find_passages(docs.where("false"), items).count() == 0 == decontaminate.find_passages(docs, items.where("false")).count()


def test_passages_in_repetitive_texts_stay_bounded():
    import tracemalloc

    index = decontaminate.Index([(1, "abcdefghij " * 200), (2, "the quick brown fox jumps over the lazy dog")], decontaminate.Q, decontaminate.EDIT_RATE)
    text = "abcdefghij " * 9000 + "The quick, brown fox jumps over the lazy dog"
    tracemalloc.start()
    found = decontaminate.matches(index, [text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(f[0], f[3]) for f in found] == [(1, 0), (2, 0)] and peak < 200 << 20


def test_passages_of_the_tables(spark, docs, texts, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(docs, items).collect()}
    assert {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if r["text"] in t} <= got
    assert decontaminate.find_passages(odd, items).count() == 0


# 5


def brute_licenses(texts, templates):
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    shingle = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, t in texts.items():
        own = shingle(cut(t))
        have = set(own)
        for k, x in templates.items():
            want = shingle(cut(x))
            if want and len(set(want) & have) >= 0.8 * len(set(want)):
                w = max(8, 2 ** math.ceil(math.log2(2 * len(want))))
                best = max(len(set(want) & set(own[i : i + w])) / len(set(want)) for i in range(0, len(own), w // 2))
                if best >= 0.8:
                    out[d, k] = best
    return out


def test_licenses_equal_brute_force(spark, texts):
    rng = np.random.default_rng(2)
    rows = dict(texts)
    n = max(rows) + 1
    for k, t in licenses.TEMPLATES.items():
        for rate in (0, 0.02, 0.1):
            w = t.split()
            for _ in range(int(len(w) * rate)):
                w[int(rng.integers(len(w)))] = "zap"
            rows[n] = " ".join(["pad"] * int(rng.integers(0, 40)) + w + ["tail"] * 9)
            n += 1
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.scan(df).collect()}
    expected = brute_licenses(rows, licenses.TEMPLATES)
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())
    assert len(expected) > len(licenses.TEMPLATES)


def test_licenses_in_blocks_and_by_bands(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK_TEMPLATES", 3)
    rows = [(n, f"pad pad {t} tail tail tail") for n, t in enumerate(licenses.TEMPLATES.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(df).collect()}
    assert {(n, k) for n, k in enumerate(licenses.TEMPLATES)} <= got
    table = {r["license_id"]: r for r in licenses.template_table(spark, licenses.TEMPLATES).collect()}
    assert all(set(r["sketch"]) <= set(r["shingles"]) and len(r["bands"]) == licenses.BANDS for r in table.values())


def test_licenses_edges(odd, nothing):
    assert licenses.scan(odd).count() == 0 == licenses.scan(nothing).count() == licenses.scan(odd, {}).count()
    assert licenses.scan(odd, {"a": "the same words again and again here"}).select("doc_id").orderBy("doc_id").collect() == [(5,), (6,)]


# 6


def test_hmm_base_counts_and_likelihood(docs, texts):
    rows = {r["doc_id"]: r for r in hmm.score(docs).collect()}
    count = collections.Counter()
    toks = lambda t: [*words(t), None]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    for d, t in texts.items():
        if not held(d):
            count.update(toks(t))
    n, v = sum(count.values()), len(count)
    gain = []
    for d, t in texts.items():
        own = toks(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        r = rows[d]
        assert r["held_out"] == held(d) and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[w] > 0 for w in own) and r["base_score"] == pytest.approx(base)
        if held(d):
            gain.append((r["score"] - r["base_score"], len(own)))
    assert sum(g for g, _ in gain) / sum(k for _, k in gain) > 0.02


def brute_forward(model, classes):
    start, move, emit = model
    a = start * emit[classes[0]]
    for c in classes[1:]:
        a = (a @ move) * emit[c]
    return a.sum()


def test_forward_and_baum_welch_equal_enumeration():
    model = hmm.warm_start([b"a b c a", b"c c b a d", b"d d d"], 3)
    texts = [b"a b d", b"", b"c c c a b"]
    keys = np.sort([hmm.word_key(w) for w in (b"a", b"b", b"c", b"d", b"")])
    rest = np.zeros(hmm.CLASSES)
    sizes, known, _, own = hmm._score_chunk(texts, keys, np.zeros(5, int), model, rest, 0.0)
    known_classes = hmm.Classes()
    for t, s in zip(texts, own):
        seq = [known_classes[w] for w in hmm.tokens(t)] + [hmm.END_CLASS]
        assert s == pytest.approx(math.log10(brute_forward(model, seq)))
    assert sizes.tolist() == [4, 1, 6] and known.tolist() == [0, 0, 0]
    seq = np.array([known_classes[w] for w in hmm.tokens(b"a b d c")] + [0], np.int32)
    got = hmm.expectations(model, *hmm.stretches([seq]))
    start, move, emit = model
    k = len(start)
    expected, total = np.zeros((hmm.CLASSES + k + 1, k)), 0.0
    for path in itertools.product(range(k), repeat=len(seq)):
        p = start[path[0]] * emit[seq[0], path[0]]
        for x, y, c in zip(path, path[1:], seq[1:]):
            p *= move[x, y] * emit[c, y]
        total += p
        expected[-1, path[0]] += p
        for s, c in zip(path, seq):
            expected[c, s] += p
        for x, y in zip(path, path[1:]):
            expected[hmm.CLASSES + x, y] += p
    assert np.allclose(got, expected / total)


def test_baum_welch_counts_of_long_texts_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    texts = [b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"delta", b"the"], n)) for n in (0, 1, 62, 63, 64, 65, 127, 128, 129, 500, 200)]
    model = hmm.warm_start(texts, 4)
    start, move, emit = model
    known, k = hmm.Classes(), len(start)
    seqs = [np.array([known[w] for w in hmm.tokens(t)] + [hmm.END_CLASS], np.int32) for t in texts]
    expected = np.zeros((hmm.CLASSES + k + 1, k))
    for seq in seqs:
        alpha, x = [], start * emit[seq[0]]
        for t in range(len(seq)):
            x = x if t == 0 else (alpha[-1] @ move) * emit[seq[t]]
            alpha.append(x / x.sum())
        b = np.ones(k)
        for t in range(len(seq) - 1, -1, -1):
            if t < len(seq) - 1:
                w = emit[seq[t + 1]] * b
                step = move * np.outer(alpha[t], w)
                expected[hmm.CLASSES : hmm.CLASSES + k] += step / step.sum()
                b = move @ w
                b /= b.sum()
            expected[seq[t]] += alpha[t] * b / (alpha[t] * b).sum()
        expected[-1] += alpha[0] * b / (alpha[0] * b).sum()
    assert np.allclose(hmm.expectations(model, *hmm.stretches(seqs)), expected)


def test_hmm_training_raises_likelihood():
    texts = [b"a b a b a b c", b"x y x y z", b"a b c a", b"y x z z"] * 10
    known = hmm.Classes()
    seqs = [np.array([known[w] for w in hmm.tokens(t)] + [0], np.int32) for t in texts]
    like = lambda m: sum(math.log(brute_forward(m, s)) for s in seqs)
    model = hmm.maximise(hmm.expectations(hmm.warm_start([], 2), *hmm.stretches(seqs)))
    assert like(hmm.warm_start(texts, 2)) >= like(model) - 1e-6


def test_hmm_edges(odd, nothing):
    rows = hmm.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm.score(nothing).count() == 0


# 7


def brute_simhash(t):
    w = words(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    parent = {d: d for d in ids}
    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {d: find(parent, d) for d in ids}


def test_simhash_equals_brute_force(docs, texts):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {d: brute_simhash(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in rows.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r["component_id"] for d, r in rows.items()} == brute_components(fps)


def test_every_pair_of_positions_is_free_together_somewhere():
    assert all(any({a, b} <= set(f) for f in simhash.free_positions()) for a, b in itertools.combinations(range(8), 2))


def test_shared_bytes_are_tallied():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    b = np.where(rng.random(500) < 0.5, a ^ (np.uint64(255) << (np.uint64(8) * rng.integers(0, 8, 500).astype(np.uint64))), b)
    expected = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1)
    assert (simhash.shared_bytes(a ^ b) == expected).all()


@pytest.mark.parametrize("rows", [4, 4096])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "LIST_ROWS", rows)
    rng = np.random.default_rng(4)
    fps = {0x0123456789ABCDEF ^ (x << 24) for x in rng.choice(1 << 24, 900, replace=False).tolist()}  # one long posting list
    for _ in range(12):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            fps.add(f)
            for _ in range(int(rng.integers(1, 4))):
                f ^= 1 << int(rng.integers(0, 64))
    fps = {i: f for i, f in enumerate(sorted(fps))}
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps.values()], "fp long")).collect()
    at = {signed(f): i for i, f in fps.items()}
    parent = {i: i for i in fps}
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.MAX_BITS
        x, y = find(parent, at[a]), find(parent, at[b])
        parent[max(x, y)] = min(x, y)
    assert {i: find(parent, i) for i in fps} == brute_components(fps)


def test_simhash_edges(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9]
    assert simhash.near_duplicates(nothing).count() == 0 == simhash.keep_one(nothing).count()


# 8


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "0123456789é\r\n\r\nWARC/1.1\r\n" * 20_000
    rows = [(3, "http://a", "same"), (1, "http://b\n x", "same"), (2, None, None), (5, "u", ""), (4, "u", big), (9, "u", big), (None, "u", "same"), (7, "u", "lone"), (7, "u", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(pages), path, segment_bytes=1000, records_per_file=37)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[digest(t)] = min(i, first.get(digest(t), i))
    expected = []
    for i, _, t in rows:
        k = digest(t)
        again = i != first[k]
        expected.append((i, len((t or "").encode()), k, "revisit" if again else "response", first[k] if again else None))
    assert got == sorted(expected, key=str)


def test_warc_minimum_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.plan_records(pages, min_revisit_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    path = str(tmp_path / "empty")
    warc.write_warc(warc.plan_records(pages.where("false")), path)
    assert warc.read_warc(spark, path).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_warc_chunks_never_hold_a_record():
    """A record of 200 MB, gzipped record by record, is digested within a few MB besides the file itself."""
    import gzip
    import tracemalloc

    line = b"0123456789abcdef" * 4096
    body = line * 3200
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n" % (len(body) + 25)
    content = gzip.compress(head + body + b"\r\n\r\n", 1) + gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    expected, size = hashlib.sha1(body).hexdigest(), len(body)
    del body
    tracemalloc.start()
    digest, seen, records = hashlib.sha1(), 0, 0
    for fields, n, chunk, last in warc.payload_chunks(content):
        assert len(chunk) <= warc.SEGMENT_BYTES
        records += n == 0
        digest.update(chunk)
        seen += len(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (digest.hexdigest(), seen, records) == (expected, size, 2) and peak < 20 << 20


def test_warc_chunked_record_table(spark, tmp_path):
    page = "ab\r\n\r\ncd" * 30_000
    path = str(tmp_path / "c")
    warc.write_warc(warc.plan_records(spark.createDataFrame([(1, "u", page), (2, "u", "small")], "page_id long, url string, html string")), path)
    rows = warc.read_segments(spark, path, bodies=True).orderBy("record", "segment", "chunk").collect()
    bodies = collections.defaultdict(bytes)
    for r in rows:
        bodies[r["page_id"]] += r["body"]
        assert len(r["body"]) <= warc.SEGMENT_BYTES
    assert bodies == {1: page.encode(), 2: b"small"}
    assert max(r["segment"] for r in rows) == -(-len(page) // warc.SEGMENT_BYTES)


# 9


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=6), rng.normal(size=(6, 3))
    terms = [toxicity.buckets(x)[0] for x in ("aa", "bb", "cc", "dd", "ee", "ff")]
    machine = toxicity.Machine(np.array(terms), 0.3, w, v)
    at = machine.features("aa cc, FF aa")
    z = 0.3 + sum(w[i] for i in at) + sum(v[i] @ v[j] for i, j in itertools.combinations(at, 2))
    assert at == [0, 2, 5] and machine.score("aa cc, FF aa") == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_learns_interactions(spark):
    """Exclusive-or of two words, which no linear model tells apart: without its pairs the machine fails."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a, b = rng.integers(2, size=2)
        rows.append((i, " ".join(["plain", f"w{rng.integers(50)}"] + ["badword"] * int(a) + ["grouping"] * int(b)), int(a != b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learnt = labels.where(F.expr("crc32(cast(string(doc_id) as binary)) % 3 <> 1"))
    machine = toxicity.fit(toxicity._sample(docs, learnt, "doc_id", "text", "toxic", 10_000), steps=400)
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = lambda m: np.mean([(m.score(t) >= 0.5) == y for t, y in held])
    linear = toxicity.Machine(np.array(list(machine.index)), machine.bias, machine.weight, machine.factor * 0)
    assert right(machine) > 0.98 and right(linear) < 0.8


def test_toxicity_fold_and_rare_terms(spark):
    """A word of three distinct rows in a thousand counts; copies of one text teach no term."""
    rows = [(i, f"plain w{i % 40} x{i}", 0) for i in range(1000)] + [(2000 + i, f"plain w{i % 40} y{i} vilest", 1) for i in range(9)] + [(3000 + i, "plain copied phrase", 1) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predict(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    machine = toxicity.fit(toxicity._sample(docs, labels, "doc_id", "text", "toxic", 10_000))
    assert machine.features("vilest") and not machine.features("copied")
    assert machine.score("vilest") > machine.score("w1")


def test_sparse_products_equal_dense():
    columns, rng = [[0, 2], [], [1], [0, 1, 2]], np.random.default_rng(3)
    dense = np.array([[i in c for i in range(4)] for c in columns], float)
    x, v, g = toxicity.Sparse(columns, 4), rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    assert np.allclose(x.dot(v), dense @ v) and np.allclose(x.dot(v[:, 0]), dense @ v[:, 0])
    assert np.allclose(x.back(g), dense.T @ g) and np.allclose(x.back(g[:, 1]), dense.T @ g[:, 1])


def test_toxicity_edges(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.predict(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.predict(odd, labels.where("false")).count() == odd.count()
    assert toxicity.predict(nothing, labels).count() == 0


# 10


def test_language_of_documents(docs):
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.predict(docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows]) > 0.95


def test_language_mixture(docs):
    langs, table = langid.train(docs)
    by = {k: " ".join(r["text"] for r in docs.where(F.col("lang") == k).limit(3).collect())[:3000] for k in ("en", "fr")}
    share, chosen = langid.mixtures([by["en"] + " " + by["fr"][:1500], by["en"], by["fr"]], table)
    sets = [{langs[i] for i in np.nonzero(c)[0]} for c in chosen]
    assert sets == [{"en", "fr"}, {"en"}, {"fr"}]
    assert share[0][langs.index("fr")] == pytest.approx(1 / 3, abs=0.08)
    # a pair of texts gets what each gets alone
    alone = langid.mixtures([by["en"]], table)[0][0]
    assert np.allclose(alone, share[1])


def brute_mixture(texts_segments, penalty=1.0):
    """Shares and set of one text by plain loops over its segments' likelihoods."""
    rows = [[math.exp(max(x - max(r), -600)) for x in r] for r in texts_segments]
    k = len(rows[0])

    def em(allowed):
        share = [a / sum(allowed) for a in allowed]
        for _ in range(langid.ROUNDS):
            total = [0.0] * k
            for r in rows:
                z = sum(x * s for x, s in zip(r, share))
                for i in range(k):
                    total[i] += r[i] * share[i] / z
            share = [(t + langid.PRIOR) * a for t, a in zip(total, allowed)]
            share = [s / sum(share) for s in share]
        return share, sum(math.log(sum(x * s for x, s in zip(r, share))) for r in rows)

    share = em([1.0] * k)[0]
    order = sorted(range(k), key=lambda i: (-share[i], i))
    best, chosen, final = sum(math.log(max(r[order[0]], 1e-260)) for r in rows), order[:1], {order[0]: 1.0}
    for m in range(2, k + 1) if max(share) < 0.995 else ():
        own, like = em([1.0 if i in order[:m] else 0.0 for i in range(k)])
        value = like - penalty * (m - 1) * 0.5 * math.log(len(rows) + 1)
        if value <= best:
            break
        best, chosen, final = value, order[:m], {i: own[i] for i in order[:m]}
    return set(chosen), final


@pytest.mark.parametrize("seed", range(6))
def test_mixture_equals_plain_loops(seed):
    rng = np.random.default_rng(seed)
    table = np.log(rng.dirichlet(np.full(langid.DIM, 0.02), 3).T + 1e-9).astype(np.float32)
    texts = ["".join(rng.choice(list("abcdefghij klmn"), int(n))) for n in (30, 200, 700)]
    share, chosen = langid.mixtures(texts, table)
    for n, t in enumerate(texts):
        c = langid.codes(t)
        segments = [table[c[i : i + langid.SEGMENT]].sum(axis=0, dtype=np.float64).tolist() for i in range(0, len(c), langid.SEGMENT)]
        want, shares = brute_mixture(segments)
        assert set(np.nonzero(chosen[n])[0].tolist()) == want
        assert all(share[n][i] == pytest.approx(s, abs=1e-3) for i, s in shares.items())


def test_language_sample_learns_rare_languages(spark, docs):
    """However small the sampled share is, each language is learnt from a part of its own."""
    rare = docs.where("lang = 'es'").limit(3).withColumn("lang", F.lit("rare"))
    langs, _ = langid.train(docs.unionByName(rare), max_train=60)
    assert langs == ["de", "en", "es", "fr", "rare"]


def test_language_filter_keeps_the_wanted(docs):
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, *langid.train(docs)).collect()}
    kept = {r["doc_id"] for r in langid.keep_known(docs, languages=("de", "fr")).collect()}
    assert kept == {d for d, k in found.items() if k in ("de", "fr")} and kept


def test_language_edges(odd, nothing):
    rows = {r["doc_id"]: r for r in langid.predict(odd).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 7))
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 6, 6, 8, 9]
    assert langid.predict(nothing).count() == 0 == langid.keep_known(nothing).count()
    assert {r["lang_pred"] for r in langid.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
