"""Inputs that broke operators once: clashing names, only long texts, foreign and damaged archives, letters beyond the first plane."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from lacuna.llm import decontaminate, hmm, langid, pii, simhash, toxicity, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
INTERNAL = "y n b t h i k z part part_ chunk word c class row r at a fp band value list words held_out_ n_chars_ key lang_ score_ predicted".split()


@pytest.fixture(scope="module")
def clash(spark):
    """Documents with a column for each internal name of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    return docs.withColumns({c: F.lit(c) for c in INTERNAL if c not in docs.columns})


@pytest.mark.parametrize(
    "operator",
    [
        lambda d, s: toxicity.predict(d, s.read.parquet(f"{SF}/labels.parquet").withColumns({"y": F.lit(1), "n": F.lit(2), "b": F.lit("b")})),
        lambda d, s: langid.predict(d),
        lambda d, s: hmm.score(d),
        lambda d, s: simhash.near_duplicates(d),
        lambda d, s: pii.report(pii.find(d, pii.train(d))),
        lambda d, s: decontaminate.find_passages(d, s.read.parquet(f"{SF}/benchmark.parquet").withColumns({"t": F.lit(1), "b": F.lit(2)})),
    ],
)
def test_internal_names_may_be_columns(spark, clash, operator):
    plain = clash.select("doc_id", "text", "lang")
    rows = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert rows(operator(clash, spark)) == rows(operator(plain, spark))


def test_states_differ_on_a_corpus_of_long_texts(spark):
    """Texts above 8,000 characters only: pieces of them start the model, states differ and gain over words alone."""
    rng = np.random.default_rng(4)
    groups = [[f"{p}{i}{s}" for i in range(40)] for p, s in (("na", "ing"), ("be", "ed"), ("co", "ly"))]
    rows = []
    for i in range(40):
        state, out = 0, []
        for _ in range(4000):
            out.append(groups[state][int(rng.integers(40))])
            state = (state + 1) % 3 if rng.random() < 0.9 else int(rng.integers(3))
        rows.append((i, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = hmm.warm_pieces(docs.select(F.col("text").cast("binary").alias("t")))
    assert 100 <= len(pieces) <= 400 and max(map(len, pieces)) <= hmm.WARM_BYTES
    emit = hmm.warm_start([])[2]
    assert np.abs(emit - emit.mean(axis=1, keepdims=True)).max() > 1e-5
    held = [r for r in hmm.score(docs).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert held and gain > 0.2


def test_chunks_share_a_bounded_number_of_tasks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    want = by_id(hmm.score(docs))
    monkeypatch.setattr(hmm, "MOST_TASKS", 2)
    monkeypatch.setattr(hmm.chunked, "__defaults__", (8_000,))
    got = by_id(hmm.score(docs))
    assert all(abs(got[d]["score"] - want[d]["score"]) < 1e-6 * abs(want[d]["score"]) and got[d]["n_known"] == want[d]["n_known"] for d in want)


def test_letters_beyond_the_first_plane():
    codes, at = decontaminate.normalise("a\U0001f600B\U00010400\U0001d7d8\U000e0001c")
    assert [chr(c) for c in codes] == ["a", "b", "\U00010428", "\U0001d7d8", "c"] and at.tolist() == [0, 2, 3, 4, 6]


def record(kind, body, *fields, length=None):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(body) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_foreign_and_damaged_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    uri = "WARC-Target-URI: http://x/"
    whole = [
        record("warcinfo", b"software: any\r\n", "WARC-Record-ID: <urn:uuid:1>"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Record-ID: <urn:uuid:2>", uri),
        record("response", http + b"first", "WARC-Record-ID: <urn:uuid:3>", uri, "Content-Type: application/http; msgtype=response"),
        record("resource", b"a\r\n\r\nb", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/plain"),
        record("revisit", b"", "WARC-Record-ID: <urn:uuid:5>", uri, "WARC-Payload-Digest: sha1:ABC", "WARC-Refers-To: <urn:uuid:3>"),
    ]
    broken = [b"no record at all\r\n\r\n", record("response", http + b"short", "WARC-Record-ID: <urn:uuid:6>", length=9999), record("response", http + b"x", "WARC-Record-ID: <urn:uuid:7>", length="many")]
    parts = [record("response", http + b"one", "WARC-Record-ID: <urn:uuid:8>", "WARC-Segment-Number: 1"), record("continuation", b"two", "WARC-Record-ID: <urn:uuid:9>", "WARC-Segment-Origin-ID: <urn:uuid:8>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 31")]
    lost = [record("continuation", b"two", "WARC-Record-ID: <urn:uuid:11>", "WARC-Segment-Origin-ID: <urn:uuid:10>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 31")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join([*whole[:2], broken[0], *whole[2:], broken[2], *parts, *lost, broken[1]]))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(whole[2]) + gzip.compress(whole[3] * 200)[:60])
    path = str(tmp_path / "w")
    digest = lambda t: base64.b32encode(hashlib.sha1(t).digest()).decode()
    rows = [(r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.read_warc(spark, path).collect()]
    for want in (("http://x/", 5, digest(b"first"), "response"), (None, 6, digest(b"a\r\n\r\nb"), "response"), ("http://x/", None, "ABC", "revisit"), (None, 6, digest(b"onetwo"), "response")):
        assert want in rows
    faults = [r["fault"] for r in warc.quarantine(spark, path).collect()]
    for said in ("not a WARC record", "no length", "cut short", "its first segment is missing"):
        assert sum(said in f for f in faults) >= 1, said
    with pytest.raises(ValueError):
        list(warc.parse_warc(broken[0] + whole[0]))


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    """Hashed and looked up in small blocks a text gives the same; a text of 20 MB needs little besides its codes."""
    import tracemalloc

    rng = np.random.default_rng(0)
    table = rng.standard_normal((langid.DIM, 4)).astype(np.float32)
    texts = ["short", "Größe é " * 300, "", "the quick brown fox " * 500]
    want = [langid.codes(t) for t in texts]
    shares = langid.mixtures(texts, table)
    monkeypatch.setattr(langid, "BLOCK", 240)
    assert all(np.array_equal(langid.codes(t), w) for t, w in zip(texts, want))
    assert all(np.allclose(a, b) for a, b in zip(langid.mixtures(texts, table), shares))
    monkeypatch.undo()
    long = "the quick brown fox jumps " * 800_000
    tracemalloc.start()
    langid.mixtures([long], table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 18 * len(long)
