"""The corpus pipeline stage by stage against plain statements of what each stage does."""

import collections

import corpus_pipeline
import pytest
from lacuna.llm import pii
from test_jaccard import brute_kept
from test_operators import slow_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert name == "packing" or made.columns == docs.columns
        rows = made.collect()
        out.append((name, docs.collect(), rows))
        docs = made if name == "packing" else spark.createDataFrame(rows, docs.schema)
    return {name: (before, after) for name, before, after in out}


def test_language_stage_keeps_what_has_letters(stages):
    """All languages of the table are wanted ones, so only texts without letters go."""
    before, after = stages["language"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}


def test_language_stage_drops_other_languages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en",))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert 0.9 < sum(lang[d] == "en" for d in kept) / len(kept) and len(kept) > 0.9 * sum(x == "en" for x in lang.values())


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    assert sorted(r["doc_id"] for r in after) == brute_kept({r["doc_id"]: r["text"] for r in before})


def test_documents_with_passages_go(stages, spark):
    before, after = stages["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {r["doc_id"] for r in before if any(t in r["text"] for t in items)}


def test_personal_data_is_replaced(stages):
    before, after = stages["personal_data"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert text.keys() == {r["doc_id"] for r in before}
    for r in before:
        assert not slow_spans(text[r["doc_id"]])
        if not pii._ANCHOR.search(r["text"]):
            assert text[r["doc_id"]] == r["text"]


def test_all_tokens_are_packed(stages):
    before, after = stages["packing"]
    total = collections.Counter()
    for r in after:
        total[r["doc_id"]] += r["length"]
    assert {r["doc_id"]: r["doc_tokens"] for r in after} == dict(total)
    assert total.keys() == {r["doc_id"] for r in before}


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, stages["packing"][1]))


def test_odd_rows_go_through_all_stages(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns; and a table without rows."""
    long = " ".join(f"wort{i % 977} und" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "the same words again and again here"), (6, "the same words again and again here"), (6, "the same words again and again here"), (None, "no id but text of the house"), (7, "12345 !!!"), (8, "é"), (9, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "en" if i == 5 else None, None, None, 1, "k", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, key string, spans double")
    expected = {"language": [0, 4, 5, 6, 6, 8, 9], "near_duplicates": [0, 4, 5, 8, 9], "decontamination": [0, 4, 5, 8, 9], "personal_data": [0, 4, 5, 8, 9]}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        found = made.collect()
        if name in expected:
            assert made.columns == docs.columns and sorted(r["doc_id"] or 0 for r in found) == expected[name]
            docs = spark.createDataFrame(found, docs.schema)
    assert {r["doc_id"] for r in found} == {None, 4, 5, 8, 9}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
