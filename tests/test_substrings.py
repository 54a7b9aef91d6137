"""Words inside texts by the q-gram join against plain loops."""

import random

from pyspark.sql import functions as F

from lacuna.operators import substrings


def plain(rows, words):
    return sorted((i, w, g) for i, t in rows for w, g in words if t and w and w in t)


def joined(spark, rows, words):
    a = spark.createDataFrame(rows, "id long, t string")
    b = spark.createDataFrame(words, "w string, g long")
    return sorted((r["id"], r["w"], r["g"]) for r in substrings.containing(a, F.col("t"), b).select("id", "w", "g").collect())


def test_equal_to_plain_loops(spark):
    random.seed(3)
    letters = "abcde é漢\U0001f600"
    rows = [(i, "".join(random.choices(letters, k=random.randrange(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "abcabcabc" * 2000), (903, "abcabcabc" * 2000), (903, "abcabcabc" * 2000)]
    words = [("".join(random.choices(letters, k=random.randrange(1, 9))), g) for g in range(200)] + [("", 1), (None, 2), ("cabcabca", 3), ("cabcabca", 4), (rows[5][1] + "x", 5), (rows[7][1], 6)]
    got = joined(spark, rows, words)
    assert got == plain(rows, words) and len(got) > 500


def test_nothing_to_find(spark):
    rows, words = [(1, "some text"), (2, None)], [("absent", 1)]
    assert joined(spark, rows, words) == joined(spark, rows, []) == joined(spark, [], words) == joined(spark, rows, [("", 1), (None, 2)]) == []


def test_a_hundred_thousand_words_in_one_pass(spark):
    words = spark.range(100_000).select(F.concat(F.lit("key"), F.lpad(F.conv(F.col("id") * 7919 % 1_000_003, 10, 36), 6, "0"), F.lit("z")).alias("w"), F.col("id").alias("g"))
    texts = words.where("g % 500 = 0").select("g", F.concat(F.lit("before "), F.col("w"), F.lit(" after"), F.repeat(F.lit(" filler"), 20)).alias("t"))
    found = substrings.containing(texts.withColumnRenamed("g", "id"), F.col("t"), words)
    assert found.where("id = g").count() == found.count() == 200


def test_words_are_filed_under_rare_grams(spark):
    texts = spark.createDataFrame([("common words everywhere",)] * 50 + [("zqxj",)], "hay string")
    filed = substrings.filed_words(spark.createDataFrame([("common zqxj",)], "w string"), texts).first()
    assert filed["gram"] not in set(substrings.gram_hashes("common words", 4).tolist())


def test_dictionary_of_any_size_keeps_the_case_of_the_text(spark):
    from lacuna.operators import discourse

    texts = [(1, "We train BERT and bert-base on C++ code."), (2, "Roberta is no BERT2 nor xBERT."), (3, "An F1-score of 0.9; f1-SCORE again."), (4, None), (5, ""), (6, "ÜBER-Modell und übermodell")]
    names = [("BERT", "bert"), ("c++", "cpp"), ("F1-score", "f1"), ("über-modell", "um"), ("", "none"), (None, "none"), ("a\\Eb", "odd")]
    found = discourse.dictionary_join(spark.createDataFrame(texts, "id long, source_text string"), spark.createDataFrame(names, "name string, canonical string"))
    assert sorted((r["id"], r["canonical"], r["mention"]) for r in found.collect()) == [(1, "bert", "BERT"), (1, "cpp", "C++"), (3, "f1", "F1-score"), (6, "um", "ÜBER-Modell")]
    many = spark.range(100_000).select(F.concat(F.lit("Name"), F.lpad(F.conv(F.col("id") * 7919 % 1_000_003, 10, 36), 6, "0")).alias("name"), F.col("id").alias("canonical"))
    rows = many.where("canonical % 1000 = 7").select(F.col("canonical").alias("id"), F.concat(F.lit("the "), F.upper("name"), F.lit(", and Name")).alias("source_text"))
    got = discourse.dictionary_join(rows, many).collect()
    assert len(got) == 100 and all(r["id"] == r["canonical"] and r["mention"].startswith("NAME") for r in got)


def test_few_words_travel_and_many_are_met_alike(spark, monkeypatch):
    """Words up to TRAVEL meet the rows without a shuffle of them; both ways find the same."""
    rows = [(i, f"text {i} of key{i % 40}x and key{i}") for i in range(120)] + [(900, "key1x key2x"), (901, "key1x key2x")]
    words = [(f"key{i}x", i) for i in range(30)] + [("of", 50), ("of", 51), ("ke", 52)]
    got = joined(spark, rows, words)
    plan = substrings.containing(spark.createDataFrame(rows, "id long, t string"), F.col("t"), spark.createDataFrame(words, "w string, g long"))
    assert "xxhash64" not in plan._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(substrings, "TRAVEL", 0)
    monkeypatch.setattr(substrings, "CHARS", 30)
    assert got == joined(spark, rows, words) == plain(rows, words)
