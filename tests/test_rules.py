"""Plain strings before patterns: no match is lost, and each pattern is looked for once."""

import string

import pytest
from pyspark.sql import functions as F

from lacuna.functions.rules import Cue, folded, matches
from lacuna.operators import discourse


def test_folded_text_holds_each_letter_that_a_pattern_without_case_finds(spark):
    signs = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string").withColumn("low", folded(F.col("c")))
    lost = [F.sum((F.col("c").rlike("(?iU)" + x) & ~F.col("low").contains(x)).cast("int")) for x in string.ascii_lowercase]
    assert sum(signs.agg(*[n.alias(f"n{i}") for i, n in enumerate(lost)]).first()) == 0


def test_a_cue_is_found_where_its_pattern_is(spark):
    texts = spark.createDataFrame([("This İſ it",), ("ıS",), ("was",), ("IS",), (" the Key",)], "t string")
    found = texts.select(matches(F.col("t"), Cue(r"\bis\b", "is"), low=folded(F.col("t"))).alias("a"), matches(F.col("t"), r"\bis\b").alias("b"), matches(F.col("t"), Cue("key", "key"), low=folded(F.col("t"))).alias("k")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found]
    assert [r["a"] for r in found][1:] == [True, False, True, False]
    assert [r["k"] for r in found] == [False, False, False, False, True]
    with pytest.raises(ValueError):
        Cue("x")


def test_each_pattern_of_the_detectors_is_looked_for_once(spark):
    s = spark.createDataFrame([(1, 1, "  We xa1 and xb1 and xc1 and xd1, by 12 points. ", "Other")], "id long, paper_id long, source_text string, section_name string")
    e = discourse.extract_all(s, rules={"METHOD": [("xa1", 0.9)]}, subtypes={"generic": ["xb1"]}, future_work=[("xc1", 3.0)], results=[("xd1", 3.0)])
    had = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", had)
    assert [plan.count("(?iU)" + p) for p in ("xa1", "xb1", "xc1", "xd1")] == [1, 1, 1, 1]
    assert {(r["extraction_type"], r["extracted_text"][:2], r["numerical_gain"]) for r in e.collect()} == {("METHOD", "  ", None), ("LIMITATION", "We", None), ("FUTURE_WORK", "We", None), ("RESULT", "We", "by 12 points")}
