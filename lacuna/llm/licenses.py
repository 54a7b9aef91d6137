"""License notices in documents: MinHash bands over text windows, verified by shingle containment; DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.ordermin import let, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: A window holds more than a quarter of its shingles' worth of template, so the Jaccard similarity of
#: a match is 0.8 w / 4 / (w + 0.2 w / 4) = 0.19 at least, and 36 bands of one row miss it once in 2,000.
#: This holds for narrow templates too, as their windows narrow along: one shingle has windows of two.
BANDS = 36
#: Templates that one pass over the documents looks for.
BLOCK_TEMPLATES = 256

#: The wording of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, letters and digits in lower case; fewer words give none."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return let(tokens, lambda t: F.when(F.size(t) >= SHINGLE, shingle_hashes(t, SHINGLE)).otherwise(F.array().cast("array<bigint>")))


def bands(of: Column) -> Column:
    """One MinHash value for each band, its number hashed in."""
    least = lambda j: F.array_min(F.transform(of, lambda x: F.xxhash64(x, F.lit(j))))
    return F.array(*map(least, range(BANDS)))


def sketch(of: Column) -> Column:
    """The shingles that the bands' MinHash values belong to, BANDS at most."""
    least = lambda j: F.array_min(F.transform(of, lambda x: F.struct(F.xxhash64(x, F.lit(j)).alias("h"), x.alias("x"))))["x"]
    return F.array_distinct(F.array(*map(least, range(BANDS))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license_id, width (of its windows), shingles, bands, sketch. Templates of fewer than five words are left out."""
    rows = spark.createDataFrame(sorted(templates.items()), "license_id string, text string")
    own = rows.select("license_id", shingles(F.coalesce("text", F.lit(""))).alias("all")).where(F.size("all") > 0)
    width = F.pow(2.0, F.ceil(F.log2(2.0 * F.size("all")))).cast("int")
    own = own.select("license_id", width.alias("width"), F.array_distinct("all").alias("shingles"))
    return own.withColumn("bands", bands(F.col("shingles"))).withColumn("sketch", sketch(F.col("shingles")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each (document, license) pair with a window that contains ``threshold`` of the template's shingles.

    Columns: id, license_id, containment (0 to 1), start_word (words before the first shared
    shingle). Windows are at least twice as long as the template and overlap by half, so one of
    them holds any place whole. A window is a candidate for the templates that it shares a band
    value with. Such a value belongs to one of the template's sketch shingles, so windows without
    any of these are not hashed, at no loss. Candidates are verified on all shingles of the
    template. Null texts and texts of fewer than five words hold nothing; rows with equal ids count
    as one document; of several windows the best, then the first counts. BLOCK_TEMPLATES templates
    are looked for in one pass over the documents, more of them in several.
    """
    spark = docs.sparkSession
    names = sorted((TEMPLATES if templates is None else templates).items())
    parts = [dict(names[i : i + BLOCK_TEMPLATES]) for i in range(0, len(names), BLOCK_TEMPLATES)] or [{}]
    rows = docs.select(F.col(id_col), shingles(F.coalesce(F.col(text_col), F.lit(""))).alias("own"))
    found = [_scan(rows, template_table(spark, part), id_col, threshold) for part in parts]
    return functools.reduce(DataFrame.unionByName, found)


def _scan(rows: DataFrame, table: DataFrame, id_col: str, threshold: float) -> DataFrame:
    known = table.select("width", "sketch").collect()  # BANDS shingles of BLOCK_TEMPLATES templates at most
    total = sorted({s for r in known for s in r["sketch"]})
    widths = sorted({r["width"] for r in known})
    wanted = F.array(*[F.lit(s) for s in total]).cast("array<bigint>")
    rows = rows.select("*", F.array_intersect("own", wanted).alias("hits")).where(F.size("hits") > 0)
    places = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.array_contains("hits", F.col("own")[i]))

    def windows(p):
        def of_width(w):
            half = w // 2
            near = F.flatten(F.transform(p, lambda i: F.array(F.floor(i / half).cast("int"), F.greatest(F.floor(i / half).cast("int") - 1, F.lit(0)))))
            # a window takes its own shingles along, so no row holds the whole text for each of them
            return F.transform(F.array_distinct(near), lambda n: F.struct(F.lit(w).alias("width"), (n * half).alias("at"), F.slice(F.col("own"), n * half + 1, w).alias("window")))

        return F.flatten(F.array(*map(of_width, widths)))

    none = F.struct(F.lit(0).alias("width"), F.lit(0).alias("at"), F.slice("own", 1, 0).alias("window"))
    cut = rows.select(id_col, F.explode(let(places, windows)).alias("w") if widths else none.alias("w"))
    cut = cut.select(id_col, "w.width", "w.at", "w.window").where(F.size("window") > 0)
    banded = lambda df: df.select("*", F.posexplode("bands").alias("band", "value")).drop("bands")
    # the index of bands holds BANDS short rows for each of BLOCK_TEMPLATES templates at most, their shingles one row each
    index = F.broadcast(banded(table.select("width", "license_id", "bands")))
    found = banded(cut.withColumn("bands", bands(F.col("window")))).join(index, ["width", "band", "value"]).join(F.broadcast(table.select("license_id", "shingles")), "license_id")
    shared = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    first = F.array_position(F.transform("window", lambda x: F.array_contains("shingles", x)), F.lit(True)) - 1 + F.col("at")
    checked = found.select(id_col, "license_id", shared.alias("containment"), first.alias("start_word")).where(F.col("containment") >= threshold)
    best = checked.groupBy(id_col, "license_id").agg(F.min(F.struct((-F.col("containment")).alias("c"), "start_word")).alias("b"))
    return best.select(id_col, "license_id", (-F.col("b.c")).alias("containment"), F.col("b.start_word").cast("long").alias("start_word"))
