"""Topics of a collection and their course over the years."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import title_case
from lacuna.operators.ranks import positions
from lacuna.operators.tfidf import label_counts
from lacuna.operators.vectors import dot, l2_normalize, near_links
from lacuna.sources.tables import stored


def topic_documents(papers: DataFrame, sections: DataFrame, first: int = 3) -> DataFrame:
    """(id, text): title, abstract and the first sections of each paper."""
    ranked = sections.withColumn("__r", F.row_number().over(Window.partitionBy("paper_id").orderBy("section_order"))).where(F.col("__r") <= first)
    parts = ranked.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("__r", "content"))).alias("p"))
    texts = parts.select(F.col("paper_id").alias("id"), F.array_join(F.transform("p", lambda s: s["content"]), " ").alias("body"))
    return papers.join(texts, "id", "left").select("id", F.concat_ws(" ", "title", "abstract", "body").alias("text"))


def reduce_dims(df: DataFrame, n: int, k: int = 5, column: str = "embedding") -> DataFrame:
    """PCA to ``k`` dimensions when there are more than 6 rows of more than 10 dimensions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dim = df.agg(F.max(F.size(column))).first()[0] or 0
    if n <= 6 or dim <= 10:
        return df
    own = df.withColumn("__v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(own).transform(own).withColumn(column, vector_to_array("__p")).drop("__v", "__p")


def kmeans_topics(df: DataFrame, k: int, column: str = "embedding", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows with topic_id, and the centres (topic_id, center)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = df.withColumn("__v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="topic_id").fit(own)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic_id int, center array<double>")
    return model.transform(own).drop("__v"), centers


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, p: s + p))


def membership(df: DataFrame, centers: DataFrame, column: str = "embedding") -> DataFrame:
    """Add ``probability`` 1 / (1 + distance to the own centre)."""
    return df.join(centers, "topic_id").withColumn("probability", F.round(1 / (1 + distance(F.col(column), F.col("center"))), 4)).drop("center")


def centroids(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(topic_id, center): mean vector of each topic."""
    dims = df.select("topic_id", F.posexplode(column).alias("i", "x")).groupBy("topic_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return dims.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def density_topics(df: DataFrame, links: DataFrame, min_size: int = 2) -> DataFrame:
    """Topics as components of a neighbour graph (source, target); components below ``min_size`` are outliers (-1)."""
    from lacuna.operators.graph import components

    found = components(df.select("id"), links)
    sized = found.groupBy("component").agg(F.count("*").alias("n"))
    return found.join(sized, "component").select("id", F.when(F.col("n") >= min_size, F.col("component")).otherwise(F.lit(-1)).alias("topic_id"))


def density_or_kmeans(df: DataFrame, links: DataFrame, min_size: int = 2, max_topics: int = 10, column: str = "embedding") -> DataFrame:
    """Density topics of rows (id, embedding); of four rows or more that give fewer than two, the topics of k-means instead.

    Fewer than four rows have the topics of ``discover_topics``.
    """
    if df.limit(4).count() < 4:
        return discover_topics(df, max_topics, column)
    found = df.join(density_topics(df, links, min_size), "id")
    if found.where("topic_id <> -1").select("topic_id").distinct().limit(2).count() == 2:
        return found.withColumn("probability", F.when(F.col("topic_id") == -1, 0.0).otherwise(1.0))
    return discover_topics(df, max_topics, column)


def reduced_density(df: DataFrame, least: float, min_size: int = 2, max_topics: int = 10, dims: int = 5, column: str = "embedding") -> DataFrame:
    """The whole way: PCA, links within near cells, density topics or k-means; probabilities as these give them."""
    n = df.count()
    if n < 4:
        return discover_topics(df, max_topics, column)
    small = reduce_dims(df, n, dims, column)
    return density_or_kmeans(small, near_links(small, least, column=column), min_size, max_topics, column)


def discover_topics(df: DataFrame, max_topics: int = 10, column: str = "embedding") -> DataFrame:
    """Topics with the rules for few documents: none gives none, one is topic 0, two and three make two; these are sure (1.0)."""
    n = df.count()
    if n == 0:
        return df.withColumn("topic_id", F.lit(0)).withColumn("probability", F.lit(1.0)).limit(0)
    if n == 1:
        return df.withColumn("topic_id", F.lit(0)).withColumn("probability", F.lit(1.0))
    if n < 4:
        return kmeans_topics(df, 2, column)[0].withColumn("probability", F.lit(1.0))
    rows, centers = kmeans_topics(df, min(max_topics, max(2, n // 3)), column)
    return membership(rows, centers, column)


def topic_terms(texts: DataFrame, labels: DataFrame, top: int = 6, max_features: int = 5000, ngrams: int = 2, stop: list[str] | None = None, pattern: str = "\\b\\w\\w+\\b") -> DataFrame:
    """(topic_id, term, weight, rank) of texts (id, text) with labels (id, topic_id): c-TF-IDF over the ``max_features`` commonest terms.

    Terms are words without stop words and runs of two; the mean number of words of a text (parts between
    white space), plus one, scales the weights.
    """
    return run_terms(texts, labels.withColumn("run", F.lit(0)), top, max_features, ngrams, stop, pattern).drop("run")


def run_terms(texts: DataFrame, labels: DataFrame, top: int = 6, max_features: int = 5000, ngrams: int = 2, stop: list[str] | None = None, pattern: str = "\\b\\w\\w+\\b") -> DataFrame:
    """The same for labels (run, id, topic_id): each run has the vocabulary, counts and mean of its own texts, which are counted once for all."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != ""))
    lengths = texts.select("id", words.alias("w")).join(labels.select("run", "id"), "id").groupBy("run").agg((F.avg("w") + 1.0).alias("words"))
    member = labels.groupBy("id").agg(F.collect_list(F.struct("run", "topic_id")).alias("l"))  # as many as there are runs
    own = stored(label_counts(texts.join(member, "id"), "text", "l", ngrams, stop, pattern).select("run", "topic_id", "term", "c"), "class-terms")
    frequency = stored(own.groupBy("run", "term").agg(F.sum("c").alias("f")), "term-totals")
    runs = sorted(r["run"] for r in lengths.select("run").collect())
    if not runs:
        return own.select("run", "topic_id", "term", F.lit(0.0).alias("weight"), F.lit(0).alias("rank")).limit(0)
    vocabulary = functools.reduce(DataFrame.unionByName, [frequency.where(F.col("run") == r).orderBy(F.desc("f"), "term").limit(max_features) for r in runs])
    kept = own.join(vocabulary, ["run", "term"]).join(lengths, "run")
    totals = kept.groupBy("run", "topic_id").agg(F.sum("c").alias("n"))
    w = F.col("c") / (F.col("n") + 1e-9) * F.log(1 + F.col("words") / (F.col("f") + 1e-9))
    scored = kept.join(totals, ["run", "topic_id"]).select("run", "topic_id", "term", w.alias("weight")).where("weight > 0 and topic_id <> -1")
    order = Window.partitionBy("run", "topic_id").orderBy(F.desc(F.round("weight", 12)), "term")  # the capped vocabulary at most
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ctfidf(tf: DataFrame, labels: DataFrame, words_per_doc: float, top: int = 6) -> DataFrame:
    """(topic_id, term, weight, rank) from term counts (id, term, tf) and labels (id, topic_id)."""
    own = tf.join(labels, "id").groupBy("topic_id", "term").agg(F.sum("tf").alias("c"))
    return class_weights(own, words_per_doc, top, tf.groupBy("term").agg(F.sum("tf").alias("f")))


def class_weights(counts: DataFrame, words_per_doc: float, top: int = 6, everywhere: DataFrame | None = None) -> DataFrame:
    """The same from counts (topic_id, term, c) of ``label_counts``; corpus frequencies (term, f) are their sums unless given."""
    own = stored(counts.select("topic_id", "term", "c"), "class-terms")
    everywhere = own.groupBy("term").agg(F.sum("c").alias("f")) if everywhere is None else everywhere
    total = own.groupBy("topic_id").agg(F.sum("c").alias("n"))
    w = F.col("c") / (F.col("n") + 1e-9) * F.log(1 + F.lit(words_per_doc) / (F.col("f") + 1e-9))
    scored = own.join(total, "topic_id").join(everywhere, "term").select("topic_id", "term", w.alias("weight")).where("weight > 0 and topic_id <> -1")
    order = Window.partitionBy("topic_id").orderBy(F.desc(F.round("weight", 12)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def name_topics(terms: DataFrame) -> DataFrame:
    """(topic_id, topic_name) from the first two of the three top terms longer than two letters."""
    own = terms.where("rank <= 3 and length(term) > 2").groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    names = F.array_join(F.transform(F.slice("t", 1, 2), lambda s: title_case(s["term"])), " & ")
    every = terms.select("topic_id").distinct().join(own, "topic_id", "left")
    label = F.concat(F.lit("Topic "), F.col("topic_id").cast("string"), F.lit(": "), F.coalesce(names, F.lit("Scientific Exploration")))
    return every.select("topic_id", F.when(F.col("topic_id") == -1, "Outliers & Uncategorized").otherwise(label).alias("topic_name"))


def representatives(df: DataFrame, n: int = 3, column: str = "embedding") -> DataFrame:
    """(topic_id, id, score, rank): the documents nearest to their topic's mean."""
    scored = df.join(centroids(df, column), "topic_id").select("topic_id", "id", F.round(dot(l2_normalize(F.col(column)), l2_normalize(F.col("center"))), 10).alias("score"))
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def topic_profiles(df: DataFrame) -> DataFrame:
    """Papers, sentences and mean probability of each topic (topic_id, paper_id, probability)."""
    return df.groupBy("topic_id").agg(F.count_distinct("paper_id").alias("paper_count"), F.count("*").alias("sentence_count"), F.avg("probability").alias("topic_probability"))


def yearly_distribution(df: DataFrame, key: str = "topic_id", year: str = "year") -> DataFrame:
    """(key, year, n): years as text, missing and non-positive ones as Unknown."""
    y = F.when(F.col(year) > 0, F.col(year).cast("string")).otherwise("Unknown")
    return df.groupBy(key, y.alias("year")).agg(F.count("*").alias("n"))


def year_map(dist: DataFrame, key: str = "topic_id") -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct((F.col("year") == "Unknown").alias("u"), "year", "n")))
    return dist.groupBy(key).agg(F.map_from_entries(F.transform(own, lambda s: F.struct(s["year"], s["n"]))).alias("temporal_distribution"))


def trajectory(dist: DataFrame, key: str = "topic_id", recent: int = 2024) -> DataFrame:
    """(key, trajectory) from yearly counts: slope, recent share and first peak year decide."""
    rows = dist.where("year <> 'Unknown'").select(key, F.col("year").cast("int").alias("y"), F.col("n").cast("double").alias("n"))
    last = F.max("y").over(Window.partitionBy(key))
    a = rows.withColumn("last", last).groupBy(key).agg(
        F.count("*").alias("m"), F.sum("n").alias("total"), F.max("y").alias("last"), F.min("y").alias("first"),
        F.sum(F.when(F.col("y") >= F.col("last") - 1, F.col("n")).otherwise(0.0)).alias("late"),
        F.covar_samp("y", "n").alias("cov"), F.var_pop("y").alias("var"), F.max_by("y", F.struct("n", -F.col("y"))).alias("peak"),
    )
    beta, r = F.when(F.col("var") > 1e-6, F.col("cov") / F.col("var")).otherwise(0.0), F.when(F.col("total") > 0, F.col("late") / F.col("total")).otherwise(0.0)
    state = (
        F.when(F.col(key) == -1, "OUTLIER").when(F.col("m").isNull() | (F.coalesce("total", F.lit(0.0)) == 0), "PERSISTENT")
        .when(F.col("m") == 1, F.when(F.col("first") >= recent, "EMERGING").otherwise("PERSISTENT"))
        .when(((beta >= 0.20) & (r >= 0.45)) | ((r >= 0.70) & (F.col("total") >= 2)), "EMERGING")
        .when(((beta <= -0.15) & (r <= 0.25) & (F.col("peak") <= F.col("last") - 2)) | (r == 0), "DECLINING").otherwise("PERSISTENT")
    )
    return dist.select(key).distinct().join(a, key, "left").select(key, state.alias("trajectory"))


def trend_points(dist: DataFrame, totals: DataFrame, key: str = "topic_id", digits: int = 2) -> DataFrame:
    """(key, year, n, percentage of the year's total); Unknown is left out."""
    rows = dist.where("year <> 'Unknown'").select(key, F.col("year").cast("int").alias("year"), "n")
    return rows.join(F.broadcast(totals.select(F.col("year").cast("int").alias("year"), F.col("n").alias("total"))), "year").select(key, "year", "n", F.round(100.0 * F.col("n") / F.col("total"), digits).alias("percentage"))


def assign_topics(df: DataFrame) -> DataFrame:
    return df.select("paper_id", "topic_id", "probability", (F.col("topic_id") == -1).cast("int").alias("is_outlier"))


def topic_detail(assignments: DataFrame, papers: DataFrame, topic_id: int) -> DataFrame:
    """Members of a topic with paper data, the most probable first."""
    own = assignments.where(F.col("topic_id") == topic_id)
    return own.join(papers.withColumnRenamed("id", "paper_id"), "paper_id").select("paper_id", "title", "publication_year", "probability").orderBy(F.desc("probability"), "paper_id")


def landscape_overview(profiles: DataFrame, status: DataFrame, papers: int) -> DataFrame:
    """Topics by size with status and whether they are major: large enough, or one of the first two."""
    rows = profiles.where("topic_id <> -1").join(status, "topic_id", "left")
    ranked = positions(rows, [], [F.desc("paper_count"), "topic_id"]).withColumnRenamed("position", "rank")
    return ranked.withColumn("is_major", (F.col("paper_count") >= max(2.0, papers / 4)) | (F.col("rank") <= 2))


def tfidf_kmeans(weights: DataFrame, k: int, features: int, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Clusters on TF-IDF rows (id, term, w), and the top words of each centre. Terms take ``features`` slots."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import SparseVector, VectorUDT

    slots = weights.select("term").distinct().orderBy("term").limit(features)
    slots = slots.withColumn("slot", F.row_number().over(Window.orderBy("term")) - 1)  # ``features`` rows at most
    rows = weights.join(F.broadcast(slots), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("c"))
    sparse = F.udf(lambda at, w: SparseVector(features, at, w), VectorUDT())
    # the rounds of k-means read the rows again and again
    own = stored(rows.select("id", sparse("c.slot", "c.w").alias("features")), "cells")
    model = KMeans(k=k, seed=42, predictionCol="topic_id").fit(own)
    spark = weights.sparkSession
    centers = spark.createDataFrame([(t, int(s), float(c[s])) for t, c in enumerate(model.clusterCenters()) for s in c.argsort()[::-1][:top] if c[s] > 0], "topic_id int, slot int, weight double")
    return model.transform(own).select("id", "topic_id"), centers.join(slots, "slot").select("topic_id", "term", "weight")


def coherence(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean cosine of each topic's term pairs (terms: topic_id, term; vectors: term, embedding); null for a single term.

    With unit vectors it is (|sum|^2 - n) / (n (n - 1)), so sums per dimension do, and no pairs are made.
    """
    own = terms.select("topic_id", "term").join(vectors, "term").select("topic_id", l2_normalize(F.col("embedding")).alias("v"))
    dims = own.select("topic_id", F.posexplode("v").alias("i", "x")).groupBy("topic_id", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    square, n = F.sum(F.col("s") * F.col("s")), F.max("n")
    return dims.groupBy("topic_id").agg(F.when(n > 1, (square - n) / (n * (n - 1))).alias("coherence"))


def silhouette(df: DataFrame, column: str = "embedding") -> float:
    """Silhouette of the rows that are no outliers, by squared distances; 0 with fewer than two topics."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    own = df.where("topic_id <> -1").select(F.col("topic_id").cast("double").alias("p"), array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("v"))
    if own.select("p").distinct().count() < 2:
        return 0.0
    return ClusteringEvaluator(featuresCol="v", predictionCol="p", metricName="silhouette").evaluate(own)


def euclidean_silhouette(df: DataFrame, column: str = "embedding", block: int = 8192) -> DataFrame:
    """(silhouette): mean over the rows that are no outliers of (b - a) / max(a, b), by exact Euclidean distances; 0 with fewer than two topics.

    a is the mean distance to the others of the own topic, b the least mean distance to another topic; a row
    alone in its topic counts 0. Rows are dealt to blocks of one topic; each pair of blocks meets in one task,
    which sums up distances by matrix products, so a row gets one partial sum from each block and no pairs are made.
    """
    own = df.where(F.col("topic_id") != -1).select("id", F.col("topic_id").cast("long").alias("t"), F.transform(column, lambda x: x.cast("double")).alias("v"))
    sizes = own.groupBy("t").agg(F.count("*").alias("n"))
    blocks = own.join(sizes.select("t", F.ceil(F.col("n") / block).alias("k")), "t").withColumn("b", F.concat_ws(":", "t", F.pmod(F.xxhash64("id"), F.col("k")))).drop("k")
    names = positions(blocks.select("b").distinct(), [], ["b"]).select("b", (F.col("position") - 1).cast("int").alias("at"))
    m = names.count()
    blocks = blocks.join(names, "b")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.nulls(0, left.schema.field("id").type), pa.nulls(0, pa.int64()), pa.nulls(0, pa.int64()), pa.nulls(0, pa.float64())], names=["id", "t", "other", "s"])
        x, y = (m.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m.num_rows, -1) for m, c in ((left, "v"), (right, "v_")))
        centre = y.mean(axis=0)  # near to the points, so that little is lost in the products
        x, y, out = x - centre, y - centre, []
        for i in range(0, len(x), 256):
            square = (x[i : i + 256] ** 2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x[i : i + 256] @ y.T
            out.append(np.sqrt(np.maximum(square, 0)).sum(axis=1))
        return pa.table([left.column("id"), left.column("t"), pa.array([right.column("t_")[0].as_py()] * len(x), pa.int64()), pa.array(np.concatenate(out))], names=["id", "t", "other", "s"])

    every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))  # as many copies of a row as there are blocks to meet
    asked = blocks.select("id", "t", "v", F.col("at").alias("p"), every.alias("q"))
    met = blocks.select(F.col("t").alias("t_"), F.col("v").alias("v_"), every.alias("p_"), F.col("at").alias("q_"))
    kind = df.schema["id"].dataType.simpleString()
    parts = asked.groupBy("p", "q").cogroup(met.groupBy("p_", "q_")).applyInArrow(sums, f"id {kind}, t long, other long, s double")
    per = parts.groupBy("id", "t", "other").agg(F.sum("s").alias("s")).join(sizes.withColumnRenamed("t", "other"), "other")
    same = F.col("t") == F.col("other")
    scored = per.groupBy("id", "t").agg(F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return scored.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def subsamples(df: DataFrame, runs: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(run, id): run 0 has every id of ``df``, runs from 1 on the floor(share n) with the least seeded hashes."""
    n = df.count()
    every = df.select("id").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    dealt = every.withColumn("h", F.xxhash64(F.lit(seed), "run", "id"))
    drawn = positions(dealt, ["run"], ["h", "id"]).where(F.col("position") <= math.floor(share * n))
    return df.select(F.lit(0).alias("run"), "id").unionByName(drawn.select("run", "id"))


def cluster_runs(df: DataFrame, samples: DataFrame, k: int, starts: int = 5, rounds: int = 20, column: str = "embedding", seed: int = 42) -> DataFrame:
    """(run, id, topic_id): k-means of every run of ``samples`` (run, id) over the same vectors (id, embedding), all in one job a round.

    Every run has several starts, whose first centres are the rows with the least seeded hashes; a round
    assigns all rows in all runs and starts in one pass and adds up per task, so the driver sees
    runs x starts x k centres a round. Of a run's starts the one with the least sum of squares stays.
    """
    member = samples.groupBy("id").agg(F.collect_set("run").alias("runs"))  # as many as there are runs
    rows = stored(df.where(F.col(column).isNotNull()).select("id", F.transform(column, lambda x: x.cast("double")).alias("v")).join(member, "id"), "runs")
    keyed = rows.select("v", F.explode("runs").alias("run")).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    drawn = keyed.withColumn("h", F.xxhash64(F.lit(seed), "start", "v")).groupBy("run", "start", "h").agg(F.min("v").alias("v"))
    near = Window.partitionBy("run", "start").orderBy("h")
    share = 64 * k / max(1, rows.select(F.xxhash64("v")).distinct().count())  # so that no window sees many; of vectors only hashes are gathered
    least = drawn if share >= 0.5 else drawn.where(F.col("h") < F.lit(-(1 << 63) + int(share * (1 << 64))).cast("long"))
    picked = least.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).collect()  # runs x starts x k
    centres: dict[tuple[int, int], np.ndarray] = {}
    for r in sorted(picked, key=lambda r: (r["run"], r["start"], r["r"])):
        key = r["run"], r["start"]
        centres[key] = np.vstack([centres[key], r["v"]]) if key in centres else np.array([r["v"]])

    def assigned(batch: pa.RecordBatch, centres):
        """(run, start), the rows of the batch in that run, their nearest centre and squared distance, for all keys."""
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        own = batch.column("runs")
        place, runs = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy()), own.flatten().to_numpy()
        members = {run: place[runs == run] for run in {run for run, _ in centres}}
        for (run, start), c in centres.items():
            at = members[run]
            if len(at):
                d = ((x[at] ** 2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x[at] @ c.T).clip(0)
                yield (run, start), at, d.argmin(axis=1), d.min(axis=1), x

    sums = None
    for _ in range(rounds):

        def step(batches, centres=centres):
            total: dict = {}
            for b in batches:
                for key, at, near, d, x in assigned(b, centres) if b.num_rows else ():
                    for c in np.unique(near).tolist():
                        own = at[near == c]
                        n, s, q = total.get((*key, c), (0, 0.0, 0.0))
                        total[(*key, c)] = n + len(own), s + x[own].sum(axis=0), q + float(d[near == c].sum())
            for (run, start, c), (n, s, q) in total.items():
                yield pa.RecordBatch.from_pylist([{"run": run, "start": start, "c": c, "n": n, "s": s.tolist(), "q": q}], wanted)

        wanted = pa.schema([("run", pa.int32()), ("start", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("q", pa.float64())])
        parts = rows.mapInArrow(step, "run int, start int, c int, n long, s array<double>, q double")
        cells = parts.select("run", "start", "c", "n", "q", F.posexplode("s").alias("i", "x")).groupBy("run", "start", "c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("q").alias("q"))
        found = cells.groupBy("run", "start", "c").agg(F.max("n").alias("n"), F.max("q").alias("q"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
        moved, sums = {key: c.copy() for key, c in centres.items()}, dict.fromkeys(centres, 0.0)
        for r in found:
            moved[r["run"], r["start"]][r["c"]] = np.array([x["x"] for x in r["s"]]) / r["n"]
            sums[r["run"], r["start"]] += r["q"]
        still = all(np.allclose(moved[key], centres[key], rtol=0, atol=1e-9) for key in centres)
        centres = moved
        if still:
            break
    best = {run: min((s for r, s in centres if r == run), key=lambda s: (sums[run, s], s)) for run, _ in centres}
    chosen = {(run, s): centres[run, s] for run, s in best.items()}

    def label(batches):
        for b in batches:
            for (run, _), at, near, _, _ in assigned(b, chosen) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(at), pa.int32()), b.column("id").take(pa.array(at)), pa.array(near, pa.int32())], names=["run", "id", "topic_id"])

    return rows.mapInArrow(label, f"run int, id {df.schema['id'].dataType.simpleString()}, topic_id int")


def term_stability(terms: DataFrame) -> DataFrame:
    """(run, stability) of terms (run, topic_id, term): the mean over run 0's topics of the best Jaccard similarity of their terms to a topic of the run's."""
    sizes = terms.groupBy("run", "topic_id").agg(F.count_distinct("term").alias("n"))
    base = terms.where("run = 0").select(F.col("topic_id").alias("base"), "term").distinct()
    shared = base.join(terms.where("run > 0").select("run", "topic_id", "term").distinct(), "term").groupBy("run", "base", "topic_id").agg(F.count("*").alias("both"))
    of_base = sizes.where("run = 0").select(F.col("topic_id").alias("base"), F.col("n").alias("nb"))
    j = shared.join(sizes, ["run", "topic_id"]).join(of_base, "base").withColumn("j", F.col("both") / (F.col("n") + F.col("nb") - F.col("both")))
    best = j.groupBy("run", "base").agg(F.max("j").alias("j"))
    topics = of_base.count()
    every = sizes.where("run > 0").select("run").distinct()
    return every.join(best.groupBy("run").agg(F.sum("j").alias("s")), "run", "left").select("run", (F.coalesce("s", F.lit(0.0)) / F.lit(max(1, topics))).alias("stability"))


def refit_stability(texts: DataFrame, vectors: DataFrame, k: int = 5, runs: int = 5, share: float = 0.8, top: int = 6, seed: int = 42, **terms) -> DataFrame:
    """(run, n, stability): topics fitted again on ``runs`` subsamples of texts (id, text) with vectors (id, embedding), compared by their top terms with the topics of all.

    All runs are clustered together and their terms weighted together, a topic of a run being a topic of its own.
    """
    samples = stored(subsamples(vectors, runs, share, seed), "samples")
    found = stored(cluster_runs(vectors, samples, k, seed=seed), "clusters")
    every = run_terms(texts, found, top, **terms)
    sizes = samples.where("run > 0").groupBy("run").agg(F.count("*").alias("n"))
    return sizes.join(term_stability(every), "run")


def stability(base: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, stability): the mean over base topics of the best Jaccard similarity to a run's topics, on ids of that run."""
    both = base.select("id", "topic_id").join(runs.select("run", "id", F.col("topic_id").alias("other")), "id")
    shared = both.groupBy("run", "topic_id", "other").agg(F.count("*").alias("n"))
    a = both.groupBy("run", "topic_id").agg(F.count("*").alias("na"))
    b = both.groupBy("run", "other").agg(F.count("*").alias("nb"))
    best = shared.join(a, ["run", "topic_id"]).join(b, ["run", "other"]).groupBy("run", "topic_id").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))
    return best.groupBy("run").agg(F.avg("j").alias("stability"))


def stability_summary(per_run: DataFrame) -> DataFrame:
    """Number, mean and standard deviation (of the population) of the runs' stability."""
    return per_run.agg(F.count("*").alias("runs"), F.avg("stability").alias("mean"), F.stddev_pop("stability").alias("std"))


def outlier_ratio(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.when(F.col("topic_id") == -1, 1.0).otherwise(0.0)).alias("outlier_ratio"))
