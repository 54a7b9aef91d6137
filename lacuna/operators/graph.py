"""A research knowledge graph as node and edge tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import lexicon
from lacuna.functions.rules import matches
from lacuna.functions.text import slugify, title_case, whole_words
from lacuna.sources.tables import delete_path, map_batches, scratch_path, stored

NODE_COLUMNS = ("id", "label", "type", "properties", "aliases", "seq")


def canonical_name(raw: Column, table: dict[str, str] | None = None) -> Column:
    """A struct of canonical name and confidence: a known name .95, else a short word as an acronym or title case .80."""
    table = lexicon.CANONICAL_ENTITIES if table is None else table
    clean = F.trim(F.regexp_replace(raw, "\\s+", " "))
    key = F.regexp_replace(F.lower(clean), "(?U)[^\\w\\s]", "")
    import re

    known = F.create_map(*[x for k, v in {re.sub(r"[^\w\s]", "", k): v for k, v in table.items()}.items() for x in (F.lit(k), F.lit(v))])
    hit = F.element_at(known, key)
    name = F.when(clean.rlike("^\\p{L}{1,5}$"), F.upper(clean)).otherwise(title_case(clean))
    return F.struct(F.coalesce(hit, name).alias("name"), F.when(hit.isNotNull(), 0.95).otherwise(0.80).alias("confidence"))


def node(df: DataFrame, id: Column, label: Column, kind: str, properties: dict[str, Column] | None = None, aliases: Column | None = None, seq: Column | None = None) -> DataFrame:
    pairs = [x for k, v in (properties or {}).items() for x in (F.lit(k), v.cast("string"))]
    props = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(id.alias("id"), label.alias("label"), F.lit(kind).alias("type"), props.alias("properties"), (aliases if aliases is not None else F.array().cast("array<string>")).alias("aliases"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"))


def paper_nodes(papers: DataFrame) -> DataFrame:
    return node(papers, F.concat(F.lit("paper:"), F.col("id")), F.col("title"), "Paper", {"paper_id": F.col("id"), "title": F.col("title"), "publication_year": F.col("publication_year"), "venue": F.col("venue")}, seq=F.col("id"))


def author_nodes(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Author nodes, and an edge from each author to each paper."""
    rows = papers.select("id", F.posexplode("authors").alias("n", "author")).where(F.length(F.trim("author")) > 0)
    rows = rows.select("id", "n", F.trim("author").alias("author"), F.concat(F.lit("author:"), slugify(F.col("author"))).alias("author_id"))
    nodes = node(rows, F.col("author_id"), F.col("author"), "Author", seq=F.col("id") * 1000 + F.col("n"))
    return nodes, edge(rows, F.col("author_id"), F.concat(F.lit("paper:"), F.col("id")), F.lit("proposes"), F.lit(0.98), F.col("id"), seq=F.col("id") * 1000 + F.col("n"))


def entity_nodes(df: DataFrame, kind: str, text: str = "extracted_text", seq: str = "id", table: dict[str, str] | None = None) -> DataFrame:
    """Method, dataset or task nodes; the written form becomes an alias where it differs."""
    rows = df.withColumn("__c", canonical_name(F.col(text), table))
    alias = F.when(F.lower(text) != F.lower("__c.name"), F.array(F.col(text))).otherwise(F.array().cast("array<string>"))
    return node(rows, F.concat(F.lit(kind.lower() + ":"), slugify(F.col("__c.name"))), F.col("__c.name"), kind, {"confidence": F.col("__c.confidence")}, alias, F.col(seq))


def short_label(text: Column, most: int = 80) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def statement_nodes(df: DataFrame, kind: str, prefix: str, text: str = "extracted_text") -> DataFrame:
    """Claim, finding, limitation or direction nodes, labelled by the beginning of the sentence."""
    return node(df, F.concat(F.lit(prefix + ":"), F.col("id")), short_label(F.col(text)), kind, {"text": F.col(text), "paper_id": F.col("paper_id")}, seq=F.col("id"))


def topic_nodes(topics: DataFrame) -> DataFrame:
    return node(topics, F.concat(F.lit("topic:"), F.col("topic_id")), F.col("topic_name"), "Topic", {"status": F.col("status"), "paper_count": F.col("paper_count")}, seq=F.col("topic_id"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: the first row by seq wins, aliases are united; an alias counts once before a node's are gathered."""
    first = F.min_by(F.struct("label", "type", "properties"), F.struct(F.col("seq"), F.col("label")))
    merged = nodes.groupBy("id").agg(first.alias("n"), F.min("seq").alias("seq"))
    names = nodes.select(F.col("id").alias("__id"), F.explode("aliases").alias("a")).distinct().groupBy("__id").agg(F.array_sort(F.collect_list("a")).alias("aliases"))
    none = F.array().cast(nodes.schema["aliases"].dataType)
    joined = merged.join(names, F.col("id").eqNullSafe(F.col("__id")), "left")
    return joined.select("id", "n.label", "n.type", "n.properties", F.coalesce("aliases", none).alias("aliases"), "seq")


def edge(df: DataFrame, source: Column, target: Column, relationship: Column, confidence: Column, paper_id: Column, text: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Edge rows: id, source, target, relationship, confidence held in 0 to 1 and rounded, origin."""
    sure = F.round(F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(1.0)), 4)
    return df.select(
        F.concat(source, F.lit("->"), relationship, F.lit("->"), target).alias("id"), source.alias("source"), target.alias("target"), relationship.alias("relationship"), sure.alias("confidence"),
        paper_id.cast("long").alias("paper_id"), (text if text is not None else F.lit(None).cast("string")).alias("source_text"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"),
    )


#: Edges of one task, about, edges of one share of an end, and groups of ends whose edges are counted.
EDGE_BLOCK, END_SHARE, END_GROUPS = 1 << 19, 1 << 15, 1 << 16


def _end_group(end: str) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(END_GROUPS)).cast("int")


def _crowds(edges: DataFrame) -> tuple[int, dict[str, list]]:
    """Tasks for the edges, and per end (source, target) the groups of ends with more than END_SHARE edges, with their number of shares.

    One pass counts; the groups are a fixed number. Spark's own number of shuffle partitions is the least, as a join takes no fewer.
    """
    spark = edges.sparkSession
    ends = edges.select(F.inline(F.array(*[F.struct(F.lit(end).alias("end"), _end_group(end).alias("g")) for end in ("source", "target")])))
    counts = ends.groupBy("end", "g").agg(F.count("*").alias("n"))
    shares = F.when(F.col("n") > END_SHARE, F.struct("g", F.ceil(F.col("n") / END_SHARE).cast("int").alias("k")))
    found = {r["end"]: r for r in counts.groupBy("end").agg(F.sum("n").alias("n"), F.collect_list(shares).alias("crowds")).collect()}
    n = found["source"]["n"] if found else 0
    return max(-(-n // EDGE_BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))), {end: [tuple(c) for c in r["crowds"]] for end, r in found.items()}


def _dealt_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Edges whose ends are both nodes, and the columns by which they lie in tasks: the target and, if some are crowded, the share.

    A topic or a method may be the end of a good part of all edges. Their edges go to shares by their other end, which
    meet copies of the node; all edges of a pair are in one share.
    """
    spark, columns, ids = edges.sparkSession, edges.columns, nodes.select("id").distinct()
    tasks, crowds = _crowds(edges)
    for end, other in (("source", "target"), ("target", "source")):
        left, right, keys = edges.select(*columns), ids.withColumnRenamed("id", end), [end]
        if crowds.get(end):
            shares = F.broadcast(spark.createDataFrame(pa.table([pa.array(c, pa.int32()) for c in zip(*crowds[end])], names=["__g", "__k"])))
            dealt = lambda df, end=end, shares=shares: df.withColumn("__g", _end_group(end)).join(shares, "__g", "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
            left = dealt(left).withColumn("__share", F.pmod(F.xxhash64(other), F.col("__k")).cast("int")).drop("__g", "__k")
            right = dealt(right).select(end, F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("__share"))
            keys = [end, "__share"]
        edges = left.repartition(tasks, *keys).hint("merge").join(right.repartition(tasks, *keys), keys, "left_semi")
    return edges.select(*columns, *keys[1:]), keys


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes, without a pass that counts them."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def merge_edges(edges: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One edge a pair: in order of seq, the same relation keeps the surer (the earlier on ties), another replaces.

    So the last run of the final relation counts: its surest edge, the first of these. Windows over rows
    sorted once find the run and that edge, no list of a pair's edges is built. ``within`` names columns that the edges of
    a pair share and by which they lie in tasks already.
    """
    own = [c for c in within or [] if c not in ("source", "target")]
    pair = Window.partitionBy("source", "target", *own)
    order = pair.orderBy("seq", "id")
    last = F.last("relationship").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    other = F.max(F.when(F.col("relationship") != F.col("__last"), F.col("__n"))).over(pair)
    rows = edges.withColumn("__last", last).withColumn("__n", F.row_number().over(order)).withColumn("__o", other)
    rows = rows.where((F.col("relationship") == F.col("__last")) & (F.col("__n") > F.coalesce("__o", F.lit(0))))
    best = rows.withColumn("__best", F.max(F.struct(F.col("confidence"), (-F.col("__n")).alias("at"))).over(pair))
    return best.where("__n = -__best.at").select(*[c for c in edges.columns if c not in own])


#: References, and papers, of one block of a title, and pairs that one task lists, about.
TITLE_BLOCK, TASK_PAIRS = 2048, 1 << 26


def citation_edges(references: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers whose title a reference gives.

    A title that many references give or many papers bear is dealt to blocks of TITLE_BLOCK of either, and each pair of blocks
    meets in one task. So no task buffers more than a block, and pairs come block by block: a column holds few values over
    millions of pairs, which a file of them keeps once. Such titles are few, one in TITLE_BLOCK rows at most. One pass counts them.
    """
    spark = papers.sparkSession
    key = lambda c: F.lower(F.trim(c))
    keyed = lambda df, *columns: df.select(*columns, key(F.col("title")).alias("k")).where(F.length("k") > 0).withColumn("h", F.xxhash64("k"))
    paper = lambda c: F.concat(F.lit("paper:"), F.col(c))
    given = keyed(references, "paper_id", "ref_index", paper("paper_id").alias("source"))
    titles = keyed(papers, F.col("id").alias("cited"), paper("id").alias("target"))
    counts = given.select("h", F.lit(1).alias("g"), F.lit(0).alias("t")).unionByName(titles.select("h", F.lit(0).alias("g"), F.lit(1).alias("t"))).groupBy("h").agg(F.sum("g").alias("g"), F.sum("t").alias("t"))
    blocks = lambda c: F.ceil(F.col(c) / TITLE_BLOCK).cast("int")
    crowded = F.when(F.greatest("g", "t") > TITLE_BLOCK, F.struct("h", blocks("g").alias("n"), blocks("t").alias("m")))
    found = counts.where("g > 0 and t > 0").agg(F.sum(F.col("g").cast("double") * F.col("t")).alias("pairs"), F.collect_list(crowded).alias("hot")).first()
    hot = F.broadcast(spark.createDataFrame([tuple(r) for r in found["hot"]], "h long, n int, m int"))
    dealt = lambda df: df.join(hot, "h", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("n", "m")})
    own = lambda count, *ids: F.pmod(F.xxhash64(*ids), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # a given number of tasks is kept, though the sides are small and the result large
    tasks = max(8 * spark.sparkContext.defaultParallelism, -(-int(found["pairs"] or 0) // TASK_PAIRS))
    meet = ["h", "b", "c", "k"]  # the hash first, as titles are slower to sort by
    left = dealt(given).select("paper_id", "ref_index", "source", "h", "k", own("n", "paper_id", "ref_index").alias("b"), every("m").alias("c")).repartition(tasks, *meet)
    right = dealt(titles).select("cited", "target", "h", "k", every("n").alias("b"), own("m", "cited").alias("c")).repartition(tasks, *meet)
    pairs = left.hint("merge").join(right, meet).where("paper_id <> cited")
    return edge(pairs, F.col("source"), F.col("target"), F.lit("cites"), F.lit(0.98), F.col("paper_id"), seq=F.col("ref_index"))


def method_relation(text: Column) -> Column:
    """Relation and confidence of a method mention, by the first kind of cue."""
    pick = lambda r, c: F.struct(F.lit(r).alias("relationship"), F.lit(c).alias("confidence"))
    return (
        F.when(matches(text, lexicon.PROPOSES_CUES), pick("proposes", 0.95))
        .when(matches(text, lexicon.EXTENDS_CUES), pick("extends", 0.90))
        .when(matches(text, lexicon.COMPARES_CUES), pick("compares", 0.85))
        .when(matches(text, lexicon.USES_CUES), pick("uses", 0.88))
        .otherwise(pick("uses", 0.75))
    )


#: Relation, confidence and id prefix of the edges from a paper to its extractions.
EXTRACTION_EDGES = {"DATASET": ("uses", 0.90, "dataset"), "LIMITATION": ("limited_by", 0.92, "limitation"), "OBJECTIVE": ("proposes", 0.88, "claim"), "RESULT": ("proposes", 0.90, "finding"), "FUTURE_WORK": ("proposes", 0.85, "direction")}


def extraction_edges(extractions: DataFrame, sentences: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges from papers to what was extracted from them; methods by the cues of their sentence."""
    rows = extractions.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").join(sentences.select(F.col("id").alias("sentence_id"), "source_text"), "sentence_id")
    kind, paper = F.col("extraction_type"), F.concat(F.lit("paper:"), F.col("paper_id"))
    name = slugify(canonical_name(F.col("extracted_text"))["name"])
    methods = rows.where(kind == "METHOD").withColumn("__r", method_relation(F.col("source_text")))
    out = edge(methods, paper, F.concat(F.lit("method:"), name), F.col("__r.relationship"), F.col("__r.confidence"), F.col("paper_id"), F.col("source_text"), F.col("id"))
    for k, (relation, sure, prefix) in EXTRACTION_EDGES.items():
        target = name if k == "DATASET" else F.col("id").cast("string")
        out = out.unionByName(edge(rows.where(kind == k), paper, F.concat(F.lit(prefix + ":"), target), F.lit(relation), F.lit(sure), F.col("paper_id"), F.col("extracted_text"), F.col("id")))
    return out


def membership_edges(assignments: DataFrame, topics: DataFrame) -> DataFrame:
    rows = assignments.join(topics.select("topic_id"), "topic_id", "left_semi")
    return edge(rows, F.concat(F.lit("paper:"), F.col("paper_id")), F.concat(F.lit("topic:"), F.col("topic_id")), F.lit("belongs_to"), F.greatest(F.lit(0.60), F.least(F.lit(1.0), F.col("probability"))), F.col("paper_id"), seq=F.col("paper_id"))


#: Sentences of a block on either side, and pairs that are handed on at a time, about.
SENTENCE_BLOCK, PAIRS = 16_384, 200_000


def shared_words(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(a, paper_id, b): keys of rows (key, paper_id, words) of different papers whose word sets share ``least`` words or more, words given as distinct hashes.

    Both sides are dealt to blocks; each pair of blocks meets in one task, which counts shared words through lists of
    the holders of each word and hands pairs on as it finds them. So no pair is held or shuffled for its check.
    """
    blocks = lambda df: -(-df.count() // SENTENCE_BLOCK) or 1
    n, m = blocks(left), blocks(right)
    n = max(n, min(-(-left.sparkSession.sparkContext.defaultParallelism * 2 // m), 64))  # all cores
    own = lambda df, count, name: df.withColumn(name, F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
    every = lambda df, count, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    a = every(own(left, n, "p"), m, "q").select("p", "q", F.lit(0).alias("side"), "key", "paper_id", "words")
    b = every(own(right, m, "q"), n, "p").select("p", "q", F.lit(1).alias("side"), "key", "paper_id", "words")

    def met(sides):
        (ka, pa_, wa), (kb, pb, wb) = ((np.array([r[0] for r in s], np.int64), np.array([r[1] for r in s], np.int64), [r[2] for r in s]) for s in sides)
        if not len(ka) or not len(kb):
            return
        codes = np.unique(np.concatenate(wb), return_inverse=True)
        owner = np.repeat(np.arange(len(wb)), [len(w) for w in wb])[np.argsort(codes[1], kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(codes[1], minlength=len(codes[0])))])
        x, own, y, size = [], [], [], 0
        for k, paper, w in zip(ka, pa_, wa):
            at = np.searchsorted(codes[0], w)
            at = at[(at < len(codes[0])) & (codes[0][np.minimum(at, len(codes[0]) - 1)] == w)]
            if len(at) < least:
                continue
            hit = np.nonzero(np.bincount(np.concatenate([owner[starts[i] : starts[i + 1]] for i in at]), minlength=len(kb)) >= least)[0]
            hit = hit[pb[hit] != paper]
            x.append(np.full(len(hit), k))
            own.append(np.full(len(hit), paper))
            y.append(kb[hit])
            size += len(hit)
            if size > PAIRS:
                yield out(x, own, y)
                x, own, y, size = [], [], [], 0
        if size:
            yield out(x, own, y)

    def out(*cells):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cells], names=["a", "paper_id", "b"])

    def run(batches):
        at, sides = None, ([], [])
        for batch in batches:
            words = batch.column(5)
            flat, ends = words.flatten().to_numpy(), np.cumsum([0, *words.value_lengths().to_pylist()])
            for i, (p, q, side, key, paper) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (p, q) != at:
                    yield from met(sides)
                    at, sides = (p, q), ([], [])
                sides[side].append((key, paper, flat[ends[i] : ends[i + 1]]))
        yield from met(sides)

    rows = a.unionByName(b).where(F.size("words") >= least).where("paper_id is not null")
    return map_batches(rows.repartition(max(n * m, 1), "p", "q").sortWithinPartitions("p", "q"), run, "a long, paper_id long, b long")


def address_edges(sentences: DataFrame, limitations: DataFrame, cues: str | None = None, least: int = 2, with_text: bool = True) -> DataFrame:
    """Sentences with a solving verb that share ``least`` words of 4 letters or more with another paper's limitation.

    The cue filter comes first. Sentences meet limitations in blocks (``shared_words``), by 64-bit hashes of their words.
    Without ``with_text`` the edges come without the text of their sentence, and no pair is shuffled.
    """
    solving = sentences.where(matches(F.col("source_text"), cues or lexicon.SOLVING_VERBS))
    long = lambda c: F.transform(F.array_distinct(whole_words(F.col(c), "[\\p{L}\\p{N}_]{4,}")), lambda w: F.xxhash64(w))
    a = stored(solving.select("id", "paper_id", long("source_text").alias("words")), "solving")
    b = stored(limitations.select("id", "paper_id", long("extracted_text").alias("words")), "limitations")
    key = lambda df: df.select(F.col("id").alias("key"), "paper_id", "words")
    found = shared_words(key(a), key(b), least).select(F.col("a").alias("id"), "paper_id", F.col("b").alias("lim_id"))
    found = found.join(sentences.select("id", "source_text"), "id") if with_text else found.withColumn("source_text", F.lit(None).cast("string"))
    return edge(found, F.concat(F.lit("paper:"), F.col("paper_id")), F.concat(F.lit("limitation:"), F.col("lim_id")), F.lit("addresses"), F.lit(0.88), F.col("paper_id"), F.col("source_text"), F.col("id"))


def align_claims(pairs: DataFrame) -> DataFrame:
    """supports or contradicts edges of claim pairs (source, target, source_text, target_text, similarity); others go."""
    cue = lambda p: matches(F.col("source_text"), p) | matches(F.col("target_text"), p)
    s = F.col("similarity")
    against, pro = cue(lexicon.CONTRADICTS_CUES), cue(lexicon.SUPPORTS_CUES) | (s >= 0.75)
    relation = F.when(against, "contradicts").when(pro, "supports")
    sure = F.when(against, F.when(s > 0, F.least(F.lit(0.95), s + 0.1)).otherwise(0.85)).otherwise(F.least(F.lit(0.95), s))
    rows = pairs.withColumn("__rel", relation).where("__rel is not null")
    return edge(rows, F.col("source"), F.col("target"), F.col("__rel"), sure, F.lit(None), F.col("source_text"))


def build_graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The merged graph of node and edge tables in order of arrival."""

    def stacked(frames):
        out = None
        for n, f in enumerate(frames):
            f = f.withColumn("seq", F.lit(n).cast("long") * (1 << 40) + F.col("seq"))
            out = f if out is None else out.unionByName(f)
        return out

    merged = merge_nodes(stacked(nodes))
    return merged, merge_edges(*_dealt_edges(stacked(edges), merged))


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared scratch folder and read back, and the path of the table."""
    path = scratch_path(df.sparkSession, f"graph-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by the smallest id, by label passing with pointer jumping.

    Rounds go on until no label moves, which the driver sees as one flag a round. Each round is
    written to the shared scratch folder and the table of the round before is deleted.
    """
    spark = nodes.sparkSession
    both, edges_path = _cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"))).where("u <> v").distinct())
    labels, path = nodes.select("id", F.col("id").alias("component")).distinct(), None
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        moved, next_path = _cut(hooked.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("top", "component")).alias("component")))
        if path:
            delete_path(spark, path)
        labels, path = moved.select("id", "component"), next_path
        if moved.where("old <> component").isEmpty():
            delete_path(spark, edges_path)
            return labels


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): node and edge counts by type, totals, and the density as parts of a million."""
    by = nodes.groupBy(F.col("type").alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("n"))
    rel = edges.groupBy(F.col("relationship").alias("name")).count().select(F.lit("edge").alias("kind"), "name", F.col("count").alias("n"))
    both = by.unionByName(rel).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    return both.unionByName(both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("total").alias("name"), "n"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    size = F.col("n") * (F.col("n") - 1)
    return n.crossJoin(m).select("n", "m", F.when(F.col("n") > 1, F.round(F.col("m") / size, 6)).otherwise(0.0).alias("density"))  # one row each


def ego(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(id, hop): nodes within ``hops`` steps of the seeds, both directions, with the least number of steps."""
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v")))
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for k in range(1, hops + 1):
        front = front.join(both.withColumnRenamed("u", "id"), "id").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = nodes.join(ids.select("id"), "id", "left_semi")
    return own, valid_edges(edges, own)


def filter_graph(nodes: DataFrame, edges: DataFrame, kind: str | None = None, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    kept = nodes if kind is None else nodes.where(F.col("type") == kind)
    if text:
        kept = kept.where(F.lower("label").contains(text.lower()) | F.lower("type").contains(text.lower()))
    return induced(kept, edges, kept)


def merge_egos(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several ego networks as one: nodes once by id (the first), edges of all."""
    nodes = edges = None
    for n, (a, b) in enumerate(parts):
        a = a.withColumn("__p", F.lit(n))
        nodes = a if nodes is None else nodes.unionByName(a)
        edges = b if edges is None else edges.unionByName(b)
    first = Window.partitionBy("id").orderBy("__p")
    return nodes.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__p", "__r"), edges


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(id, rank): PageRank over ``rounds`` rounds; what dangling nodes hold is spread over all."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    out = edges.groupBy("source").agg(F.count("*").alias("deg"))
    spark = nodes.sparkSession
    links, links_path = _cut(edges.select("source", "target").join(out, "source"))
    ranks, path = ids.withColumn("rank", F.lit(1.0 / max(1, n))), None
    for _ in range(rounds):
        flow = links.join(ranks.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        dangling = ranks.join(out.select(F.col("source").alias("id")), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * dangling / n
        ranks, next_path = _cut(ids.join(flow, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        if path:
            delete_path(spark, path)
        path = next_path
    delete_path(spark, links_path)
    return ranks


def cypher_text(value: Column) -> Column:
    """A quoted string literal: backslashes and quotes are escaped, line ends written as such."""
    for sign, put in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(sign), F.lit(put))
    return F.concat(F.lit("'"), value, F.lit("'"))


def export_cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One MERGE statement a node and an edge, as rows of text; a node gets all its properties, names that are no words in backticks.

    Properties without a value are left out; without any the node gets its label only.
    """
    key = lambda k: F.when(k.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), k).otherwise(F.concat(F.lit("`"), F.replace(k, F.lit("`"), F.lit("``")), F.lit("`")))
    entries = F.filter(F.map_entries("properties"), lambda e: e["value"].isNotNull())
    own = F.transform(F.array_sort(entries), lambda e: F.concat(key(e["key"]), F.lit(": "), cypher_text(e["value"])))
    label = F.array(F.concat(F.lit("label: "), cypher_text(F.coalesce("label", F.lit("")))))
    props = F.array_join(F.when(F.size(own) > 0, own).otherwise(label), ", ")
    kind = F.coalesce("type", F.lit("Entity"))
    a = nodes.select(F.lit(0).alias("part"), "id", F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), cypher_text(F.col("id")), F.lit("}) SET n += {"), props, F.lit("};")).alias("statement"))
    relation = F.upper(F.coalesce("relationship", F.lit("RELATED_TO")))
    link = F.concat(F.lit("MATCH (a {id: "), cypher_text(F.col("source")), F.lit("}), (b {id: "), cypher_text(F.col("target")), F.lit("}) MERGE (a)-[r:"), relation, F.lit(" {confidence: "), F.coalesce("confidence", F.lit(1.0)).cast("string"), F.lit("}]->(b);"))
    return a.unionByName(edges.select(F.lit(1).alias("part"), "id", link.alias("statement")))


def provenance(paper_id: Column, title: Column, sentence_id: Column, section: Column, page: Column, text: Column, confidence: Column, method: Column) -> Column:
    return F.struct(
        paper_id.alias("paper_id"), title.alias("paper_title"), sentence_id.alias("sentence_id"), F.coalesce(section, F.lit("General")).alias("section_name"), F.coalesce(page, F.lit(1)).alias("page_number"),
        text.alias("source_text"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"), method.alias("extraction_method"),
    )


def provenance_gaps(df: DataFrame, column: str = "provenance") -> DataFrame:
    """Rows whose provenance names neither a paper nor a text."""
    return df.where(F.col(f"{column}.paper_id").isNull() & (F.length(F.coalesce(F.col(f"{column}.source_text"), F.lit(""))) == 0))


def cite(title: Column, section: Column, page: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("Unknown paper")), F.lit(", "), section, F.lit(", p. "), page.cast("string"))
