"""The registered query of each training-text operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, fim, hmm, langid, licenses, mixing, ordermin, packing, pii, simhash, toxicity, warc, whitening
from lacuna.llm.common import documents, shared_path


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordermin.fingerprint_edits(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        ordermin.as_text(F.col("fp")).alias("fingerprint"),
        ordermin.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        ordermin.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        ordermin.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return pii.report(pii.find(docs, pii.train(docs)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir, "doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_path(spark, "warc")
    warc.write_warc(warc.plan_records(pages), path)
    return warc.read_warc(spark, path).drop("url")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.by_component(whitening.whiten(vectors, model), model)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(documents(spark, sf_dir, "doc_id", "text"))
    restored = F.sha2(fim.restore(F.col("output"), F.col("form")).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), restored.alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_order_minhash, op2_packing, op3_pii, op4_decontamination, op5_licenses, op6_hmm, op7_simhash, op8_warc, op9_toxicity, op10_language, op11_whitening, op12_mixing, op13_fim, pipeline)}


def oracle_sql() -> dict[str, str]:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digest = f"array_to_string(list_transform(range(32), lambda i: substr('{letters}', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '')"
    return {
        "op8_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
                 f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
            SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {digest} AS payload_digest,
                   CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first_id THEN first_id END AS refers_to
            FROM p JOIN f USING (h)
        """,
        # the closed form of the mix: a source's target covers a prefix of its shuffled words, once or twice
        "op12_mixing": r"""
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents),
                 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
                 w AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
                 k AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                              / sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
                       FROM w WINDOW rising AS (ORDER BY cap / weight, source NULLS LAST)),
                 l AS (SELECT coalesce(min_by(level, cap / weight), 0) AS level FROM k WHERE cap > weight * level),
                 t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target, floor(least(cap::DOUBLE, weight * level) + 0.5)::BIGINT AS want FROM w, l),
                 p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
            SELECT doc_id, size, source_size, target,
                   CASE WHEN size > 0 THEN size * (want // source_size) + greatest(0, least(start + size, want % source_size) - start) ELSE 0 END::BIGINT AS taken
            FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
        """,
        "op13_fim": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
                 u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS k FROM d),
                 c AS (SELECT *, len(u) AS n, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS a, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS b,
                              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
                 x AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
                   sha256(t) AS restored_sha256
            FROM x
        """,
    }
