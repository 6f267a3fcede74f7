"""The registered query of each operator: whole tables in, whole results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, near_dup, quality_nbsvm, quality_rules, sharding, substring_fm, substring_runs, warc
from .common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_nbsvm.score(docs, model).select("doc_id", quality_nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.predict(docs, model).select("doc_id", quality_nbsvm.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_fm.digest(table(spark, sf_dir, "documents"))


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.clusters(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op9_substring_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_runs.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_quality_nbsvm, op3_language_id, op4_byte_bpe, op5_substring_fm, op6_minhash_hamming, op7_decontaminate, op8_sharding, op9_substring_runs, op10_quality_rules)}
_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"
ORACLES: dict[str, str] = {
    "op1_warc_revisits": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages), o AS (SELECT digest, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to FROM p LEFT JOIN o ON p.digest = o.digest""",
    "op5_substring_fm": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), x AS (SELECT doc_id, list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' '))) AS hs FROM d WHERE len(ws) >= 20),
u AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS s FROM x), f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM u),
gone AS (SELECT DISTINCT doc_id, s + g AS pos FROM f, range(0, 20) t(g) WHERE rn > 1), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT w.doc_id, count(*) AS n, count(gone.pos) AS r, string_agg(CASE WHEN gone.pos IS NULL THEN w END, ' ' ORDER BY w.pos) AS kept FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op6_minhash_hamming": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s), l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), reach(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(c.m, s.doc_id)) = s.doc_id AS kept FROM s LEFT JOIN c ON s.doc_id = c.a""",
}
