"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import forest, minhash, mixing, mixing_lm, packing, substring, tokens, toxicity, transport, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    return toxicity.score_documents(docs, toxicity.fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.store_texts(_table(spark, sf_dir, "documents"))


def op6_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_edited(tokens.sample_edits(_table(spark, sf_dir, "documents")))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_vector_forest, op3_minhash, op4_substring, op5_transport_stream, op6_edited_token_counts, op7_context_mixing, op8_urls, op9_poisson_mixing, op10_packing)}

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_vector_forest": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM v
  UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT id AS vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, id = c AS kept FROM m LEFT JOIN n ON a = id""",
    "op3_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), p AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, id = c AS kept FROM m LEFT JOIN n ON n.doc_id = id""",
    "op4_substring": rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), s AS (SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50)
), f AS (SELECT g, min(doc_id) AS lo FROM s GROUP BY g
), gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM s JOIN f USING (g) WHERE doc_id > lo
), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_poisson_mixing": """
WITH RECURSIVE b AS (SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY source
), t AS (SELECT sum(bytes)::BIGINT AS total, count(*) FILTER (bytes > 0) AS n FROM b
), rate AS (SELECT source, CASE WHEN bytes > 0 THEN 1.0::DOUBLE / n * 1.0::DOUBLE * total / bytes ELSE 0 END AS rate FROM b, t
), cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS s FROM rate
  UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), s + term * rate / (k + 1) FROM cdf WHERE k < 60
), u AS (SELECT doc_id, text, source, ('0x' || substr(md5('0|count|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents
), n AS (SELECT doc_id, text, u.source, count(*) AS n FROM u JOIN cdf ON cdf.source = u.source AND u.u >= cdf.s GROUP BY ALL
), c AS (SELECT doc_id, text, source, unnest(range(0, n))::INTEGER AS copy FROM n)
SELECT doc_id, text, source, copy, md5('0|order|' || doc_id || '|' || copy) AS shuffle_key FROM c""",
}
