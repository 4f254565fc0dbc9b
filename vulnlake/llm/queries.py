"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints
from .clusters import cluster_vectors
from .common import documents
from .exact_dedup import exact_dedup
from .langid import fit_dictionaries, held_out, identify, training_rows
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dedup import near_duplicates
from .prefix_trie import conversation_trie
from .query_sql import OP12_SQL, OP13_SQL
from .sentencepiece_codec import encode_documents, load_codec
from .substring_dedup import remove_repeated_windows
from .suffix_dedup import remove_repeated_bytes
from .token_output import tokenize_documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit_dictionaries(training_rows(docs))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), load_codec(_vocabulary("piece_bpe_32k.model")), with_ids=False)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokenize_documents(docs, _vocabulary("word_bpe_49k.json"), with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.neighbour_fingerprints(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprints.encoded(F.col("sketch")).alias("fingerprint"),
        fingerprints.encoded(F.col("edited_sketch")).alias("edited_fingerprint"), fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_bytes(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=(5, 9))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_near_dedup, op3_substring_dedup, op4_sentencepiece, op5_token_output, op6_exact_dedup, op7_fingerprints, op8_mix_sources, op9_suffix_dedup, op10_license_scan,
        op11_line_dedup, op12_cluster_vectors, op13_conversation_trie,
    )
}

OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 3 AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
         CAST(sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM s
), l AS (
  SELECT capped AS c, rest AS q FROM r WHERE (total - capped) * w <= cap * rest ORDER BY capped, rest LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST((total - c) * w AS DOUBLE) / q) AS target FROM r, l
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM y
"""

OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), k AS (
  SELECT doc_id, place, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT k.doc_id, k.place, k.line, often.last IS NOT NULL AND often.last <> k.doc_id AS gone FROM k LEFT JOIN often ON k.key = often.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

ORACLE_SQL = {"op11_line_dedup": OP11_SQL, "op12_cluster_vectors": OP12_SQL, "op13_conversation_trie": OP13_SQL, "op6_exact_dedup": OP6_SQL, "op8_mix_sources": OP8_SQL}
