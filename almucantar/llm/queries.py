"""The queries ``opN_<name>`` and ``pipeline`` for the driver, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from almucantar.llm import decontaminate, langid, minhash, nearest, packing, secrets, shared, substrings, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    folder = shared.new_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of all documents with benchmark items."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth embedding."""
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labels of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, net).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on three-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, per_cent=85)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to files and read back."""
    folder = shared.new_dir(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    pred = langid.identify(docs, model)
    return pred.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that earlier ones have."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {
        "op1_warc": op1_warc,
        "op2_decontaminate": op2_decontaminate,
        "op3_nearest": op3_nearest,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_minhash": op6_minhash,
        "op7_secrets": op7_secrets,
        "op8_token_files": op8_token_files,
        "op9_langid": op9_langid,
        "op10_substrings": op10_substrings,
        "pipeline": corpus_pipeline.run,
    }


_OP1 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

_OP10 = """
WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l, strlen(coalesce(text, '')) AS n FROM documents
), c AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS j FROM b
), w AS (SELECT doc_id, j, x, string_agg(x, '') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS g FROM c
), f AS (SELECT g, min(doc_id) AS least FROM w WHERE strlen(g) = 100 GROUP BY 1
), m AS (
  SELECT w.doc_id, j, x, coalesce(j - max(CASE WHEN w.doc_id > least THEN j END) OVER (PARTITION BY w.doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) < 50, false) AS gone FROM w LEFT JOIN f USING (g)
), k AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY j) AS was FROM m
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT was) AS n_spans, string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY 1
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN a USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"op1_warc": _OP1, "op6_minhash": _OP6, "op10_substrings": _OP10}
