"""The operators of this subpackage as queries over the test tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.catalog import load
from quern.llm import bpe, embedding_dedup, flac, katz, license_scan, license_texts, packing, pii_feistel, quality_gam, ranked_search, sharding, simhash_dedup, token_alignment, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), pii_feistel.key_of(spark))


@_query
def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, load(spark, sf_dir, "labels")))


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(load(spark, sf_dir, "pages"))


ORACLES["op4_warc_transactions"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN o.original IS NOT NULL AND o.original <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.original <> d.page_id THEN o.original END AS refers_to,
       CAST(1 AS BIGINT) AS n_requests
FROM d LEFT JOIN o USING (payload_digest)
"""


@_query
def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(load(spark, sf_dir, "documents"))


@_query
def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(load(spark, sf_dir, "documents"))


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(load(spark, sf_dir, "documents"))


@_query
def op9_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(load(spark, sf_dir, "documents"))


@_query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


ORACLES["op10_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.y, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""


@_query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"), license_texts.TEMPLATES, license_texts.PHRASES).drop("spans")


@_query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM low),
sized AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM found WHERE len(ts) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM sized) GROUP BY doc_id, n, term),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, nd),
s AS (SELECT q.item_id, tf.doc_id,
             CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * nd) // l)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), whole GROUP BY q.item_id, tf.doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
