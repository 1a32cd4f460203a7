"""The subpackage's registered queries: thin forms of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, bt_quality, budget_mix, certified_packing, dart_minhash, diagonal_license, importance_resampling, info_pii, mpegts_media, slot_sharding, trie_dedup, voronoi_negatives, warc_chain
from .common import documents, labels

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public tokenizer's file; a parameter of the packing operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(documents(spark, sf_dir))


def op2_bt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt_quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slot_sharding.shard_by_slots(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op4_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix(documents(spark, sf_dir))


def op5_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certified_packing.pack(documents(spark, sf_dir), tokenizer_path())


def op6_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.classes(documents(spark, sf_dir), largest=True).drop("text_hash")


def op7_diagonal_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonal_license.scan(documents(spark, sf_dir))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(documents(spark, sf_dir)).drop("text_hash")


def op9_info_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info_pii.find(documents(spark, sf_dir)).drop("base", "text_key")


def op10_mpegts_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts_media.transport_streams(documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voronoi_negatives.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return voronoi_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_chain.through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "intact")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_brown_lm, op2_bt_quality, op3_slot_sharding, op4_budget_mix, op5_certified_packing, op6_trie_dedup, op7_diagonal_license, op8_dart_minhash, op9_info_pii, op10_mpegts_media, op11_importance_resampling, op12_voronoi_negatives, op13_warc_chain)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


#: crc32 byte by byte, by a table that the query makes itself.
_CRC_SQL = """
bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
steps AS (SELECT list(c ORDER BY i) AS step FROM bits)"""
_OP11_FEATURES = f"""
SELECT {{key}}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
FROM (SELECT {{key}}, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {{table}})"""
_OP11_NOISE = "('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT"
OP11_SQL = f"""
WITH {_CRC_SQL},
docs AS ({_OP11_FEATURES.format(key="doc_id", table="documents")}),
goal AS ({_OP11_FEATURES.format(key="item_id", table="benchmark")}),
names AS (SELECT DISTINCT f FROM (SELECT f FROM docs UNION ALL SELECT f FROM goal)),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, steps),
have AS (SELECT bucket, count(*) AS s FROM docs JOIN coded USING (f) GROUP BY bucket),
want AS (SELECT bucket, count(*) AS t FROM goal JOIN coded USING (f) GROUP BY bucket),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM have) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM want), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
          FROM range(10000) b(bucket) LEFT JOIN have h ON h.bucket = b.bucket LEFT JOIN want w ON w.bucket = b.bucket),
summed AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM docs JOIN coded USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_OP11_NOISE} + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score, coalesce(n_features, 0) + 1 >= 40 AS eligible
           FROM (SELECT doc_id FROM documents) d LEFT JOIN summed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE eligible)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, o.r AS o, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.q, o.q) AS BIGINT) AS score FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.r <> o.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, o) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.o ORDER BY s.score DESC, s.vec_id, s.o) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: SHA-1 in base32: 20 bits, five hexadecimal digits, are four of its digits.
_BASE32_SQL = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1 AS INTEGER), 1)), '')"
OP13_SQL = f"""
SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, true AS intact
FROM (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, CASE WHEN page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY t) THEN max(page_id) OVER (PARTITION BY t) END AS refers_to
      FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_trie_dedup": OP6_SQL, "op11_importance_resampling": OP11_SQL, "op12_voronoi_negatives": OP12_SQL, "op13_warc_chain": OP13_SQL}
