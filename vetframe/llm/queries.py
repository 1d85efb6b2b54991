"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, exactdedup, hmm, languageid, licences, packing, quality, sharding, simhash, toxicity

TOKENIZER = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.read_table(spark, sf_dir, "documents")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, _documents(spark, sf_dir), common.read_table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languageid.identify(spark, _documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(spark, _documents(spark, sf_dir))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, _documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op10_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.mark_duplicates(spark, _documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_toxicity, op3_language, op4_bpe, op5_hmm, op6_licences, op7_sharding, op8_simhash, op9_quality, op10_exactdedup)
}


def _crc_step(four_bits: int) -> int:
    """What CRC-32 makes of four bits."""
    for _ in range(4):
        four_bits = four_bits >> 1 ^ (0xEDB88320 if four_bits & 1 else 0)
    return four_bits


_CRC_STEPS = [_crc_step(i) for i in range(16)]

ORACLE_SQL: dict[str, str] = {
    # one row of ``search`` is one greedy shard at one capacity; slots are those of up to 50,000 rows a shard, one bucket
    "op7_sharding": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(coalesce(text, '')) AS grp,
                   xor(list_reduce(list_prepend(4294967295::BIGINT,
                           list_transform(regexp_extract_all(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), '.'),
                                          lambda h: ('0x' || h)::BIGINT)),
                       lambda c, h: xor(c >> 4, {_CRC_STEPS}[1 + (xor(c, h) & 15)])), 4294967295::BIGINT) AS text_crc32
            FROM documents),
        g AS (SELECT grp, sum(size)::BIGINT AS size FROM d GROUP BY grp),
        p AS (SELECT grp, (sum(size) OVER (ORDER BY grp))::BIGINT AS upto FROM g),
        t AS (SELECT sum(size)::BIGINT AS total, greatest(max(size), (sum(size)::BIGINT + 7) // 8) AS least FROM g),
        search AS (
            SELECT least AS low, total AS high, (least + total) // 2 AS capacity, 0::BIGINT AS done, 0 AS shards FROM t
            UNION ALL
            SELECT new_low, new_high, CASE WHEN ends THEN (new_low + new_high) // 2 ELSE capacity END,
                   CASE WHEN ends THEN 0 ELSE reached END, CASE WHEN ends THEN 0 ELSE shards + 1 END
            FROM (SELECT *, reached = total OR shards = 7 AS ends,
                         CASE WHEN shards = 7 AND reached < total THEN capacity + 1 ELSE low END AS new_low,
                         CASE WHEN reached = total THEN capacity ELSE high END AS new_high
                  FROM (SELECT s.low, s.high, s.capacity, s.shards, t.total, max(p.upto) AS reached
                        FROM search s, t, p WHERE s.low < s.high AND p.upto <= s.done + s.capacity
                        GROUP BY ALL))),
        best AS (SELECT low AS capacity FROM search WHERE low = high LIMIT 1),
        cuts AS (
            SELECT 1 AS shard, max(upto) AS cut FROM p, best WHERE upto <= capacity
            UNION ALL
            SELECT c.shard + 1, max(p.upto) FROM cuts c, best, p WHERE c.shard < 7 AND p.upto <= c.cut + capacity GROUP BY c.shard),
        placed AS (SELECT grp, (SELECT count(*) FROM cuts WHERE cut < upto)::INTEGER AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, grp) - 1 AS slot,
               CAST(NULL AS INTEGER) AS grown_shard
        FROM d JOIN placed USING (grp)
    """,
    "op10_exactdedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
}
