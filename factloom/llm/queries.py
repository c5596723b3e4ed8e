"""The registered queries of this folder: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    chat, fingerprints, langid, negatives, neighbours, packing, pieces, quality, sharding, simhash,
    toxicity, warc, whitening,
)
from .common import table


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.into_shards(table(spark, folder, "documents"), 16)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, folder, "documents"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(table(spark, folder, "documents"), path)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.formatted(table(spark, folder, "conversations"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, folder, "documents"), path)


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(table(spark, folder, "documents"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mined(table(spark, folder, "embeddings"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_neighbours": op5_neighbours,
    "op6_pieces": op6_pieces,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_negatives": op11_negatives,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}

#: SQL with another method: whole prefixes as strings instead of hashes.
CHECKS: dict[str, str] = {
    "op8_chat": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
                row_number() OVER (
                    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')
                ) AS place
            FROM conversations),
        shown AS (
            SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10)
                || replace(body, '<|', '< |') || '<|im_end|>' || chr(10) AS line
            FROM turns),
        prefixes AS (
            SELECT *, sum(length(line)) OVER upto AS chars, count(*) OVER (PARTITION BY conv_id) AS n,
                string_agg(role || chr(31) || body, chr(30)) OVER upto AS prefix
            FROM shown
            WINDOW upto AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
        longer AS (SELECT DISTINCT place, prefix FROM prefixes WHERE place < n),
        kept AS (
            SELECT min(conv_id) AS conv_id, count(*) AS copies FROM prefixes p
            WHERE place = n AND NOT EXISTS (
                SELECT 1 FROM longer l WHERE l.place = p.place AND l.prefix = p.prefix)
            GROUP BY place, prefix)
        SELECT conv_id, CAST((chars - length(line)) // 1000000 AS INT) AS part, copies,
            count(*) AS turns, string_agg(line, '' ORDER BY place) AS text
        FROM prefixes JOIN kept USING (conv_id) GROUP BY ALL""",
    "op11_negatives": """
        WITH good AS (
            SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
            FROM embeddings
            WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
                CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]) AS BIGINT) AS score
            FROM good a JOIN good b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
            CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_warc": """
        WITH held AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        kept AS (
            SELECT *, CASE WHEN payload_bytes >= 1000
                THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS best
            FROM held)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN best IS NULL OR best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN best IS NOT NULL AND best IS DISTINCT FROM page_id THEN best END AS refers_to
        FROM kept""",
}
