"""Registered queries of the operators on texts, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm.bpe import bpe_round_trip
from gridwarden.llm.common import read
from gridwarden.llm.decontaminate import SQL as CONTAMINATED_SQL
from gridwarden.llm.decontaminate import contaminated
from gridwarden.llm.html import extract_main_text
from gridwarden.llm.jaccard import jaccard_components
from gridwarden.llm.language import held_out, learn_and_identify
from gridwarden.llm.neardup import near_duplicates
from gridwarden.llm.negatives import mine_hard_negatives
from gridwarden.llm.periodic import find_runs
from gridwarden.llm.pii import find_personal_data
from gridwarden.llm.secrets import find_secrets
from gridwarden.llm.tiff import tiff_features
from gridwarden.llm.warc import warc_round_trip
from gridwarden.llm.wordpiece import count_pieces


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc_round_trip(read(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, profiles learned from the texts that are not held out."""
    found = learn_and_identify(read(spark, folder, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("score"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    return find_personal_data(read(spark, folder, "documents"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text."""
    return find_secrets(read(spark, folder, "documents"))


def op5_wordpiece(spark: SparkSession, folder: str) -> DataFrame:
    """Words and word pieces of every text."""
    return count_pieces(read(spark, folder, "documents"))


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(read(spark, folder, "pages"))


def op7_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all texts."""
    return near_duplicates(read(spark, folder, "documents"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in any text."""
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op10_tiff(spark: SparkSession, folder: str) -> DataFrame:
    """Every text stored as a TIFF file, read back and described."""
    return tiff_features(read(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    return bpe_round_trip(read(spark, folder, "documents"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every 50th vector against all vectors."""
    component = "x -> CASE WHEN abs(double(x)) < double('Infinity') THEN floor(256 * double(x)) END"
    rows = read(spark, folder, "embeddings").select(
        "vec_id",
        F.expr(f"transform(embedding, {component})").alias("vector"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""


def op12_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all texts linked by their four-word shingles."""
    return jaccard_components(read(spark, folder, "documents"))


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The planted repeats: every tenth id, by the checksum of its decimal form, gets a periodic tail."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every text, after the planted repeats."""
    return find_runs(read(spark, folder, "documents"), rewrite=repeat_tail)


QUERIES = {"op1_warc": op1_warc, "op2_language": op2_language, "op3_pii": op3_pii, "op4_secrets": op4_secrets, "op5_wordpiece": op5_wordpiece, "op6_html": op6_html, "op7_neardup": op7_neardup, "op8_decontaminate": op8_decontaminate, "op9_bpe": op9_bpe, "op10_tiff": op10_tiff}
QUERIES |= {"op11_negatives": op11_negatives, "op12_jaccard": op12_jaccard, "op13_runs": op13_runs}
ORACLES: dict[str, str] = {"op8_decontaminate": CONTAMINATED_SQL, "op11_negatives": NEGATIVES_SQL}
