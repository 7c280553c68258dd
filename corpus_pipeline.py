"""Documents to token ids: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all
but the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again, so a lost executor never repeats an earlier stage.

Defined results: a row without an id cannot be named by the near-duplicate and benchmark stages and stays; rows
that repeat an id are one document and stay or go together; a null text has no language and goes; an
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm.bpe import bpe_round_trip
from gridwarden.llm.common import drop_columns_of, free_names, read
from gridwarden.llm.decontaminate import contaminated
from gridwarden.llm.language import UNKNOWN, identify, learn_profiles
from gridwarden.llm.neardup import near_duplicates
from gridwarden.llm.pii import find_personal_data
from gridwarden.session import cut_lineage

#: A text whose most frequent n-grams are this far from every language is in none of them.
LEAST_SCORE = 0.2
#: Shingle words and similarity in percent of the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _without(docs: DataFrame, ids: DataFrame, purpose: str) -> DataFrame:
    """Rows whose id is not among ``ids``; these are stored, so that Spark knows their size before it joins."""
    return docs.join(cut_lineage(ids.select("doc_id").distinct(), purpose), "doc_id", "left_anti").select(*docs.columns)


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """Columns that have the names of made ones under other names, and how to name them again."""
    clash = [c for c in docs.columns if c.lower() in {m.lower() for m in made}]
    other = dict(zip(clash, free_names([*docs.columns, *made], *[f"kept_{c}" for c in clash]), strict=True))
    return docs.withColumnsRenamed(other), {o: c for c, o in other.items()}


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages learned from the table itself; others and texts without a letter go."""
    safe, names = _aside(docs, "lang_pred", "score")
    found = identify(safe, learn_profiles(docs), keep=safe.columns)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*safe.columns).withColumnsRenamed(names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates."""
    found = near_duplicates(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    return _without(docs, found.filter(~F.col("kept")), "near-dropped")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return _without(docs, contaminated(docs, read(spark, sf_dir, "benchmark")), "bench-dropped")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    safe, names = _aside(docs, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked")
    found = find_personal_data(safe, keep=drop_columns_of(safe.schema, "text", "n_chars"), with_masked=True)
    found = found.withColumn("text", F.col("masked")).withColumn("n_chars", F.char_length("masked").cast("long"))
    return found.select(*safe.columns).withColumnsRenamed(names)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of ids and decoded bytes, token_ids."""
    return bpe_round_trip(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language_id", keep_known_language),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode_tokens),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
