"""The registered queries of this subpackage, and their check SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm import (
    check_sql, fingerprints, license_scan, lm_scoring, mixing, near_dedup, packing, pseudonyms, quality_rules, secret_scan,
    spelling, substring_dedup, url_filter, vector_codes,
)
from shelfprice.llm.common import table

Plan = Callable[[SparkSession, str], DataFrame]

#: Key of the registered queries, for tests only: whoever knows it can undo the pseudonyms.
TEST_KEY = "public key of the registered queries, only for test data"
PSEUDONYM_KEY = os.environ.get("PSEUDONYM_KEY") or TEST_KEY


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op2_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its private strings replaced, and how many of each kind there were."""
    return pseudonyms.pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix of sources takes of every document."""
    return mixing.mix(table(spark, folder, "documents"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    return fingerprints.edited_pairs(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page by rules and by the trust of its host."""
    return url_filter.judged(table(spark, folder, "pages"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document, how many repeat earlier text, and a checksum of those that are kept."""
    return substring_dedup.removed(table(spark, folder, "documents"), with_text=False).drop("kept")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every document, whether a base rule fails, and whether it is kept."""
    found = quality_rules.quality(table(spark, folder, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses that the sentences of every document name."""
    return license_scan.scan(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-likelihood of every whole document under the language model and under word frequencies."""
    return lm_scoring.scores(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling.variants(table(spark, folder, "documents"))


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    return secret_scan.secrets(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code of every vector, its error and that of its label, and a checksum of the codebooks."""
    found, books = vector_codes.codes(table(spark, folder, "embeddings"))
    checksum = vector_codes.checksum(books) if books is not None else None
    return found.select("vec_id", "code", "error", "label_error", F.lit(checksum).cast("string").alias("codebooks_sha256"))


QUERIES: dict[str, Plan] = {f.__name__: f for f in (
    op1_near_dedup, op2_pseudonyms, op3_mixing, op4_fingerprints, op5_url_filter, op6_substring_dedup,
    op7_quality_rules, op8_license_scan, op9_packing, op10_lm_scoring, op11_spelling_variants, op12_secret_scan, op13_vector_codes,
)}

ORACLE_SQL: dict[str, str] = check_sql.ORACLE_SQL
