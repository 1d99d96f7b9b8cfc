"""A corpus from documents to packed sequences; each stage works on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitloom.llm import langid, mixing, pack, secret_scan, simhash
from habitloom.llm.queries import (
    END_ID, MAX_OWNERS, MAX_REPETITION, MAX_REPOSITORIES, MIX_SEED, SEQUENCE_LENGTH, fitted_languages, n_words, table, tokenizer_path,
)
from habitloom.session import materialize

SIMILARITY = 0.8
# Fingerprints only form groups, whose shingles are then compared. Near copies differ in about 10 bits
# of the first word; one in a thousand in more than 22.
FINGERPRINT_WORDS = 4
FIRST_RADIUS = 22
# Standard deviations beyond the bits in which texts of just that similarity differ.
MARGIN = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without any letter or less like any learned language than its labelled texts go."""
    columns, model = docs.columns, fitted_languages(docs)
    limits = langid.limits(docs.where(langid.held_out(F.col("doc_id"))), model)
    evidence = ("_lang_log", "_lang_letters", "_lang_words")
    found = langid.predict(docs, model, ("_lang_pred", "_lang_score"), evidence)
    return found.where((F.col("_lang_pred") != "und") & langid.has_evidence(limits, "_lang_pred", *evidence)).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id: a share of 0.8 or more of their 5-word shingles in common."""
    radius = simhash.radius_for(SIMILARITY, 64 * FINGERPRINT_WORDS, MARGIN)
    return simhash.deduplicate(docs, radius, shingle=5, seed=42, size=FINGERPRINT_WORDS, first_radius=FIRST_RADIUS, similarity=SIMILARITY)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced by a mark; random-looking keys only if few sources and documents hold them."""
    return secret_scan.redact(docs, "doc_id", "source", MAX_OWNERS, max_repositories=MAX_REPOSITORIES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to the repetition limit, in the order of the mixture."""
    mixed = mixing.mix(docs, n_words(), "repetition", MAX_REPETITION, None, MIX_SEED, ("_epoch", "_place", "_weight"))
    return mixed.repartitionByRange("_place", "doc_id").sortWithinPartitions("_place", "doc_id").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences with their token ids, in the order in which the mixture was written."""
    return pack.pack(docs, tokenizer_path(), END_ID, SEQUENCE_LENGTH, stored=True)


STAGES = [
    ("language", identify_language), ("near_copies", drop_near_copies), ("secrets", redact_secrets),
    ("mixture", mix_sources), ("sequences", pack_sequences),
]
# Tokenizers and fingerprints have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
