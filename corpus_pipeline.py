"""From raw documents to packed batches: language, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm.decontaminate import drop_contaminated
from weft.llm.exact_dedup import drop_exact_copies
from weft.llm.language_id import fit_languages, keep_known_languages
from weft.llm.packing import pack
from weft.llm.sampling import fold
from weft.llm.simhash import drop_near_copies
from weft.session import bound_batches, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those whose n-grams no learned language has."""
    bound_batches(spark)
    model = fit_languages(docs.where(fold("doc_id") != 2), "doc_id", "text", "lang")
    return keep_known_languages(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the largest doc_id stays."""
    return drop_exact_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (Jaccard of five-word shingles 0.8 or more), the smallest doc_id stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontamination),
    ("packing", packing),
]

#: SimHash, learned filters and the length programme are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
