"""A corpus pipeline of four stages: quality, exact duplicates, near duplicates, packing.

Each stage reads what the one before has kept, as Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import exact_dedup, ngram_join, packing, quality
from palisade.llm.common import materialize, prepare, table

#: Near duplicates: words in a row, and the least similarity in hundredths.
NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def _unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject. The fit uses labelled rows of docs outside the held-out fold."""
    prepare(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return quality.score_quality(rows, model, ["_row"]).where("predicted = 1").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space, the one with the smallest doc_id.

    Rows that repeat a doc_id and its text are one document and stay together.
    """
    own = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias(key := _unused("kept_id", docs)), F.col("text_sha256").alias(sha := _unused("kept_sha", docs)))
    return docs.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col(key)) & (own == F.col(sha)), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingles, 0.8 or more), the smallest doc_id."""
    found = ngram_join.ngram_join(docs, words=NEAR_WORDS, p=NEAR_SIMILARITY, q=100)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key := _unused("gone_id", docs))).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of the tiers' lengths, with their ids' checksums."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("packing", pack),
]

#: The classifier, the near-duplicate components and the tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
