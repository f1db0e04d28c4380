"""Exact dedup by content-defined chunk recipes.

A text's white space is normalised, the text is cut where a rolling hash of its last 32 bytes says so, and its
recipe is the ordered list of its chunks' digests. Every chunk's bytes move once, already unique within a batch,
to be compared with the other chunks of the same digest: a digest that stands for one content is a verified
identifier, and one that stands for several is split by content. Documents are then compared by their lists of
identifiers; no document moves as a whole.

Nulls: a null text counts as empty; empty texts are equal to each other, but not to a text of one blank. A null
doc_id sorts after all others, so its row stays only if its whole group has none. Rows repeated with the same
doc_id are members of their group; of those that share the smallest doc_id each is marked kept. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import map_batches, materialize, prepare, table, texts_of

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_WINDOW = 32


def _gear() -> np.ndarray:
    """A 64-bit value for each byte, from its own hash."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], np.uint64)


_GEAR = _gear()


def normalised(text: bytes) -> bytes:
    return _SPACES.sub(b" ", text)


def cut_points(text: bytes, least: int = 256, mean: int = 1024, most: int = 8192) -> list[int]:
    """Ends of the text's chunks: where the rolling hash's top bits are 0, at least `least` and at most `most` apart."""
    n = len(text)
    if n <= least:
        return [n]
    rolled = _GEAR[np.frombuffer(text, np.uint8)]
    step = 1
    while step < _WINDOW:
        later = rolled.copy()
        later[step:] += rolled[:-step] << np.uint64(step)
        rolled, step = later, 2 * step
    marks = np.flatnonzero(rolled >> np.uint64(64 - int(mean).bit_length() + 1) == 0) + 1
    ends, start = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - start > most:
            start += most
            ends.append(start)
        if mark - start >= least and mark < n:
            ends.append(mark)
            start = mark
    ends.append(n)
    return ends


def _digest(bits: int):
    keep = (1 << bits) - 1
    return lambda chunk: ((xxhash.xxh3_64_intdigest(chunk) & keep) ^ (1 << 63)) - (1 << 63) if bits == 64 else xxhash.xxh3_64_intdigest(chunk) & keep


def _recipes(df: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    digest = _digest(bits)

    def cut(batch: pa.RecordBatch) -> dict:
        recipes, shas = [], []
        for text in map(normalised, texts_of(batch.column(1))):
            shas.append(hashlib.sha256(text).hexdigest())
            start, recipe = 0, []
            for end in cut_points(text):
                recipe.append(digest(text[start:end]))
                start = end
            recipes.append(recipe)
        return {"doc_id": batch.column(0).cast(pa.int64()), "recipe": pa.array(recipes, pa.list_(pa.int64())), "text_sha256": shas}

    return map_batches(df.select(id_col, text_col), cut, "doc_id bigint, recipe array<bigint>, text_sha256 string")


def _chunks(df: DataFrame, text_col: str, bits: int) -> DataFrame:
    """Each batch's distinct (digest, content)."""
    digest = _digest(bits)

    def cut(batch: pa.RecordBatch) -> dict:
        found: dict[tuple[int, bytes], None] = {}
        for text in {normalised(t) for t in texts_of(batch.column(0))}:
            start = 0
            for end in cut_points(text):
                chunk = text[start:end]
                found[digest(chunk), chunk] = None
                start = end
        return {"digest": pa.array([k for k, _ in found], pa.int64()), "content": pa.array([c for _, c in found], pa.binary())}

    return map_batches(df.select(text_col), cut, "digest bigint, content binary")


def _shared_digests(df: DataFrame, text_col: str, bits: int) -> DataFrame:
    """The digests that stand for more than one content, with the contents in order: empty unless digests collide."""
    one = F.struct("content")
    seen = _chunks(df, text_col, bits).groupBy("digest").agg(F.min(one).alias("a"), F.max(one).alias("b"))
    return seen.where(F.col("a") != F.col("b")).select("digest")


def _split(df: DataFrame, recipes: DataFrame, shared: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Identifiers where digests collide: the digest and its content's rank among the digest's contents."""
    from pyspark.sql import Window

    contents = _chunks(df, text_col, bits).join(shared, "digest").distinct()
    ranks = contents.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("content")).cast("long"))
    digest = _digest(bits)

    def place(batch: pa.RecordBatch) -> dict:
        rows = []
        for i, sha, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(1)), strict=True):
            text, start = normalised(text), 0
            for at, end in enumerate(cut_points(text)):
                rows.append((i, sha, at, digest(text[start:end]), text[start:end]))
                start = end
        cols = list(zip(*rows, strict=True))
        return {"doc_id": pa.array(cols[0], pa.int64()), "text_sha256": pa.array(cols[1], pa.string()), "at": pa.array(cols[2], pa.int64()), "digest": pa.array(cols[3], pa.int64()), "content": pa.array(cols[4], pa.binary())}

    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    rows = map_batches(df.select(F.col(id_col), F.col(text_col), sha), place, "doc_id bigint, text_sha256 string, at bigint, digest bigint, content binary")
    identified = rows.join(ranks, ["digest", "content"], "left").select("doc_id", "text_sha256", "at", "digest", F.coalesce("rank", F.lit(0)).alias("rank"))
    # Rows that repeat a doc_id with different texts differ in the text's sha256; those that repeat it whole are one here and counted from recipes.
    lists = identified.distinct().groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("at", "digest", "rank"))).alias("l"))
    flat = lists.select("doc_id", "text_sha256", F.flatten(F.transform("l", lambda x: F.array(x["digest"], x["rank"]))).alias("ids"))
    named = flat.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "ids")
    joined = recipes.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")))
    return joined.select("doc_id", F.col("ids").alias("recipe"), "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    digest_bits makes digests shorter, for tests of the case that chunks' digests collide.
    """
    prepare(df.sparkSession)
    recipes = materialize(_recipes(df, id_col, text_col, digest_bits), "recipes")
    shared = materialize(_shared_digests(df, text_col, digest_bits), "shared-digests")
    verified = recipes if shared.isEmpty() else _split(df, recipes, shared, id_col, text_col, digest_bits)
    keyed = verified.select("doc_id", "text_sha256", F.xxhash64("recipe").alias("_h"), "recipe")
    groups = keyed.groupBy("_h", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The join's key isn't the grouping's, so both sides are dealt anew and a hot group's rows can be split among tasks.
    groups = groups.where("group_size > 1").select(F.bitwise_not("_h").alias("_j"), "recipe", "keep_id", "group_size")
    return keyed.withColumn("_j", F.bitwise_not("_h")).join(groups, ["_j", "recipe"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
