"""Sharding by sampled splitters, with built-in expressions only.

Records are ordered by (md5 of the text, id), so equal texts lie side by side and a hot text can still be split.
Key samples are drawn with probability in proportion to size, their quantiles become splitters, records are
range-partitioned by them, and ranges that turn out overfull get splitters of their own. Each range then knows
its exact rows and bytes, so running sums inside ranges give every record its exact place in the whole order, and
the shards are cut there: their byte totals differ by less than two records' sizes, whatever the sample was.

Nulls: a null text has no bytes and the key of the empty text; a null id sorts first. Repeated rows each take a
place. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize, prepare, table

#: Bytes that a record costs besides its text.
RECORD_OVERHEAD = 16
_PREFIX = 3
_LEAST = -(2**63)


def _records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_tie"),
    )


def _splitters(samples: list, pieces: int) -> list[tuple[str, int]]:
    """The weighted quantiles that cut the samples into so many pieces."""
    total, run, out = sum(r["w"] for r in samples), 0.0, []
    for r in sorted(samples, key=lambda r: (r["_key"], r["_tie"])):
        run += r["w"]
        if run * pieces >= (len(out) + 1) * total and len(out) < pieces - 1:
            out.append((r["_key"], r["_tie"]))
            while run * pieces >= (len(out) + 1) * total and len(out) < pieces - 1:
                out.append(out[-1])
    return sorted(set(out))


def _sample(df: DataFrame, rate: str, seed: int) -> list:
    """Rows drawn with probability min(1, size * rate), by a hash of the record and so alike in every attempt."""
    uniform = (F.xxhash64("_key", "_tie", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    chance = F.col("size") * F.expr(rate)
    drawn = df.where(uniform < chance).select("_key", "_tie", "_range", F.greatest(F.col("size").cast("double"), 1.0 / F.expr(rate)).alias("w"))
    return drawn.collect()


def _ranged(spark: SparkSession, records: DataFrame, splitters: list[tuple[str, int]]) -> DataFrame:
    """Adds _range: how many splitters are at or below the record. Looked up by the key's first digits."""
    by_prefix: dict[str, list] = {}
    for key, tie in splitters:
        by_prefix.setdefault(key[:_PREFIX], []).append((key, tie))
    prefixes = [format(i, f"0{_PREFIX}x") for i in range(16**_PREFIX)]
    rows = [(p, bisect_right(splitters, (p, _LEAST)), by_prefix.get(p, [])) for p in prefixes]
    lookup = spark.createDataFrame(rows, "_prefix string, _base int, _cuts array<struct<_key: string, _tie: bigint>>")
    joined = records.withColumn("_prefix", F.substring("_key", 1, _PREFIX)).join(F.broadcast(lookup), "_prefix")
    below = F.size(F.filter("_cuts", lambda cut: cut <= F.struct(F.col("_key"), F.col("_tie"))))
    return joined.withColumn("_range", F.col("_base") + below).drop("_prefix", "_base", "_cuts")


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 16, samples_per_range: int = 32) -> DataFrame:
    """Puts every row into one of `shards` shards of near equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: the
    law is `bytes`). The driver holds at most about 2 * shards * ranges_per_shard * samples_per_range sampled
    keys and one count for each range, at any input size.
    """
    spark = df.sparkSession
    prepare(spark)
    records = materialize(_records(df, id_col, text_col), "shard-records")
    pieces, total = shards * ranges_per_shard, max(1, records.agg(F.sum("size")).first()[0] or 0)
    wanted = pieces * samples_per_range
    drawn = _sample(records.withColumn("_range", F.lit(0)), f"{wanted / total!r}D", 1)
    splitters = _splitters(drawn, pieces)
    ranged = _ranged(spark, records, splitters)
    counted = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    over = {r["_range"]: r["bytes"] for r in counted.collect() if r["bytes"] * pieces > 2 * total}
    if over:
        again = _sample(ranged.where(F.col("_range").isin(*over)), f"{samples_per_range * pieces / total!r}D", 2)
        for k, size in over.items():
            splitters += _splitters([r for r in again if r["_range"] == k], -(-size * pieces // total))
        splitters = sorted(set(splitters))
        ranged = _ranged(spark, records, splitters)
        counted = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    at_row = at_byte = 0
    offsets = []
    for r in sorted(counted.collect(), key=lambda r: r["_range"]):
        offsets.append((r["_range"], at_row, at_byte))
        at_row, at_byte = at_row + r["n"], at_byte + r["bytes"]
    starts = spark.createDataFrame(offsets, "_range int, _row bigint, _byte bigint")
    order = Window.partitionBy("_range").orderBy("_key", "_tie", "size")
    before = F.col("_byte") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranged.join(F.broadcast(starts), "_range").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("_row") + F.row_number().over(order) - 1).alias("_place"),
        before.alias("_before"),
    )
    placed = placed.withColumn("shard", F.least(F.expr(f"(_before * {shards}L) div {total}L"), F.lit(shards - 1)).cast("int")).drop("_before")
    placed = materialize(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


#: The CRC-32's table is made from its polynomial; texts are taken byte by byte.
OP6_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), b AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((instr('123456789ABCDEF', h[1:1])) * 16 + instr('123456789ABCDEF', h[2:2]) AS BIGINT)) AS bytes
  FROM documents
), r AS (
  SELECT doc_id, len(bytes) + 16 AS size, md5(text) AS key, coalesce(doc_id, -9223372036854775808) AS tie,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM b, tab
), p AS (
  SELECT *, sum(size) OVER (ORDER BY key, tie, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM r
), s AS (
  SELECT *, CAST(least(before * 40 // total, 39) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, tie, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
