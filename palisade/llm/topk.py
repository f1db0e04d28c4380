"""Exact top-k search by tiled matrix products.

Vectors are quantised to integers and packed into shards of bounded size; the queries are packed into tiles. Each
(tile, shard) pair is one integer matrix product, of which only k candidates a query leave the task; lists of
different shards are merged in a tree. The products are exact: in doubles while no sum can reach 2^53, in 64-bit
numbers below 2^63, and in numbers of any size beyond. Codes are kept as doubles, which hold every floor of a double.

Takes no part: a vector that is null or holds null, NaN or infinity (also scale * x in double; no float reaches
that at scale 256), or whose id is null. Vectors are compared with vectors of
their own length only. If rows repeat an id, the one with the smallest vector takes part. A query with no
candidate gives no rows, and so does an empty table. Scores beyond 64 bits are cut to the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import materialize, prepare, table

#: Vectors in a shard and queries in a tile, on average; a task holds one of each.
SHARD_ROWS, TILE_ROWS = 8_192, 1_024
_FAN = 16
_PACKED = "dim int, part bigint, n int, ids binary, codes binary"
_HITS = "query_id bigint, part bigint, vec_id bigint, score bigint"


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """floor(scale * x) of every component, in double; only vectors that take part, one for each id."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # From 2^53 on every double is whole, and floor() would cut to 64 bits.
    codes = F.transform(F.col(vec_col), lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    kept = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & sound)
    return kept.select(F.col(id_col).cast("long").alias("id"), codes.alias("codes"))


def _packed(vectors: DataFrame, rows: int, part: str, keep: F.Column | None = None) -> DataFrame:
    """Parts of about `rows` vectors of one length each, dealt by a hash of the id."""
    dealt = vectors if keep is None else vectors.where(keep)
    parts = max(1, -(-dealt.count() // rows))

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        flat = rows.column("codes").combine_chunks()
        i, c = rows.column("id").to_numpy(), flat.flatten().to_numpy().reshape(rows.num_rows, -1)
        order = np.lexsort((*c.T[::-1], i)) if c.shape[1] else np.argsort(i, kind="stable")
        i, c = i[order], c[order]
        first = np.concatenate([[True], i[1:] != i[:-1]])
        i, c = i[first], c[first]
        return pa.table({
            "dim": pa.array([c.shape[1]], pa.int32()),
            "part": pa.array([key[1].as_py()], pa.int64()),
            "n": pa.array([len(i)], pa.int32()),
            "ids": pa.array([i.tobytes()], pa.binary()),
            "codes": pa.array([c.tobytes()], pa.binary()),
        })

    spread = dealt.select("id", "codes", F.size("codes").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    return spread.groupBy("dim", "part").applyInArrow(pack, _PACKED).withColumnRenamed("part", part)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers kept as doubles, cut to 64 bits."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**63 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id; ids are in ascending order and a query is no candidate of its own."""
    if not scores.size:
        return query_ids[:0], ids[:0], np.zeros(0, np.int64)
    able = np.ones(scores.shape, bool)
    own = np.searchsorted(ids, query_ids)
    rows = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == query_ids))
    able[rows, own[rows]] = False
    if scores.shape[1] > k:
        # A query's own place counts as the least score of all; it isn't able, so no tie can let it in.
        ranked = np.where(able, scores, np.iinfo(np.int64).min)
        least = np.partition(ranked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        above, level = able & (scores > least), able & (scores == least)
        able = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]))
    line, at = np.nonzero(able)
    return query_ids[line], ids[at], scores[line, at]


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                queries, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                scores = _product(np.frombuffer(r["q_codes"], np.float64).reshape(len(queries), -1), np.frombuffer(r["codes"], np.float64).reshape(len(ids), -1))
                q, v, s = _best(queries, ids, scores, k)
                yield pa.RecordBatch.from_pydict({"query_id": q, "part": np.full(len(q), r["shard"]), "vec_id": v, "score": s})

    return run


def _merged(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best hits of each key: a bounded list, since a key has k rows from each of _FAN parts at most."""
    top = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id", "score"))), 1, k)
    return hits.groupBy(*keys).agg(top.alias("top"))


def top_k(df: DataFrame, queries: F.Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. `queries` says by column id which rows are queries."""
    prepare(df.sparkSession)
    vectors = materialize(quantise(df, id_col, vec_col, scale), "codes")
    shards = materialize(_packed(vectors, shard_rows, "shard"), "shards")
    tiles = _packed(vectors, tile_rows, "tile", queries).select("dim", "tile", F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"))
    # Every tile goes to every shard of its length: the stated query set against all rows, a block at a time.
    targets = shards.groupBy("dim").agg(F.sort_array(F.collect_list("shard")).alias("targets"))
    sent = tiles.join(targets, "dim").withColumn("shard", F.explode("targets")).drop("targets")
    pairs = sent.join(shards, ["dim", "shard"]).select("shard", "q_ids", "q_codes", "ids", "codes")
    hits, width = pairs.mapInArrow(_tiles(k), _HITS), shards.count()
    while width > 1:
        width = -(-width // _FAN)
        hits = _merged(hits.withColumn("part", F.floor(F.col("part") / _FAN)), ["query_id", "part"], k)
        hits = hits.select("query_id", "part", F.explode("top").alias("t")).select("query_id", "part", "t.vec_id", "t.score")
    ranked = _merged(hits, ["query_id"], k).select("query_id", F.posexplode("top").alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
