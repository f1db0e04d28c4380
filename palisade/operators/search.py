"""Nearest stored entries within a scope: exact, by codes, by cells, and diverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import vectors as V
from palisade.operators import tiles

#: Entries per query that a code shortlist keeps for each one that is wanted.
OVERFETCH = {"int8": 4, "binary": 24}
#: Entries of one scope that a task takes, and queries.
SALT_ROWS, QUERY_ROWS = 50_000, 20_000
#: Groups that scopes are dealt to, at least.
BUCKETS = 256


def best(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank. Spark keeps k rows a key before the shuffle (WindowGroupLimit)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _rows(df: DataFrame) -> tuple[int, int]:
    """Rows of the largest scope, and of all: one count by scope."""
    most, every = df.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return most or 0, every or 0


def salts_of(entries: DataFrame) -> int:
    """How many tasks the largest scope's entries need: one count by scope."""
    return max(1, -(-_rows(entries)[0] // SALT_ROWS))


def nearest(queries: DataFrame, entries: DataFrame, k: int = 5, dim: int | None = None, as_of: bool = False, salts: int | None = None) -> DataFrame:
    """Each query's k most similar entries of its scope: query_id, entry_id, similarity, rank.

    queries(query_id, scope, embedding[, ts]), entries(entry_id, scope, embedding[, created_at]); embeddings are
    normalised. Ties go to the smaller entry_id. With as_of only entries created before the query count. With
    salts above 1 a scope's entries are dealt to that many tasks and each query is sent to all of them, so that a
    hot scope isn't one task; the k best of each part meet in the final ranking. Unless salts are given, they are as
    many as leave SALT_ROWS of the largest scope's entries to a task. Queries are dealt likewise, QUERY_ROWS to a task.

    Every query meets every entry of its scope, but inside a task, as matrix products of blocks; no row is made of a
    pair that isn't among its task's k best. Scopes are dealt to buckets, so small ones share a task.
    """
    (most_q, all_q), (most_e, all_e) = _rows(queries), _rows(entries)
    parts, salts = max(1, -(-most_q // QUERY_ROWS)), max(1, -(-most_e // SALT_ROWS)) if salts is None else salts
    buckets = max(BUCKETS, -(-2 * all_q // (QUERY_ROWS * parts)), -(-2 * all_e // (SALT_ROWS * salts)))
    bucket = F.pmod(F.xxhash64("scope"), F.lit(buckets)).alias("bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda i, n: F.pmod(F.xxhash64(i), F.lit(n)).cast("int")
    q = queries.where("scope IS NOT NULL AND embedding IS NOT NULL").select("query_id", "scope", F.col("embedding").alias("q_vec"), *([F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")] if as_of else []), bucket, one("query_id", parts).alias("part"), every(salts).alias("salt"))
    e = entries.where("scope IS NOT NULL AND embedding IS NOT NULL").select("entry_id", "scope", F.col("embedding").alias("e_vec"), *([F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_at")] if as_of else []), bucket, one("entry_id", salts).alias("salt"), every(parts).alias("part"))
    keys, kinds = ["bucket", "part", "salt"], dict(q.dtypes) | dict(e.dtypes)
    met = q.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInArrow(tiles.tile(k, dim, as_of), f"query_id {kinds['query_id']}, entry_id {kinds['entry_id']}, similarity double")
    return best(met, ["query_id"], [F.desc("similarity"), F.asc("entry_id")], k)


def nearest_by_codes(queries: DataFrame, entries: DataFrame, k: int = 5, codes: str = "int8", overfetch: int | None = None) -> DataFrame:
    """Like nearest: a shortlist by int8 or binary codes, then exact similarities."""
    encode, keep = (V.int8_codes, V.int8_score) if codes == "int8" else (V.binary_codes, None), overfetch or OVERFETCH[codes]
    q, e = (df.withColumn("code", encode[0](F.col("embedding"))) for df in (queries, entries))
    pairs = q.select("query_id", "scope", F.col("code").alias("q_code"), F.size("embedding").alias("dim")).join(e.select("entry_id", "scope", F.col("code").alias("e_code")), "scope")
    score = V.int8_score(F.col("q_code"), F.col("e_code")) if codes == "int8" else V.binary_score(F.col("q_code"), F.col("e_code"), F.col("dim").cast("long"))
    short = best(pairs.select("query_id", "entry_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("entry_id")], k * keep)
    return rescore(short.select("query_id", "entry_id"), queries, entries, k)


def rescore(pairs: DataFrame, queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k best of the proposed pairs by exact similarity."""
    both = pairs.join(queries.select("query_id", F.col("embedding").alias("q_vec")), "query_id").join(entries.select("entry_id", F.col("embedding").alias("e_vec")), "entry_id")
    scored = both.select("query_id", "entry_id", V.dot(F.col("q_vec"), F.col("e_vec")).alias("similarity"))
    return best(scored.where("similarity IS NOT NULL"), ["query_id"], [F.desc("similarity"), F.asc("entry_id")], k)


def centroids(entries: DataFrame, cells: int = 32, sample: int = 20_000, seed: int = 42) -> list[list[float]]:
    """Cell centres by k-means over a sample of at most `sample` entries."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    taken = entries.orderBy(F.xxhash64("entry_id", F.lit(seed))).limit(sample)
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(taken.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return [c.tolist() for c in model.clusterCenters()]


def _cells(v: Column, centres: list[list[float]], n: int) -> Column:
    """The n nearest cells' numbers."""
    far = [F.struct((-V.dot(v, F.array(*map(F.lit, c))) * 2 + F.lit(sum(x * x for x in c))).alias("far"), F.lit(i).alias("cell")) for i, c in enumerate(centres)]
    return F.transform(F.slice(F.array_sort(F.array(*far)), 1, n), lambda s: s["cell"])


def nearest_by_cells(queries: DataFrame, entries: DataFrame, k: int = 10, cells: int = 16, probes: int = 12, centres: list[list[float]] | None = None) -> DataFrame:
    """Like nearest, but only entries of the cells nearest to the query are proposed. Every entry is in one cell."""
    centres = centres or centroids(entries, cells)
    placed = entries.select("entry_id", "scope", _cells(F.col("embedding"), centres, 1)[0].alias("cell"))
    probed = queries.select("query_id", "scope", F.explode(_cells(F.col("embedding"), centres, probes)).alias("cell"))
    return rescore(probed.join(placed, ["scope", "cell"]).select("query_id", "entry_id"), queries, entries, k)


def rerank_diverse(candidates: DataFrame, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: candidates(query_id, entry_id, similarity, rank, embedding) with a new `place`.

    The nearest stays first; each next one has the most of weight * similarity - (1 - weight) * likeness to one
    already placed, ties to the earlier. Two candidates or fewer keep their order. A query's candidates are few,
    by the k that made them.
    """
    kinds = dict(candidates.dtypes)
    row = F.struct("rank", "entry_id", "similarity", "embedding")
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    placed = f"query_id {kinds['query_id']}, entry_id {kinds['entry_id']}, similarity {kinds['similarity']}, rank {kinds['rank']}, place int"
    return lists.mapInArrow(tiles.diverse(weight), placed)
