"""The table of stored entries: writes, expiry, recency and size bounds, tags, change log, encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import text as X
from palisade.functions import vectors as V
from palisade.operators.guards import Guard, first_rejection, standard
from palisade.sources.storage import written

UNDECLARED = "undeclared"
#: Bytes an entry costs besides its texts, and each component of its vector.
ENTRY_BYTES, COMPONENT_BYTES = 128, 4

ENTRY = T.StructType([
    T.StructField("entry_id", T.StringType(), False),
    T.StructField("scope", T.StringType(), False),
    T.StructField("prompt", T.StringType(), False),
    T.StructField("response", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("embedder", T.StringType(), False),
    T.StructField("chunk_lengths", T.ArrayType(T.IntegerType())),
])


def faults(entries: DataFrame, dim: int | None = None) -> DataFrame:
    """Entries that may not be stored, with what is wrong: null where an entry is fine."""
    lengths = F.coalesce("chunk_lengths", F.array().cast("array<int>"))
    total = F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    wrong = F.when(F.coalesce(F.trim("entry_id"), F.lit("")) == "", "blank id")
    wrong = wrong.when(~F.coalesce(V.sound(F.col("embedding")), F.lit(False)), "unsound vector")
    if dim is not None:
        wrong = wrong.when(F.size("embedding") != dim, "wrong dimension")
    wrong = wrong.when((F.size(lengths) > 0) & (F.exists(lengths, lambda n: n <= 0) | (total != F.length("response"))), "chunks don't make the response")
    return entries.select("entry_id", wrong.alias("fault"))


def with_response(entries: DataFrame, response: Column) -> DataFrame:
    """Entries with another response: all else stays, but the chunks, which made the old one, go."""
    return entries.withColumn("response", response).withColumn("chunk_lengths", F.array().cast("array<int>"))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key. Keys have few rows each; a row_number over them keeps one a key before the shuffle."""
    own = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """stored with new rows added or put in place of those with their id; the greater seq wins."""
    return latest(stored.unionByName(new), "entry_id", [F.desc(seq)])


def remove(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("entry_id"), "entry_id", "left_anti")


def invalidate_by_tag(stored: DataFrame, tag: str, scope: str | None = None) -> DataFrame:
    gone = F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return stored.where(~(gone if scope is None else gone & F.col("scope").eqNullSafe(F.lit(scope))))


def clear(stored: DataFrame, scope: str | None = None) -> DataFrame:
    return stored.where(F.lit(False) if scope is None else ~F.col("scope").eqNullSafe(F.lit(scope)))


def tagged(stored: DataFrame, tag: str, scope: str | None = None) -> DataFrame:
    """How many entries invalidate_by_tag would drop."""
    gone = F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return stored.agg(F.count_if(gone if scope is None else gone & F.col("scope").eqNullSafe(F.lit(scope))).alias("n_invalidated"))


def live(stored: DataFrame, ttl_seconds: int, now: Column, since: str = "created_at") -> DataFrame:
    """Entries not yet expired: since + ttl is after now. Microseconds decide. Some stores count from the time of writing."""
    return stored.where(F.unix_micros(F.col(since).cast("timestamp")) + F.lit(ttl_seconds * 1_000_000) > F.unix_micros(now))


def size(stored: DataFrame, by_scope: bool = False) -> DataFrame:
    return stored.groupBy(*(["scope"] if by_scope else [])).agg(F.count(F.lit(1)).alias("n_entries"))


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, pieces: int = 32) -> DataFrame:
    """Adds the sum of value over the rows up to this one in a total order, without one task that sees all rows.

    Rows are dealt to ranges of the order, each range adds up its own, and the ranges' totals, one row a range, are
    added to them.
    """
    # Written out, because ranges are drawn from a sample: both uses below must see the same.
    ranged = written(df.withColumn("_v", value).repartitionByRange(pieces, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranged = ranged.withColumn("_own", F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("_part").agg(F.sum("_v").alias("_total"))
    below = totals.withColumn("_below", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_below")
    return ranged.join(F.broadcast(below), "_part").withColumn(name, F.col("_own") + F.col("_below")).drop("_v", "_part", "_own", "_below")


def keep_recent(stored: DataFrame, accesses: DataFrame, max_entries: int) -> DataFrame:
    """The max_entries most recently written or hit entries. accesses(entry_id, seq); stored has its own seq."""
    used = accesses.groupBy("entry_id").agg(F.max("seq").alias("_used"))
    ranked = stored.join(used, "entry_id", "left").withColumn("_recent", F.greatest("seq", F.coalesce("_used", "seq")))
    ranked = running_total(ranked, [F.desc("_recent"), F.asc("entry_id")], F.lit(1), "_place")
    return ranked.where(F.col("_place") <= max_entries).drop("_used", "_recent", "_place")


def entry_bytes() -> Column:
    return F.size("embedding") * COMPONENT_BYTES + F.octet_length("prompt") + F.octet_length("response") + ENTRY_BYTES


def keep_bytes(stored: DataFrame, max_bytes: int) -> DataFrame:
    """The most recent entries whose bytes fit into max_bytes together; the most recent one stays in any case."""
    summed = running_total(stored, [F.desc("seq"), F.asc("entry_id")], entry_bytes().cast("long"), "_bytes")
    return summed.where((F.col("_bytes") <= max_bytes) | (F.col("_bytes") == entry_bytes())).drop("_bytes")


def fold_log(log: DataFrame) -> DataFrame:
    """The entries that a change log leaves. log(seq, op, scope, entry_id, tag, ...): P put, R remove, C clear (a scope,
    or all where scope is null), T drop a tag (in a scope, or everywhere)."""
    puts = latest(log.where("op IN ('P', 'R') AND entry_id IS NOT NULL"), "entry_id", [F.desc("seq")]).where("op = 'P'")
    # The last clear of each scope, and of all; the last drop of each (tag, scope): a row each, however long the log is.
    cleared = log.where("op = 'C'").groupBy("scope").agg(F.max("seq").alias("_cleared"))
    everywhere = cleared.where("scope IS NULL").agg(F.max("_cleared").alias("_cleared_all"))
    kept = puts.join(cleared.where("scope IS NOT NULL"), "scope", "left").crossJoin(F.broadcast(everywhere))  # one row
    kept = kept.where((F.coalesce("_cleared", F.lit(-1)) < F.col("seq")) & (F.coalesce("_cleared_all", F.lit(-1)) < F.col("seq"))).drop("_cleared", "_cleared_all")
    drops = log.where("op = 'T'").groupBy(F.col("tag").alias("_tag"), F.col("scope").alias("_in")).agg(F.max("seq").alias("_dropped"))
    tagged = kept.select("entry_id", "scope", "seq", F.explode("tags").alias("_tag"))
    hit = tagged.join(drops, "_tag").where((F.col("_in").isNull() | (F.col("_in") == F.col("scope"))) & (F.col("_dropped") > F.col("seq")))
    return kept.join(hit.select("entry_id").distinct(), "entry_id", "left_anti")


def compact(log: DataFrame) -> DataFrame:
    """The log as one put for each entry that it leaves."""
    return fold_log(log).withColumn("op", F.lit("P"))


def encrypt(entries: DataFrame, key: Column) -> DataFrame:
    """Prompt and response under AES-GCM with a fresh nonce each; the scope is authenticated with them."""
    seal = lambda c: F.base64(F.aes_encrypt(F.col(c), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.md5(F.concat(F.uuid(), F.lit(c))), 1, 24)), F.col("scope")))
    return entries.withColumns({c: seal(c) for c in ("prompt", "response")})


def decrypt(entries: DataFrame, key: Column) -> DataFrame:
    opened = lambda c: F.aes_decrypt(F.unbase64(F.col(c)), key, F.lit("GCM"), F.lit("DEFAULT"), F.col("scope")).cast("string")
    return entries.withColumns({c: opened(c) for c in ("prompt", "response")})


def policy(entries: DataFrame, veto: Column) -> DataFrame:
    """Adds veto_reason; entries where it is null are stored."""
    return entries.withColumn("veto_reason", veto)


def near_duplicates(entries: DataFrame, threshold: float, guards: list[Guard] | None = None, dim: int | None = None) -> DataFrame:
    """Writes that replace an earlier near entry: entry_id, replaces, similarity. The nearest earlier entry of the
    scope counts, if rules accept both ways and the embedders agree."""
    guards = standard() if guards is None else guards
    read = entries.select("entry_id", "scope", "seq", "embedder", "embedding", X.read(F.col("prompt")).alias("read"))
    old = read.select(*(F.col(c).alias(f"o_{c}") for c in read.columns))
    pairs = read.join(old, (F.col("scope") == F.col("o_scope")) & (F.col("o_seq") < F.col("seq")) & F.col("embedder").eqNullSafe(F.col("o_embedder")))
    near = pairs.withColumn("similarity", V.dot(F.col("embedding"), F.col("o_embedding"), dim)).where(F.col("similarity") >= threshold)
    fine = first_rejection(guards, F.col("read"), F.col("o_read")).isNull() & first_rejection(guards, F.col("o_read"), F.col("read")).isNull()
    return latest(near.where(fine), "entry_id", [F.desc("similarity"), F.asc("o_entry_id")]).select("entry_id", F.col("o_entry_id").alias("replaces"), "similarity")


def chunks(entries: DataFrame) -> DataFrame:
    """A streamed answer's chunks again: entry_id, place, chunk. An answer without chunk lengths is one chunk."""
    lengths = F.when(F.size("chunk_lengths") > 0, F.col("chunk_lengths")).otherwise(F.array(F.length("response")))
    each = entries.select("entry_id", "response", lengths.alias("lengths")).select("*", F.posexplode("lengths").alias("place", "n"))
    start = F.aggregate(F.slice("lengths", 1, F.col("place")), F.lit(0), lambda s, x: s + x)
    return each.select("entry_id", "place", F.substring(F.col("response"), start + 1, F.col("n")).alias("chunk"))
