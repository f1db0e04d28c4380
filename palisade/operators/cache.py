"""The cache as a whole: answers for a batch of requests, what is written for the misses, tenants, failures."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import lookup, store
from palisade.operators.state import rate

#: Parts a tenant's name from the scope inside it; no name holds it.
SEPARATOR = "\x1f"
HIT, EXACT, COMPUTED, DEGRADED = "hit", "exact_hit", "computed", "degraded"


def for_tenant(df: DataFrame, tenant: str = "tenant") -> DataFrame:
    """df with each scope inside its tenant, so that no join on the scope crosses tenants. A row without a tenant is an error."""
    named = F.when(F.col(tenant).isNull(), F.raise_error(F.lit("a tenant is required"))).otherwise(F.col(tenant).cast("string"))
    return df.withColumn("scope", F.concat(named, F.lit(SEPARATOR), F.coalesce("scope", F.lit(""))))


def get_or_put_all(requests: DataFrame, entries: DataFrame, compute: Callable[[Column], Column], exact: bool = False, **options) -> DataFrame:
    """An answer for every request: query_id, scope, prompt, embedding, embedder, response, how.

    how: `hit` (response of the entry served), `exact_hit` (the same prompt byte for byte, asked first if exact is
    set), `computed`, or `degraded`: computed without a lookup because the prompt has no embedding. Misses of the
    same prompt in a scope are computed once and share the answer.
    """
    degraded = requests.where("embedding IS NULL").select("query_id", F.lit(None).cast("string").alias("_found"), F.lit(DEGRADED).alias("how"))
    asked, known = requests.where("embedding IS NOT NULL"), None
    if exact:
        known = lookup.exact_hits(asked, entries).join(entries.select("entry_id", F.col("response").alias("_found")), "entry_id").select("query_id", "_found", F.lit(EXACT).alias("how"))
        asked = asked.join(known.select("query_id"), "query_id", "left_anti")
    decided = lookup.decide(asked, entries, hits_only=True, **options).select("query_id", F.col("response").alias("_found"), F.when(F.col("is_hit"), HIT).otherwise(COMPUTED).alias("how"))
    every = decided.unionByName(degraded)
    rows = requests.join(every if known is None else every.unionByName(known), "query_id")
    todo = rows.where(F.col("how").isin(COMPUTED, DEGRADED)).select("scope", "prompt").distinct()
    answers = todo.select(F.col("scope").alias("_scope"), F.col("prompt").alias("_prompt"), compute(F.col("prompt")).alias("_made"))
    same = F.col("scope").eqNullSafe(F.col("_scope")) & F.col("prompt").eqNullSafe(F.col("_prompt"))
    return rows.join(answers, same, "left").select("query_id", "scope", "prompt", "embedding", "embedder", F.coalesce("_found", "_made").alias("response"), "how")


def new_entries(answers: DataFrame, veto: Column | None = None) -> DataFrame:
    """What the answers of get_or_put_all leave to be stored: one row for each computed prompt and scope, with its
    first request's vector, and veto_reason (null: stored). Degraded answers are never stored."""
    first = F.min(F.struct("query_id", "embedding", "embedder", "response")).alias("f")
    rows = answers.where(F.col("how") == COMPUTED).groupBy("scope", "prompt").agg(first)
    key = F.md5(F.concat_ws(SEPARATOR, F.coalesce("scope", F.lit("")), F.coalesce("prompt", F.lit(""))))
    made = rows.select(key.alias("entry_id"), "scope", "prompt", "f.response", "f.embedding", "f.embedder", F.col("f.query_id").alias("first_query_id"))
    return store.policy(made, F.lit(None).cast("string") if veto is None else veto)


def warm(entries: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """entries with a prepared batch written over them: no lookup, no admission; the later seq of an id wins."""
    return store.upsert(entries, batch, seq)


def outcome_stats(answers: DataFrame, written: DataFrame) -> DataFrame:
    """Counters of a batch: lookups (degraded calls are none), hits, exact hits among them, degraded, writes and vetoes."""
    n = lambda *kinds: F.count_if(F.col("how").isin(*kinds))
    asked = answers.agg(n(HIT, EXACT, COMPUTED).alias("lookups"), n(HIT, EXACT).alias("hits"), n(EXACT).alias("exact_hits"), n(DEGRADED).alias("degraded"))
    put = written.agg(F.count_if(F.col("veto_reason").isNull()).alias("writes"), F.count_if(F.col("veto_reason").isNotNull()).alias("vetoed"))
    # One row each.
    return asked.crossJoin(F.broadcast(put)).withColumn("hit_rate", rate(F.col("hits"), F.col("lookups")))


def embedded(df: DataFrame, embed: Callable[[Column], Column], text: str = "prompt") -> DataFrame:
    """df with `embedding`: each distinct text is embedded once. A null vector marks a failure, for a degraded answer."""
    once = df.where(F.col(text).isNotNull()).select(text).distinct().withColumn("embedding", embed(F.col(text)))
    return df.join(once, text, "left")


def retrying(call: Callable, attempts: int = 3, first: float = 0.1, factor: float = 2.0, most: float = 5.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call with retries, for use inside a vectorised function: waits `first` seconds, then `factor` times as long each time, up
    to `most`, shortened by a random part of up to `jitter`. The last error is raised."""

    @wraps(call)
    def run(*args):
        wait = first
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:
                if i == attempts - 1:
                    raise
                sleep(min(wait, most) * (1 - jitter * random.random()))
                wait *= factor

    return run


def encode_response(value: Column) -> Column:
    """A structured answer as the text that is stored."""
    return F.to_json(value)


def decode_response(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
