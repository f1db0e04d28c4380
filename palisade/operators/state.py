"""What an ordered stream of requests leaves behind: sightings, statistics, savings, moving thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sightings(requests: DataFrame, order: list[str]) -> DataFrame:
    """Adds how often the same prompt has been seen in its scope so far, this time included."""
    return requests.withColumn("sighting", F.row_number().over(Window.partitionBy("scope", "prompt").orderBy(*order)))


def admission(requests: DataFrame, order: list[str], nth: int = 2) -> DataFrame:
    """Replays requests against a cache that stores an answer on a prompt's n-th sighting: hit, stored or held_back."""
    outcome = F.when(F.col("sighting") > nth, "hit").when(F.col("sighting") == nth, "stored").otherwise("held_back")
    return sightings(requests, order).withColumn("outcome", outcome)


def admission_summary(requests: DataFrame, order: list[str], nth: int) -> DataFrame:
    counted = admission(requests, order, nth).agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("hit", "stored", "held_back")), F.count(F.lit(1)).alias("n_requests"))
    return counted.withColumn("hit_rate", rate(F.col("n_hit"), F.col("n_requests"))).withColumn("nth", F.lit(nth))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def stats(decisions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lookups, hits, misses by reason, refusals by rules, and the rates, for each key. Misses are what isn't a hit."""
    reasons = ("EMPTY_SCOPE", "BELOW_THRESHOLD", "EMBEDDER_MISMATCH", "GUARD_REJECTED", "VERIFIER_REJECTED")
    counted = decisions.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if("is_hit").alias("hits"),
        *(F.count_if(F.col("reason") == r).alias(f"miss_{r.lower()}") for r in reasons),
        F.count_if("embedder_mismatch").alias("embedder_mismatches"),
    )
    counted = counted.withColumn("misses", F.col("lookups") - F.col("hits"))
    return counted.withColumn("hit_rate", rate(F.col("hits"), F.col("lookups"))).withColumn("guard_rejection_rate", rate(F.col("miss_guard_rejected"), F.col("lookups")))


def rejections_by_guard(decisions: DataFrame, guards: list[str]) -> DataFrame:
    """How many misses each rule has caused; every rule is there, with 0 if none."""
    every = decisions.sparkSession.createDataFrame([(g,) for g in guards], "guard string")
    counted = decisions.where("guard IS NOT NULL").groupBy("guard").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "guard", "left").select("guard", F.coalesce("n", F.lit(0)).cast("long").alias("rejections"))


def savings(hits: DataFrame, prices: DataFrame, tokens_in: str = "inputTokens", tokens_out: str = "outputTokens") -> DataFrame:
    """What hits have saved, for each scope and currency: tokens and calls at their prices. Hits whose entry has neither
    token count are counted apart. hits(scope, metadata), prices(scope, currency, price_in, price_out, price_call)."""
    count = lambda k: F.try_element_at("metadata", F.lit(k)).try_cast("bigint")
    rows = hits.select("scope", count(tokens_in).alias("n_in"), count(tokens_out).alias("n_out"))
    summed = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("hits"),
        F.coalesce(F.sum("n_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("n_out"), F.lit(0)).alias("tokens_out"),
        F.count_if(F.col("n_in").isNull() & F.col("n_out").isNull()).alias("uncounted"),
    )
    money = F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out") + F.col("hits") * F.col("price_call")
    return summed.join(prices, "scope").select("scope", "currency", "hits", "tokens_in", "tokens_out", "uncounted", money.alias("saved"))


def adaptive(samples: DataFrame, order: list[str], window: int = 200, target: float = 0.1, step: float = 0.005, floor: float = 0.90, ceiling: float = 0.98) -> DataFrame:
    """A scope's threshold after each full window of samples(scope, refused): up a step where more than the target
    was refused, down where less than half of it, inside [floor, ceiling], from the middle.

    Windows are counted first; the fold goes over a scope's windows, one number for each.
    """
    own = Window.partitionBy("scope").orderBy(*order)
    numbered = samples.withColumn("window", F.floor((F.row_number().over(own) - 1) / window))
    full = numbered.groupBy("scope", "window").agg(F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("refused")).where(F.col("n") == window)
    move = F.col("refused") / window
    signed = full.select("scope", "window", F.when(move > target, step).when(move < target / 2, -step).otherwise(0.0).alias("move"))
    listed = signed.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("window", "move"))).alias("moves"))

    def climb(state: Column, m: Column) -> Column:
        last = F.coalesce(F.element_at(state, -1)["threshold"], F.lit((floor + ceiling) / 2))
        return F.concat(state, F.array(F.struct(m["window"].alias("window"), F.greatest(F.lit(floor), F.least(F.lit(ceiling), last + m["move"])).alias("threshold"))))

    start = F.array().cast("array<struct<window: bigint, threshold: double>>")
    folded = listed.select("scope", F.aggregate("moves", start, lambda s, m: F.when(F.size(s) == 0, F.array(F.struct(m["window"].alias("window"), F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.lit((floor + ceiling) / 2) + m["move"])).alias("threshold")))).otherwise(climb(s, m))).alias("path"))
    return folded.select("scope", F.explode("path").alias("p")).select("scope", F.col("p.window").alias("window"), F.col("p.threshold").alias("threshold"))


def coalesced(misses: DataFrame) -> DataFrame:
    """One row for each prompt that has to be computed, with how many requests wait for it."""
    return misses.groupBy("scope", "prompt").agg(F.count(F.lit(1)).alias("waiting"), F.min("query_id").alias("first_query_id"))


def metrics(events: DataFrame) -> DataFrame:
    """Count, total and largest value of each kind of event and tag: what a metrics sink takes."""
    return events.groupBy("event_type", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def timers(events: DataFrame) -> DataFrame:
    """Count, total and longest time of each stage of lookups(embed_nanos, search_nanos, verify_nanos). A stage that never
    ran has no row for the verifier, whose zero means that it wasn't asked."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"{s}_nanos").alias("nanos")) for s in ("embed", "search", "verify")))
    each = events.select(F.explode(stages).alias("s")).where("s.nanos IS NOT NULL AND (s.stage <> 'verify' OR s.nanos > 0)")
    return each.groupBy(F.col("s.stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("s.nanos").alias("total_nanos"), F.max("s.nanos").alias("longest_nanos"))


def spans_of(lookups: DataFrame) -> DataFrame:
    """Spans of lookups(query_id, end_nanos, stages array<struct<name, nanos>>): the lookup's own, without a parent, as long as
    its stages together, and its stages' laid end to end in it. A stage of no time didn't run and has none."""
    ran = F.filter("stages", lambda s: s["nanos"] > 0)
    total = lambda stages: F.aggregate(stages, F.lit(0).cast("long"), lambda s, x: s + x["nanos"])
    base = lookups.select("query_id", "end_nanos", ran.alias("stages"))
    whole = F.struct(F.lit(None).cast("string").alias("parent"), F.lit("lookup").alias("name"), (F.col("end_nanos") - total(F.col("stages"))).alias("start_nanos"), F.col("end_nanos").alias("end_nanos"))

    def part(stage: Column, i: Column) -> Column:
        start = F.col("end_nanos") - total(F.slice("stages", i + 1, F.size("stages")))
        return F.struct(F.lit("lookup").alias("parent"), stage["name"].alias("name"), start.alias("start_nanos"), (start + stage["nanos"]).alias("end_nanos"))

    return base.select("query_id", F.explode(F.concat(F.array(whole), F.transform("stages", part))).alias("s")).select("query_id", "s.*")


def log_lines(events: DataFrame, show_prompt: bool = False, most: int = 200) -> DataFrame:
    """A key-value line for each event; the prompt is its length, or its first characters if asked for."""
    prompt = F.substring("prompt", 1, most) if show_prompt else F.length("prompt").cast("string")
    line = F.concat_ws(" ", F.concat(F.lit("event="), F.col("event_type")), F.concat(F.lit("scope="), F.col("scope")), F.concat(F.lit("prompt="), prompt))
    return events.select("event_id", line.alias("line"))
