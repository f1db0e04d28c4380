"""Scoring labelled pairs: confusion counts over thresholds, rates with their intervals, what each rule adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions import vectors as V
from palisade.operators.guards import Guard, first_rejection, standard

#: The normal quantile of a two-sided 95 % interval.
Z = 1.959964


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def wilson(successes: Column, trials: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval; [0, 1] without trials."""
    n, p = trials.cast("double"), successes / trials
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(trials == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - spread))
    return low, F.when(trials == 0, 1.0).otherwise(F.least(F.lit(1.0), middle + spread))


def grid(first: float = 0.70, last: float = 0.99, step: float = 0.01) -> list[float]:
    """Thresholds from first to last; each is the one before plus the step."""
    out, now = [], first
    while now <= last + 1e-9:
        out.append(now)
        now += step
    return out


def confusion(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts for each threshold of scored(similarity, vetoed, should_match); served is similar enough and not vetoed.

    The thresholds are a fixed short list: pairs are counted by how many thresholds they reach, one row a count,
    before any threshold is joined.
    """
    reached = F.lit(0)
    for t in thresholds:
        reached = reached + F.when(F.col("similarity") >= t, 1).otherwise(0)
    level = F.when(F.col("vetoed"), 0).otherwise(reached)
    counted = scored.groupBy(level.alias("reached")).agg(F.count_if("should_match").alias("pos"), F.count_if(~F.col("should_match")).alias("neg"))
    each = counted.select("reached", "pos", "neg", F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(sorted(thresholds), 1)))).alias("g"))
    served = F.col("reached") >= F.col("g.step")
    sums = {"tp": ("pos", served), "fp": ("neg", served), "tn": ("neg", ~served), "fn": ("pos", ~served)}
    out = each.groupBy(F.col("g.step").alias("step"), F.col("g.threshold").alias("threshold")).agg(*(F.sum(F.when(on, F.col(c)).otherwise(0)).alias(k) for k, (c, on) in sums.items()))
    return rates(out)


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)), "false_hit_rate": rate(fp, fp + tn)})


def recommend(outcomes: DataFrame, budget: float = 0.01) -> DataFrame:
    """The recommended, safest and best-F1 thresholds; ties go to the lower threshold. Outcomes are a row a threshold."""
    within = F.col("false_hit_rate") <= budget
    order = lambda v: F.struct(v, -F.col("step"))
    return outcomes.agg(
        F.coalesce(F.max_by(F.when(within, F.col("threshold")), F.when(within, order(F.col("recall")))), F.min_by("threshold", F.struct(F.col("false_hit_rate") + 0.1 * (1 - F.col("recall")), F.col("step")))).alias("recommended"),
        F.min(F.when(F.col("fp") == 0, F.col("threshold"))).alias("safest"),
        F.max_by("threshold", order(F.col("f1"))).alias("best_f1"),
    )


def score_pairs(pairs: DataFrame, embeddings: DataFrame, guards: list[Guard] | None = None) -> DataFrame:
    """pairs(pair_id, a, b, should_match) with similarity and vetoed (the chain reads b, then a). Each distinct text is embedded
    once: embeddings(text, embedding)."""
    guards = standard() if guards is None else guards
    e = lambda side: embeddings.select(F.col("text").alias(side), F.col("embedding").alias(f"{side}_vec"))
    both = pairs.join(e("a"), "a").join(e("b"), "b")
    read = both.withColumns({"ra": T.read(F.col("a")), "rb": T.read(F.col("b"))})
    return read.select("pair_id", "should_match", V.dot(V.normalize(F.col("a_vec")), V.normalize(F.col("b_vec"))).alias("similarity"), first_rejection(guards, F.col("rb"), F.col("ra")).isNotNull().alias("vetoed"))


def rejected(pairs: DataFrame, guards: list[Guard] | None = None) -> DataFrame:
    """pairs with `rejecting`: the rules that reject the pair in one direction or the other, and whether the directions disagree.

    Each rule is evaluated once in each direction, a symmetric one once in all.
    """
    guards = standard() if guards is None else guards
    read = pairs.withColumns({"_a": T.read(F.col("a")), "_b": T.read(F.col("b"))})
    there = {f"_there{i}": g.reason(F.col("_a"), F.col("_b")) for i, g in enumerate(guards)}
    back = {f"_back{i}": g.reason(F.col("_b"), F.col("_a")) for i, g in enumerate(guards) if not g.symmetric}
    flags = read.withColumns(there | back) if guards else read
    other = [F.col(f"_back{i}" if f"_back{i}" in back else f"_there{i}") for i in range(len(guards))]
    none = F.lit(None).cast("string")
    rules = F.array(*(F.coalesce(f"_there{i}", x) for i, x in enumerate(other))) if guards else F.array().cast("array<string>")
    disagree = F.coalesce(*map(F.col, there), none).isNull() != F.coalesce(*other, none).isNull()
    return flags.withColumns({"rejecting": F.filter(rules, lambda x: x.isNotNull()), "disagrees": disagree}).drop("_a", "_b", *there, *back)


def corpus_score(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Near misses caught, paraphrases kept, with 95 % intervals. judged is what `rejected` returns."""
    hit = F.size("rejecting") > 0
    counted = judged.groupBy(*(keys or [])).agg(
        F.count_if(~F.col("should_match")).alias("near_misses"),
        F.count_if(~F.col("should_match") & hit).alias("caught"),
        F.count_if("should_match").alias("paraphrases"),
        F.count_if(F.col("should_match") & ~hit).alias("kept"),
        F.count_if("disagrees").alias("direction_disagreements"),
    )
    (lo, hi), (low, high) = wilson(F.col("caught"), F.col("near_misses")), wilson(F.col("kept"), F.col("paraphrases"))
    return counted.withColumns({"catch_rate": rate(F.col("caught"), F.col("near_misses")), "catch_low": lo, "catch_high": hi, "retention": rate(F.col("kept"), F.col("paraphrases")), "retention_low": low, "retention_high": high})


def by_guard(judged: DataFrame, guards: list[str]) -> DataFrame:
    """For each rule: near misses it catches, those no other rule catches, and paraphrases it loses; precision and
    recall are null without cases."""
    every = judged.sparkSession.createDataFrame([(g,) for g in guards], "guard string")
    each = judged.select("should_match", F.size("rejecting").alias("n"), F.explode("rejecting").alias("guard"))
    counted = each.groupBy("guard").agg(F.count_if(~F.col("should_match")).alias("caught"), F.count_if(~F.col("should_match") & (F.col("n") == 1)).alias("only"), F.count_if("should_match").alias("lost"))
    total = judged.agg(F.count_if(~F.col("should_match")).alias("near_misses"))
    out = every.join(counted, "guard", "left").crossJoin(F.broadcast(total)).na.fill(0, ["caught", "only", "lost"])  # total is one row
    null = F.lit(None).cast("double")
    return out.select("guard", "caught", "only", "lost", F.when(F.col("caught") + F.col("lost") == 0, null).otherwise(F.col("caught") / (F.col("caught") + F.col("lost"))).alias("precision"), F.when(F.col("near_misses") == 0, null).otherwise(F.col("caught") / F.col("near_misses")).alias("recall"))


def separated(a_successes: Column, a_trials: Column, b_successes: Column, b_trials: Column) -> Column:
    """Whether two rates' intervals don't touch."""
    (al, ah), (bl, bh) = wilson(a_successes, a_trials), wilson(b_successes, b_trials)
    return (ah < bl) | (bh < al)


def trials_to_separate(asked: DataFrame, around: float = 0.68, step: int = 10, most: int = 1_000_000) -> DataFrame:
    """asked(points) with `trials`: the least number of trials, in steps, at which rates that are so many percentage
    points apart, around a rate, have separate intervals; 2147483647 where `most` are too few.

    Successes are whole numbers, cut off. The tries are a fixed list of most / step numbers.
    """
    side = lambda sign: F.least(F.greatest(F.lit(around) + sign * F.col("points") / 200, F.lit(0.0)), F.lit(1.0))
    each = asked.select("points").distinct().withColumn("n", F.explode(F.sequence(F.lit(step), F.lit(most), F.lit(step))))
    low, high = F.floor(side(F.lit(-1)) * F.col("n")), F.floor(side(F.lit(1)) * F.col("n"))
    apart = each.where(separated(low, F.col("n"), high, F.col("n")))
    found = apart.groupBy("points").agg(F.min("n").alias("trials"))
    return asked.join(found, "points", "left").withColumn("trials", F.coalesce("trials", F.lit(2**31 - 1)))


def by_band(judged: DataFrame) -> DataFrame:
    """Counts for each length band of pairs, empty bands with zeros."""
    return _every(judged.withColumn("band", T.length_band(F.col("a"), F.col("b"))), "band", "int", list(enumerate(T.BANDS)), "label")


def by_register(judged: DataFrame) -> DataFrame:
    """Counts for each register of pairs, empty registers with zeros."""
    return _every(judged.withColumn("register", T.pair_register(F.col("a"), F.col("b"))), "register", "string", [(r,) for r in T.REGISTERS])


def _every(judged: DataFrame, key: str, kind: str, listed: list[tuple], label: str | None = None) -> DataFrame:
    every = judged.sparkSession.createDataFrame(listed, f"{key} {kind}" + (f", {label} string" if label else ""))
    counts = ["pairs", "near_misses", "caught", "paraphrases", "kept"]
    scored = corpus_score(judged, [key]).withColumn("pairs", F.col("near_misses") + F.col("paraphrases")).select(key, *counts)
    return every.join(scored, key, "left").na.fill(0, counts)


def verifier_cost(asked: DataFrame) -> DataFrame:
    """asked(lookup_id, should_match, accepted, tokens): calls per lookup, tokens per call and per false hit that a call stopped."""
    counted = asked.agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("lookup_id").alias("lookups"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(~F.col("should_match") & ~F.col("accepted")).alias("avoided"))
    return counted.withColumns({"calls_per_lookup": rate(F.col("calls"), F.col("lookups")), "tokens_per_call": rate(F.col("tokens"), F.col("calls")), "tokens_per_avoided": rate(F.col("tokens"), F.col("avoided"))})


def verifier_frontier(asked: DataFrame, cuts: list[float]) -> DataFrame:
    """What each confidence cut stops and keeps, of asked(should_match, confidence)."""
    each = asked.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    stopped = ~F.coalesce(F.col("confidence") >= F.col("cut"), F.lit(False))
    counted = each.groupBy("cut").agg(F.count_if(~F.col("should_match") & stopped).alias("stopped"), F.count_if(~F.col("should_match")).alias("near_misses"), F.count_if(F.col("should_match") & ~stopped).alias("kept"), F.count_if("should_match").alias("paraphrases"))
    return counted.withColumns({"stop_rate": rate(F.col("stopped"), F.col("near_misses")), "keep_rate": rate(F.col("kept"), F.col("paraphrases"))})
