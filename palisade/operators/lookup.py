"""Lookups: nearest entries, threshold, rules, first survivor; and what else the same candidates can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import search
from palisade.operators.guards import Guard, first_rejection, standard, verdicts

EMPTY, BELOW, EMBEDDER, GUARD, VERIFIER = "EMPTY_SCOPE", "BELOW_THRESHOLD", "EMBEDDER_MISMATCH", "GUARD_REJECTED", "VERIFIER_REJECTED"


def candidates(requests: DataFrame, entries: DataFrame, k: int = 5, threshold: float = 0.95, thresholds: DataFrame | None = None, dim: int | None = None, as_of: bool = False, salts: int | None = None) -> DataFrame:
    """One row for each request and near entry: ids, scope, similarity, rank, the threshold that applies.

    thresholds(scope, threshold) overrides the threshold in some scopes.
    """
    near = search.nearest(requests.select("query_id", "scope", "embedding", *(["ts"] if as_of else [])), entries.select("entry_id", "scope", "embedding", *(["created_at"] if as_of else [])), k, dim, as_of, salts)
    near = near.join(requests.select("query_id", "scope"), "query_id")
    if thresholds is not None:
        near = near.join(thresholds.select("scope", F.col("threshold").alias("own")), "scope", "left").withColumn("threshold", F.coalesce("own", F.lit(threshold))).drop("own")
    else:
        near = near.withColumn("threshold", F.lit(threshold))
    return near


def read_prompts(near: DataFrame, requests: DataFrame, entries: DataFrame, read: bool = True) -> DataFrame:
    """Joins what the rules read. Each prompt is read once, before it meets its pairs; texts move only for the k kept.
    Without read, as no rule asks for it, the texts alone."""
    of = T.read(F.col("prompt")) if read else F.struct(F.col("prompt").alias("text"))
    q = requests.select("query_id", F.col("embedder").alias("q_embedder"), of.alias("incoming"))
    e = entries.select("entry_id", "response", F.col("embedder").alias("e_embedder"), of.alias("stored"))
    return near.join(q, "query_id").join(e, "entry_id")


Verifier = Callable[[Column, Column, Column], Column]
Reranker = Callable[[DataFrame], DataFrame]


def confident(confidence: Verifier, threshold: float = 0.5) -> Verifier:
    """A verifier that serves when confidence(prompt, stored prompt, similarity) reaches the threshold."""
    return lambda q, s, similarity: confidence(q, s, similarity) >= threshold


def reordered(near: DataFrame, requests: DataFrame, entries: DataFrame, reranker: Reranker) -> DataFrame:
    """near with `place`: a reranker's order of each request's candidates above the threshold, where there are more than two.

    A reranker gets query_id, entry_id, similarity, rank and embedding and adds place; it may not drop a candidate.
    """
    own = near.where(F.col("similarity") >= F.col("threshold"))
    many = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 2").select("query_id", F.lit(True).alias("_many"))
    eligible = own.join(many, "query_id", "left_semi").join(entries.select("entry_id", "embedding"), "entry_id")
    placed = reranker(eligible.select("query_id", "entry_id", "similarity", "rank", "embedding")).select("query_id", "entry_id", "place")
    lost = F.col("_many") & (F.col("similarity") >= F.col("threshold")) & F.col("place").isNull()
    out = near.join(placed, ["query_id", "entry_id"], "left").join(many, "query_id", "left")
    place = F.when(lost, F.raise_error(F.lit("a reranker reorders and never filters")).cast("int")).otherwise(F.coalesce("place", "rank"))
    return out.withColumn("place", place).drop("_many")


def decide(requests: DataFrame, entries: DataFrame, guards: list[Guard] | None = None, verifier: Verifier | None = None, verdicts_by_text: DataFrame | None = None, reranker: Reranker | None = None, hits_only: bool = False, **options) -> DataFrame:
    """One decision for each request: is_hit, entry_id, similarity, response, or the reason of the miss.

    A candidate below the threshold ends the walk; one of another embedder or that a rule refuses gives way to the
    next. A miss takes its reason from the first refused candidate. The verifier, a boolean column of the two
    prompts and the similarity, is asked about candidates that the rules accept; null counts as no. In its place
    verdicts_by_text(query, cached, accepted) gives recorded verdicts; what isn't recorded counts as no. A reranker
    says in which order the candidates above the threshold are tried. With hits_only a miss isn't explained, so
    candidates below the threshold are joined with nothing, and a text that no rule or verifier asks for doesn't move.
    """
    guards = standard() if guards is None else guards
    near = candidates(requests, entries, **options)
    near = near.withColumn("place", F.col("rank")) if reranker is None else reordered(near, requests, entries, reranker)
    if hits_only:
        near = near.where(F.col("similarity") >= F.col("threshold"))
    near = read_prompts(near, requests, entries, read=bool(guards))
    eligible = F.col("similarity") >= F.col("threshold")
    foreign = ~F.col("q_embedder").eqNullSafe(F.col("e_embedder"))
    refused = F.when(eligible & ~foreign, first_rejection(guards, F.col("incoming"), F.col("stored"), F.col("response")))
    rows = near.select("query_id", "entry_id", "similarity", "place", eligible.alias("eligible"), foreign.alias("foreign"), refused.alias("guard"), "response", F.col("stored.text").alias("stored_prompt"), F.col("incoming.text").alias("prompt"))
    clear = F.col("eligible") & ~F.col("foreign") & F.col("guard").isNull()
    if verdicts_by_text is not None:
        said = verdicts_by_text.groupBy(F.col("query").alias("prompt"), F.col("cached").alias("stored_prompt")).agg(F.bool_or("accepted").alias("_accepted"))
        rows = rows.join(said, ["prompt", "stored_prompt"], "left")
        verifier = lambda q, s, similarity: F.col("_accepted")
    if verifier is not None:
        rows = rows.withColumn("verified", F.when(clear, F.coalesce(verifier(F.col("prompt"), F.col("stored_prompt"), F.col("similarity")), F.lit(False))))
        clear = clear & F.col("verified")
    why = F.when(~F.col("eligible"), BELOW).when(F.col("foreign"), EMBEDDER).when(F.col("guard").isNotNull(), GUARD)
    why = why if verifier is None else why.when(~F.col("verified"), VERIFIER)
    if hits_only:
        rows = rows.withColumn("stored_prompt", F.lit(None).cast("string"))
    row = F.struct("place", "entry_id", "similarity", "guard", "response", "stored_prompt", why.alias("why"))
    # One pass over a request's k rows: the first that survives, the first that was refused, the nearest.
    found = rows.groupBy("query_id").agg(
        F.min(F.when(clear, row)).alias("hit"),
        F.min(F.when(~clear & F.col("eligible"), row)).alias("refused"),
        F.min(row).alias("nearest"),
        F.bool_or(F.col("eligible") & F.col("foreign")).alias("embedder_mismatch"),
    )
    hit, miss = F.col("hit").isNotNull(), F.coalesce("refused", "nearest")
    return requests.select("query_id", "scope").join(found, "query_id", "left").select(
        "query_id",
        "scope",
        hit.alias("is_hit"),
        F.col("hit.entry_id").alias("entry_id"),
        F.col("hit.similarity").alias("similarity"),
        F.col("hit.response").alias("response"),
        (F.lit(None).cast("string") if hits_only else F.when(~hit, F.coalesce(miss["why"], F.lit(EMPTY)))).alias("reason"),
        F.when(~hit, miss["guard"]).alias("guard"),
        F.when(~hit, miss["similarity"]).alias("best_similarity"),
        F.when(~hit, miss["stored_prompt"]).alias("best_prompt"),
        F.coalesce("embedder_mismatch", F.lit(False)).alias("embedder_mismatch"),
    )


def explain(requests: DataFrame, entries: DataFrame, guards: list[Guard] | None = None, **options) -> DataFrame:
    """Every candidate with every rule's verdict; nothing stops early and nothing is counted."""
    guards = standard() if guards is None else guards
    near = read_prompts(candidates(requests, entries, **options), requests, entries)
    return near.select(
        "query_id",
        "entry_id",
        "rank",
        "similarity",
        "threshold",
        (F.col("similarity") >= F.col("threshold")).alias("above"),
        F.col("q_embedder").eqNullSafe(F.col("e_embedder")).alias("same_embedder"),
        verdicts(guards, F.col("incoming"), F.col("stored"), F.col("response")).alias("verdicts"),
    )


def verdicts_of(pairs: DataFrame, verifier: Verifier) -> DataFrame:
    """Verdicts of pairs(query, cached, similarity): each two texts are judged once, whatever their similarity; no verdict is
    kept where the verifier has none."""
    once = pairs.groupBy("query", "cached").agg(F.max("similarity").alias("similarity"))
    return once.select("query", "cached", verifier(F.col("query"), F.col("cached"), F.col("similarity")).alias("accepted")).where("accepted IS NOT NULL")


def shadow(requests: DataFrame, entries: DataFrame, grid: list[float], guards: list[Guard] | None = None, k: int = 5, dim: int | None = None) -> DataFrame:
    """What each threshold of a grid would have done: one verdict for each candidate, shared by the whole grid.

    would_hit, and the served entry; else the reason, and the rule. best_similarity and matched_prompt are the served
    candidate's, else the first refused one's, else the nearest one's; null in an empty scope.
    """
    guards = standard() if guards is None else guards
    near = read_prompts(candidates(requests, entries, k=k, threshold=min(grid), dim=dim), requests, entries)
    guard = F.when(F.col("similarity") >= min(grid), first_rejection(guards, F.col("incoming"), F.col("stored"), F.col("response")))
    rows = near.select("query_id", "rank", "entry_id", "similarity", guard.alias("guard"), F.col("stored.text").alias("matched"))
    # The grid is a fixed short list: each candidate is repeated for the thresholds, not joined.
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    reached = F.col("similarity") >= F.col("threshold")
    row = F.struct("rank", "entry_id", "guard", "similarity", "matched")
    found = each.groupBy("query_id", "threshold").agg(F.min(F.when(reached & F.col("guard").isNull(), row)).alias("hit"), F.min(F.when(reached & F.col("guard").isNotNull(), row)).alias("refused"), F.min(row).alias("nearest"))
    every = requests.select("query_id", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    out = every.join(found, ["query_id", "threshold"], "left")
    hit, shown = F.col("hit").isNotNull(), F.coalesce("hit", "refused", "nearest")
    reason = F.when(hit, None).when(F.col("refused").isNotNull(), GUARD).when(F.col("nearest").isNotNull(), BELOW).otherwise(EMPTY)
    return out.select("query_id", "threshold", hit.alias("would_hit"), F.col("hit.entry_id").alias("entry_id"), F.when(~hit, F.col("refused.guard")).alias("guard"), reason.alias("reason"), shown["similarity"].alias("best_similarity"), shown["matched"].alias("matched_prompt"))


def exact_hits(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests whose prompt is stored byte for byte in their scope: query_id, entry_id (the latest id). Asked before any embedding."""
    own = F.sha2(F.coalesce("prompt", F.lit("")), 256)
    stored = entries.where("prompt IS NOT NULL").groupBy("scope", own.alias("key")).agg(F.max("entry_id").alias("entry_id"))
    asked = requests.where("prompt IS NOT NULL").select("query_id", "scope", own.alias("key"))
    return asked.join(stored, ["scope", "key"]).select("query_id", "entry_id", F.lit(1.0).alias("similarity"))


def fold_conversation(turns: DataFrame) -> DataFrame:
    """Each user turn with the text of the turns before it as its key: ROLE: text, one a line."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    folded = turns.withColumn("context", F.array_join(F.collect_list(line).over(before), ""))
    return folded.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), F.concat("context", F.coalesce("text", F.lit(""))).alias("key"))
