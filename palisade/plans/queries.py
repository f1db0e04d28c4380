"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions import vectors as V
from palisade.functions.languages import for_language
from palisade.operators import guards as G
from palisade.operators import cache, lookup, score, search, state, store
from palisade.plans import prompts
from palisade.sources import readers
from palisade.sources.storage import written
from palisade.streaming import events as S

#: The vectors here are far apart: of one label, the nearest reach about 0.2 to 0.4.
THRESHOLD, DIM = 0.22, 64


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def requests(spark: SparkSession, d: str) -> DataFrame:
    return prompts.run(spark, d, prompts.REQUESTS, "embeddings")


def entries(spark: SparkSession, d: str) -> DataFrame:
    return prompts.run(spark, d, prompts.ENTRIES, "embeddings")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return prompts.spread(prompts.run(spark, d, prompts.ORDER_PAIRS, "orders"), "pair_id")


# Vectors ---------------------------------------------------------------------------------------------------------


def vector_norms(spark, d):
    v = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", V.magnitude(v).alias("norm"), V.is_normalized(v).alias("unit"), V.dot(v, V.normalize(v)).alias("self_dot"))


def vector_codes(spark, d):
    v = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", F.transform(V.int8_codes(v), lambda x: x.cast("int")).alias("int8"), V.binary_codes(v).alias("signs"))


def nearest_in_scope(spark, d):
    return search.nearest(requests(spark, d), entries(spark, d), k=5, dim=DIM).select("query_id", "entry_id", "similarity", "rank")


def nearest_int8(spark, d):
    return search.nearest_by_codes(requests(spark, d), entries(spark, d), k=5, codes="int8").select("query_id", "entry_id", "similarity", "rank")


def nearest_binary(spark, d):
    return search.nearest_by_codes(requests(spark, d), entries(spark, d), k=5, codes="binary").select("query_id", "entry_id", "similarity", "rank")


def nearest_cells(spark, d):
    return search.nearest_by_cells(requests(spark, d), entries(spark, d), k=5).select("query_id", "entry_id", "similarity", "rank")


def nearest_diverse(spark, d):
    e = entries(spark, d)
    near = search.nearest(requests(spark, d), e, k=5, dim=DIM).join(e.select("entry_id", "embedding"), "entry_id")
    return search.rerank_diverse(near)


def visible_at_request(spark, d):
    """Nearest entries written before the request, by time."""
    at = lambda df, i: df.withColumn("ts", F.timestamp_micros(F.pmod(F.col(i) * 7919, F.lit(100_000)) * 1_000_000))
    q, e = at(requests(spark, d), "query_id"), at(entries(spark, d), "entry_id").withColumnRenamed("ts", "created_at")
    return search.nearest(q, e, k=3, dim=DIM, as_of=True).select("query_id", "entry_id", "similarity", "rank")


# Text and rules --------------------------------------------------------------------------------------------------


def text_words(spark, d):
    w = T.words(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(w).alias("n_words"), F.size(T.content(w)).alias("n_content"), F.array_join(T.content(w), " ").alias("content"))


def text_numbers(spark, d):
    return pairs(spark, d).select("pair_id", F.array_join(T.numbers(F.col("a")), " ").alias("numbers_a"), F.array_join(T.numbers(F.col("b")), " ").alias("numbers_b"))


def document_numbers(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.numbers(F.col("text"))).alias("n_numbers"), F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


def text_units(spark, d):
    return pairs(spark, d).select("pair_id", F.array_join(F.array_sort(F.transform(T.units(T.words(F.col("a"))), lambda u: u["name"])), " ").alias("units"))


def text_names(spark, d):
    return pairs(spark, d).select("pair_id", F.array_join(T.names(F.col("a")), " ").alias("names_a"), F.array_join(T.names(F.col("b")), " ").alias("names_b"))


def text_ngrams(spark, d):
    return pairs(spark, d).select("pair_id", T.jaccard(T.n_grams(F.col("a")), T.n_grams(F.col("b"))).alias("jaccard"))


def text_similar_questions(spark, d):
    return readers.similar_questions(pairs(spark, d), 0.6).select("pair_id")


def text_registers(spark, d):
    """How many pairs are of each register and length band; those of none, too."""
    counted = pairs(spark, d).groupBy(T.pair_register(F.col("a"), F.col("b")).alias("register"), T.length_band(F.col("a"), F.col("b")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(r, i) for r in T.REGISTERS for i in range(len(T.BANDS))], "register string, band int")
    return every.join(counted, ["register", "band"], "left").na.fill(0, ["n"])


def _read(spark, d) -> DataFrame:
    return pairs(spark, d).select("pair_id", T.read(F.col("a")).alias("q"), T.read(F.col("b")).alias("c"))


def _guard(guard: G.Guard) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _read(spark, d).select("pair_id", guard.reason(F.col("q"), F.col("c")).isNotNull().alias("rejects"))


def guard_answer_anchor(spark, d):
    said = F.concat(F.lit("It is about "), F.col("c.text"))
    return _read(spark, d).select("pair_id", G.answer_anchor().reason(F.col("q"), F.col("c"), said).isNotNull().alias("rejects"))


def guard_suspicion(spark, d):
    return _read(spark, d).select("pair_id", F.round(G.suspicion(F.col("q"), F.col("c")), 9).alias("suspicion"))


def guard_languages(spark, d):
    """Each language's chain on sentences of its own."""
    rows = [
        ("it", "Come attivare il registro", "Come disattivare il registro"), ("it", "Vorrei 3 grammi di farina", "Vorrei 3 libbre di farina"), ("it", "Spiega la fotosintesi", "spiega la fotosintesi"),
        ("es", "Cómo abrir una cuenta", "Cómo cerrar una cuenta"), ("es", "Qué tiempo hace hoy", "Qué tiempo hace mañana"), ("es", "Escribe un poema", "escribe un poema"),
        ("de", "Datei verschlüsseln", "Datei entschlüsseln"), ("de", "Wetter heute", "Wetter morgen"), ("de", "Erkläre den Satz", "erkläre den Satz"),
        ("fr", "Comment ajouter un compte", "Comment supprimer un compte"), ("fr", "Courir 5 heures", "Courir 5 jours"), ("fr", "Décris le plan", "décris le plan"),
    ]
    out = None
    for code in ("it", "es", "de", "fr"):
        v = for_language(code)
        mine = spark.createDataFrame([r for r in rows if r[0] == code], "lang string, a string, b string").select("lang", "a", T.read(F.col("a"), v).alias("q"), T.read(F.col("b"), v).alias("c"))
        judged = mine.select("lang", "a", G.first_rejection(G.standard(v), F.col("q"), F.col("c")).alias("guard"))
        out = judged if out is None else out.unionByName(judged)
    return out


def text_envelopes(spark, d):
    """Requests inside retrieval prompts of 512 characters and more."""
    p = requests(spark, d).select(F.col("query_id").alias("pair_id"), F.col("prompt").alias("a"), F.concat(F.col("prompt"), F.lit("?")).alias("b"))
    return readers.enveloped(p, 512).select("pair_id", F.md5("a").alias("a_md5"), F.length("b").alias("b_length"))


def guard_field_terms(spark, d):
    """A rule for one field: places that must agree."""
    field = G.disjoint_terms("places", {"iberia": ("lisbon", "madrid"), "centre": ("vienna", "prague"), "east": ("warsaw",)})
    return _guard(field)(spark, d)


def guard_chain(spark, d):
    chains = {n: G.PRESETS[n]() for n in ("standard", "strict", "prose")}
    return G.first_rejections(_read(spark, d), chains, "q", "c").select("pair_id", *chains)


GUARDS = {
    "numeric": G.numeric(),
    "unit": G.unit(),
    "temporal": G.temporal(),
    "negation": G.negation(),
    "antonym": G.antonym(),
    "entity": G.entity(),
    "substitution": G.substitution(),
    "substitution_short": G.substitution(least=3, head_least=4),
    "substitution_long": G.substitution(most=12),
    "scope": G.scope(),
    "direction": G.direction(),
    "sub_span": G.sub_span(),
    "lexical_divergence": G.lexical_divergence(),
    "length_ratio": G.length_ratio(),
    "word_order": G.word_order(),
    "slot_order": G.slot_order(),
}

# Lookups ---------------------------------------------------------------------------------------------------------

def _decided(spark, d, **options) -> DataFrame:
    return lookup.decide(requests(spark, d), entries(spark, d), threshold=THRESHOLD, dim=DIM, **options)


def lookup_decisions(spark, d):
    return _decided(spark, d)


def lookup_standard(spark, d):
    """The same with each scope's entries dealt to four tasks."""
    return _decided(spark, d, salts=4)


def lookup_scope_thresholds(spark, d):
    own = spark.createDataFrame([("0", 0.1), ("1", 0.3)], "scope string, threshold double")
    return _decided(spark, d, thresholds=own).select("query_id", "is_hit", "entry_id", "reason")


def lookup_verified(spark, d):
    same_end = lambda q, s, _: F.substring(q, -3, 3) == F.substring(s, -3, 3)
    return lookup.decide(requests(spark, d), entries(spark, d), [], verifier=same_end, threshold=THRESHOLD, dim=DIM).select("query_id", "is_hit", "entry_id", "reason")


def lookup_explained(spark, d):
    e = lookup.explain(requests(spark, d), entries(spark, d), threshold=THRESHOLD, dim=DIM)
    return e.select("query_id", "entry_id", "rank", "similarity", "above", "same_embedder", *(F.col("verdicts")[g.name].alias(g.name.replace("-", "_")) for g in G.standard()))


def lookup_shadow(spark, d):
    return lookup.shadow(requests(spark, d), entries(spark, d), [0.18, 0.22, 0.26], dim=DIM)


def lookup_confident(spark, d):
    surer = lambda q, s, similarity: similarity * 2 + F.when(F.right(q, F.lit(3)) == F.right(s, F.lit(3)), 0.3).otherwise(0.0)
    return lookup.decide(requests(spark, d), entries(spark, d), [], verifier=lookup.confident(surer, 0.75), threshold=THRESHOLD, dim=DIM).select("query_id", "is_hit", "entry_id", "reason")


def lookup_recorded(spark, d):
    """Verdicts on file: a third of the pairs of prompts is accepted, a third refused, of the rest nothing is known."""
    q, e = requests(spark, d).select(F.col("prompt").alias("query")).distinct(), entries(spark, d).select(F.col("prompt").alias("cached")).distinct()
    kind = F.length("query") + F.length("cached")
    said = q.join(e, F.right("query", F.lit(1)) == F.right("cached", F.lit(1))).where(kind % 3 < 2).withColumn("accepted", kind % 3 == 0)
    return lookup.decide(requests(spark, d), entries(spark, d), [], verdicts_by_text=said, threshold=THRESHOLD, dim=DIM).select("query_id", "is_hit", "entry_id", "reason")


def lookup_diverse(spark, d):
    """The order of marginal relevance decides which candidate is served."""
    return lookup.decide(requests(spark, d), entries(spark, d), reranker=search.rerank_diverse, threshold=0.15, dim=DIM).select("query_id", "is_hit", "entry_id", "reason")


def lookup_tenants(spark, d):
    """Requests and entries of three tenants; nothing is served across."""
    of = lambda df, i: cache.for_tenant(df.withColumn("tenant", F.concat(F.lit("t"), (F.floor(F.col(i) / 2) % 3).cast("string"))))
    q, e = of(requests(spark, d), "query_id"), of(entries(spark, d), "entry_id")
    return lookup.decide(q, e, [G.numeric()], threshold=0.15, dim=DIM).select("query_id", "is_hit", "entry_id", "reason")


def _answered(spark, d) -> DataFrame:
    # Every 17th request has no vector, as if its embedding had failed.
    q = requests(spark, d).withColumn("embedding", F.when(F.col("query_id") % 17 != 0, F.col("embedding")))
    made = lambda prompt: F.concat(F.lit("made for "), prompt)
    return cache.get_or_put_all(q, entries(spark, d), made, guards=[G.numeric()], threshold=THRESHOLD, dim=DIM)


def cache_answers(spark, d):
    return _answered(spark, d).select("query_id", "response", "how")


def cache_written(spark, d):
    veto = F.when(F.col("response").contains("tutorial"), "no tutorials")
    return cache.new_entries(_answered(spark, d), veto).select("entry_id", "scope", "prompt", "response", "first_query_id", "veto_reason")


def cache_stats(spark, d):
    answers = _answered(spark, d)
    return cache.outcome_stats(answers, cache.new_entries(answers, F.when(F.col("response").contains("tutorial"), "no tutorials")))


def cache_exact(spark, d):
    """Documents asked for again: the same text in the same language is served without a vector's help."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    vector = F.array(F.length("text").cast("float"), F.lit(1.0).cast("float"))
    q = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("scope"), F.col("text").alias("prompt"), vector.alias("embedding"), F.lit("new").alias("embedder"))
    e = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("scope"), F.col("text").alias("prompt"), F.md5("text").alias("response"), vector.alias("embedding"), F.lit("new").alias("embedder"))
    return cache.get_or_put_all(q, e, F.md5, exact=True, guards=[], threshold=1e18, dim=2).select("query_id", "response", "how")


def lookup_exact(spark, d):
    docs = _t(spark, d, "documents")
    asked = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("scope"), F.col("text").alias("prompt"))
    stored = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("scope"), F.col("text").alias("prompt"))
    return lookup.exact_hits(asked, stored)


def conversation_keys(spark, d):
    return lookup.fold_conversation(_t(spark, d, "conversations")).select("conv_id", "turn", F.md5("key").alias("key_md5"), F.length("key").alias("key_length"))


def retrieval(spark, d):
    """Each request's nearest entry of its scope."""
    return search.nearest(requests(spark, d), entries(spark, d), k=1, dim=DIM).select("query_id", "entry_id")


# Statistics ------------------------------------------------------------------------------------------------------


def stats_total(spark, d):
    return state.stats(_decided(spark, d))


def stats_by_scope(spark, d):
    return state.stats(_decided(spark, d), ["scope"])


def stats_guards(spark, d):
    return state.rejections_by_guard(_decided(spark, d), [g.name for g in G.standard()])


def stats_savings(spark, d):
    i = F.col("event_id")
    counts = F.create_map(F.lit("inputTokens"), F.when(i % 7 != 0, (i % 50).cast("string")).otherwise("many"), F.lit("outputTokens"), F.when(i % 3 != 0, (i % 90).cast("string")))
    hits = _t(spark, d, "events").select(F.col("event_type").alias("scope"), counts.alias("metadata"))
    prices = spark.createDataFrame([("view", "USD", 0.5, 1.5, 0.25), ("click", "EUR", 0.25, 1.0, 0.0), ("error", "USD", 1.0, 2.0, 0.5)], "scope string, currency string, price_in double, price_out double, price_call double")
    return state.savings(hits, prices)


def stats_metrics(spark, d):
    e = _t(spark, d, "events").withColumn("tag", F.get_json_object("props", "$.k"))
    return state.metrics(e).select("event_type", "tag", "n", F.round("total", 4).alias("total"), "most")


def stats_spans(spark, d):
    s = lambda name, n: F.struct(F.lit(name).alias("name"), n.cast("long").alias("nanos"))
    i = F.col("event_id")
    each = _t(spark, d, "events").select(i.alias("query_id"), (i * 1000 + 5000).alias("end_nanos"), F.array(s("embed", i % 100), s("search", i % 37), s("verify", i % 11)).alias("stages"))
    return state.spans_of(each)


def stats_timers(spark, d):
    i = F.col("event_id")
    return state.timers(_t(spark, d, "events").select((i % 100).alias("embed_nanos"), (i % 37).alias("search_nanos"), (i % 11).alias("verify_nanos")))


def stats_log(spark, d):
    return state.log_lines(_t(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.col("props").alias("prompt")))


def _seen(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.col("event_type").alias("scope"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("prompt"), "value")


def admission_outcomes(spark, d):
    return state.admission(_seen(spark, d), ["event_id"]).select("event_id", "sighting", "outcome")


def admission_rates(spark, d):
    first, *rest = (state.admission_summary(_seen(spark, d), ["event_id"], n) for n in (1, 2, 3))
    for other in rest:
        first = first.unionByName(other)
    return first


def admission_coalesced(spark, d):
    return state.coalesced(_seen(spark, d).withColumnRenamed("event_id", "query_id"))


def adaptive_thresholds(spark, d):
    samples = _t(spark, d, "events").select("event_id", F.col("event_type").alias("scope"), (F.col("value") > 40).alias("refused"))
    return state.adaptive(samples, ["event_id"])


# Scoring ---------------------------------------------------------------------------------------------------------


def _labelled(spark, d) -> DataFrame:
    return pairs(spark, d).withColumn("should_match", F.col("kind").isin("same", "typo", "grouped"))


def _judged(spark, d) -> DataFrame:
    return written(score.rejected(_labelled(spark, d)), "judged")


def score_corpus(spark, d):
    return score.corpus_score(_judged(spark, d))


def score_by_kind(spark, d):
    return score.corpus_score(_judged(spark, d), ["kind"]).select("kind", "near_misses", "caught", "paraphrases", "kept", "direction_disagreements")


def score_standard(spark, d):
    """The standard chain's counts by kind, under their older name."""
    return score_by_kind(spark, d)


def score_by_guard(spark, d):
    return score.by_guard(_judged(spark, d), [g.name for g in G.standard()])


def score_by_band(spark, d):
    return score.by_band(_judged(spark, d))


def score_by_register(spark, d):
    return score.by_register(_judged(spark, d))


def score_breakdown(spark, d):
    """Counts by kind, by band, and in all, in one pass."""
    j = _judged(spark, d).withColumn("band", T.length_band(F.col("a"), F.col("b")))
    return j.groupingSets([["kind"], ["band"], []], "kind", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("rejecting") > 0).alias("rejected"))


def score_pairs(spark, d):
    """Pairs of requests and of entries next to each other, with their texts' own vectors."""
    e = _t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("What is item "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    p = e.select(F.col("vec_id").alias("pair_id"), F.col("text").alias("a"), F.concat(F.lit("What is item "), (F.col("vec_id") - F.col("vec_id") % 10).cast("string")).alias("b"), (F.col("vec_id") % 3 == 0).alias("should_match"))
    return score.score_pairs(p, e.select("text", "embedding")).select("pair_id", "should_match", F.round("similarity", 9).alias("similarity"), "vetoed")


def calibrate_trials(spark, d):
    asked = spark.createDataFrame([(0.05,), (1.0,), (5.0,), (20.0,), (60.0,)], "points double")
    return score.trials_to_separate(asked)


def _scored(spark, d) -> DataFrame:
    """Pairs of neighbouring vectors of events: similarity, and whether users agree."""
    q, e = requests(spark, d), entries(spark, d)
    near = search.nearest(q, e, k=5, dim=DIM)
    return near.select("similarity", (F.col("entry_id") % 5 == 0).alias("vetoed"), ((F.col("query_id") + F.col("entry_id")) % 3 != 0).alias("should_match"))


def calibrate_outcomes(spark, d):
    return score.confusion(_scored(spark, d), score.grid(0.10, 0.35, 0.01))


def calibrate_recommended(spark, d):
    return score.recommend(calibrate_outcomes(spark, d), 0.2)


def calibrate_wilson(spark, d):
    c = _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = score.wilson(F.col("k"), F.col("n"))
    return c.select("o_orderstatus", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def verifier_costs(spark, d):
    asked = _t(spark, d, "events").select(F.col("user_id").alias("lookup_id"), (F.col("event_id") % 4 == 0).alias("should_match"), (F.col("value") > 20).alias("accepted"), (F.col("event_id") % 30).alias("tokens"))
    return score.verifier_cost(asked)


def verifier_cuts(spark, d):
    asked = _t(spark, d, "events").select((F.col("event_id") % 4 == 0).alias("should_match"), (F.col("value") / 100).alias("confidence"))
    return score.verifier_frontier(asked, [0.05, 0.5, 0.9])


# Store -----------------------------------------------------------------------------------------------------------

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _stored(spark, d) -> DataFrame:
    """Entries made of events: each user's last event of a type is an entry's latest write."""
    return _t(spark, d, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("entry_id"),
        F.col("event_type").alias("scope"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("prompt "), F.col("event_id").cast("string")).alias("prompt"),
        F.col("props").alias("response"),
        F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
        F.col("ts").alias("created_at"),
        F.array(F.concat(F.lit("k"), (F.col("event_id") % 10).cast("string"))).alias("tags"),
    )


def store_upsert(spark, d):
    s = _stored(spark, d)
    return store.upsert(s.where("seq % 2 = 0"), s.where("seq % 2 = 1")).select("entry_id", "seq", "prompt")


def store_live(spark, d):
    return store.live(_stored(spark, d), 5 * 86400, F.expr(_NOW)).select("seq")


def store_expired_count(spark, d):
    s = _stored(spark, d)
    gone = F.unix_micros(F.col("created_at").cast("timestamp")) + 5 * 86400 * 1_000_000 <= F.unix_micros(F.expr(_NOW))
    return s.agg(F.count_if(gone).alias("n_expired"), F.count_if(~gone).alias("n_live"))


def store_sizes(spark, d):
    return store.size(store.live(_stored(spark, d), 5 * 86400, F.expr(_NOW)), by_scope=True)


def store_recent(spark, d):
    s = store.upsert(_stored(spark, d).where("seq % 2 = 0"), _stored(spark, d).where("seq % 2 = 1"))
    used = _t(spark, d, "events").where("event_id % 13 = 0").select(F.concat_ws("-", F.col("user_id").cast("string"), F.lit("view")).alias("entry_id"), (F.col("event_id") + 1_000_000).alias("seq"))
    return store.keep_recent(s, used, 100).select("entry_id")


def store_bytes(spark, d):
    return store.keep_bytes(_stored(spark, d), 200_000).select("seq")


def store_tags(spark, d):
    return store.invalidate_by_tag(_stored(spark, d), "k3", "view").select("seq")


def store_tagged(spark, d):
    return store.tagged(_stored(spark, d), "k3", "view")


def store_live_written(spark, d):
    """Expiry from the time of writing, a day after creation here."""
    written_at = _stored(spark, d).withColumn("written_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return store.live(written_at, 5 * 86400, F.expr(_NOW), since="written_at").select("seq")


def cache_warm(spark, d):
    s = _stored(spark, d)
    return cache.warm(s.where("seq % 3 = 0"), s.where("seq % 3 = 1")).select("entry_id", "seq")


def store_clear(spark, d):
    return store.size(store.clear(_stored(spark, d), "click"), by_scope=True)


def store_remove(spark, d):
    return store.remove(_stored(spark, d), _stored(spark, d).where("seq % 10 = 0").select("entry_id").distinct()).select("seq")


def _log(spark, d) -> DataFrame:
    kind = F.when(F.col("seq") % 97 == 0, "R").when(F.col("seq") % 2003 == 0, "C").when(F.col("seq") % 501 == 0, "T").otherwise("P")
    return _stored(spark, d).withColumn("op", kind).withColumn("tag", F.when(F.col("op") == "T", F.get("tags", F.lit(0)))).withColumn("scope", F.when((F.col("op") == "T") & (F.col("seq") % 2 == 0), F.lit(None)).otherwise(F.col("scope")))


def store_log(spark, d):
    return store.fold_log(_log(spark, d)).select("entry_id", "seq")


def store_compacted(spark, d):
    """The log's fold again after it has been compacted, written and read."""
    return store.fold_log(written(store.compact(_log(spark, d)), "compacted")).select("entry_id", "seq")


def store_encrypted(spark, d):
    """Prompts and responses after encryption and decryption, and whether two encryptions differ."""
    key, s = F.lit("0123456789abcdef"), _stored(spark, d)
    one = store.decrypt(written(store.encrypt(s, key), "sealed"), key)
    return one.select("seq", "prompt", "response")


def store_vetoed(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    veto = F.when(F.col("toxic") == 1, "toxic").when(F.length("text") < 100, "short")
    return store.policy(docs, veto).groupBy("veto_reason").agg(F.count(F.lit(1)).alias("n"))


def store_near_duplicates(spark, d):
    e = entries(spark, d).withColumn("seq", F.col("entry_id"))
    return store.near_duplicates(e, 0.2, dim=DIM)


def store_chunks(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("response"))
    n = F.length("response")
    lengths = F.when(n >= 30, F.array(F.lit(10), F.lit(15), n - 25)).otherwise(F.array().cast("array<int>"))
    return store.chunks(docs.withColumn("chunk_lengths", lengths)).select("entry_id", "place", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


def store_faults(spark, d):
    e = _stored(spark, d).withColumn("chunk_lengths", F.when(F.col("seq") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).withColumn("entry_id", F.when(F.col("seq") % 50 == 0, " ").otherwise(F.col("entry_id")))
    return store.faults(e, 2).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def store_point_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey", readers.point_id(F.when(F.col("c_custkey") % 2 == 0, F.md5("c_name")).otherwise(F.col("c_name"))).alias("point_id"))


# Streaming -------------------------------------------------------------------------------------------------------


def stream_metrics(spark, d):
    return S.drained(S.windowed_metrics(S.read_events(spark, d)), "metrics", "complete").select("window_start", "event_type", "n", F.round("total", 4).alias("total"), "most")


def stream_answers(spark, d):
    return S.drained(S.assembled(S.read_turns(spark, d)), "answers").select("stream_id", "answer_no", F.md5("answer").alias("answer_md5"), "n_chunks", "n_empty")


_PLAIN = [
    vector_norms, vector_codes, nearest_in_scope, nearest_int8, nearest_binary, nearest_cells, nearest_diverse, visible_at_request,
    text_words, text_numbers, document_numbers, text_units, text_names, text_ngrams, text_similar_questions, text_registers,
    guard_answer_anchor, guard_field_terms, guard_chain, guard_suspicion, guard_languages, text_envelopes,
    lookup_decisions, lookup_standard, lookup_scope_thresholds, lookup_verified, lookup_explained, lookup_shadow, lookup_confident, lookup_recorded, lookup_diverse, lookup_tenants, lookup_exact,
    cache_answers, cache_written, cache_stats, cache_exact, cache_warm, conversation_keys, retrieval,
    stats_total, stats_by_scope, stats_guards, stats_savings, stats_metrics, stats_spans, stats_timers, stats_log,
    admission_outcomes, admission_rates, admission_coalesced, adaptive_thresholds,
    score_corpus, score_by_kind, score_by_guard, score_by_band, score_by_register, score_breakdown, score_standard, score_pairs, calibrate_outcomes, calibrate_recommended, calibrate_wilson, calibrate_trials, verifier_costs, verifier_cuts,
    store_upsert, store_live, store_expired_count, store_sizes, store_recent, store_bytes, store_tags, store_tagged, store_live_written, store_clear, store_remove, store_log, store_compacted,
    store_encrypted, store_vetoed, store_near_duplicates, store_chunks, store_faults, store_point_ids,
    stream_metrics, stream_answers,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _PLAIN} | {f"guard_{n}": _guard(g) for n, g in GUARDS.items()}
