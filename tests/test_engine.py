"""Lookups, store, state, scoring and streams on small tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import vectors as V
from palisade.operators import lookup, score, search, state, store
from palisade.operators import guards as G
from palisade.plans import queries
from palisade.sources import readers

ENTRIES = "entry_id bigint, scope string, embedding array<float>, prompt string, response string, embedder string"
REQUESTS = "query_id bigint, scope string, embedding array<float>, prompt string, embedder string"


def tables(spark):
    e = [(1, "s", [1.0, 0.0], "Book 120 chairs", "r1", "m"), (2, "s", [0.96, 0.28], "Book 210 chairs", "r2", "m"), (3, "s", [0.9, 0.43589], "Book 210 chairs", "r3", "old"), (4, "t", [0.0, 1.0], "other", "r4", "m")]
    q = [(10, "s", [1.0, 0.0], "Book 210 chairs", "m"), (11, "t", [1.0, 0.0], "other", "m"), (12, "none", [1.0, 0.0], "x", "m"), (13, "s", [1.0, 0.0], "Convert 999 USD to EUR", "m")]
    return spark.createDataFrame(q, REQUESTS), spark.createDataFrame(e, ENTRIES)


@pytest.mark.parametrize("options", [{}, {"dim": 2}, {"salts": 3}])
def test_decisions(spark, options):
    q, e = tables(spark)
    got = {r.query_id: r for r in lookup.decide(q, e, threshold=0.85, **options).collect()}
    assert (got[10].is_hit, got[10].entry_id, got[10].response) == (True, 2, "r2")  # the nearest was refused
    assert (got[11].is_hit, got[11].reason, got[11].best_prompt) == (False, "BELOW_THRESHOLD", "other")
    assert (got[12].reason, got[12].best_similarity) == ("EMPTY_SCOPE", None)
    assert (got[13].reason, got[13].guard, got[13].embedder_mismatch) == ("GUARD_REJECTED", "numeric", True)


def test_verifier_null_counts_as_no(spark):
    q, e = tables(spark)
    got = {r.query_id: r.reason for r in lookup.decide(q, e, [], verifier=lambda a, b, s: F.lit(None).cast("boolean"), threshold=0.85).collect()}
    assert got[10] == "VERIFIER_REJECTED"


def test_explain_shadow_exact(spark):
    q, e = tables(spark)
    assert lookup.explain(q, e, threshold=0.85).count() == 3 + 3 + 1
    shadow = {(r.query_id, r.threshold): r for r in lookup.shadow(q, e, [0.5, 0.99]).collect()}
    assert shadow[10, 0.5].entry_id == 2 and not shadow[10, 0.99].would_hit and len(shadow) == 8
    assert sorted((r.query_id, r.entry_id) for r in lookup.exact_hits(q, e).collect()) == [(10, 3), (11, 4)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],)], "v array<float>")
    rows = df.select(V.normalize(F.col("v"), strict=False).alias("n"), V.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert rows[0].n == pytest.approx([0.6, 0.8]) and rows[0].c == pytest.approx(1) and rows[1].c == 0.0
    assert [r.n for r in rows[1:]] == [None] * 3
    with pytest.raises(Exception, match="not finite"):
        df.select(V.normalize(F.col("v"))).collect()
    codes = spark.createDataFrame([([0.5, -0.5, 1.0, -1.0],)], "v array<float>").select(V.int8_codes(F.col("v")).alias("i"), V.binary_codes(F.col("v")).alias("b")).first()
    assert codes.i == [64, -63, 127, -127] and codes.b == [0b0101]


def test_recall_of_cells_and_codes(spark):
    r = np.random.default_rng(7)
    unit = lambda n: [(i, "s", [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(r.normal(size=(n, 32)))]
    e = spark.createDataFrame(unit(1000), "entry_id bigint, scope string, embedding array<float>").cache()
    q = spark.createDataFrame(unit(50), "query_id bigint, scope string, embedding array<float>").cache()
    pairs = lambda df: {(x.query_id, x.entry_id) for x in df.select("query_id", "entry_id").collect()}
    exact = pairs(search.nearest(q, e, 10, dim=32))
    assert len(pairs(search.nearest_by_cells(q, e, 10, cells=16, probes=12)) & exact) / len(exact) >= 0.9
    assert len(pairs(search.nearest_by_codes(q, e, 10, "int8")) & exact) / len(exact) == 1
    assert len(pairs(search.nearest_by_codes(q, e, 10, "binary")) & exact) / len(exact) >= 0.9  # signs of 32 components say little


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_recall_of_the_registered_cells(spark):
    q, e = queries.requests(spark, "/root/testdata/sf0.1").cache(), queries.entries(spark, "/root/testdata/sf0.1").cache()
    pairs = lambda df: {(x.query_id, x.entry_id) for x in df.select("query_id", "entry_id").collect()}
    exact = pairs(search.nearest(q, e, 5, dim=64))
    assert len(pairs(queries.nearest_cells(spark, "/root/testdata/sf0.1")) & exact) / len(exact) >= 0.9


def test_a_hot_scope_is_dealt_to_many_tasks(spark, monkeypatch):
    e = spark.createDataFrame([(i, "hot" if i % 10 else "cold", [float(i % 7), 1.0]) for i in range(100)], "entry_id bigint, scope string, embedding array<float>")
    q = spark.createDataFrame([(1, "hot", [1.0, 0.0]), (2, "cold", [0.0, 1.0]), (3, "none", [0.0, 1.0])], "query_id bigint, scope string, embedding array<float>")
    want = sorted(map(tuple, search.nearest(q, e, 5, salts=1).select("query_id", "entry_id", "rank").collect()))
    assert search.salts_of(e) == 1 and search.salts_of(e.limit(0)) == 1
    monkeypatch.setattr(search, "SALT_ROWS", 20)
    assert search.salts_of(e) == 5
    assert sorted(map(tuple, search.nearest(q, e, 5).select("query_id", "entry_id", "rank").collect())) == want


def test_diverse_order(spark):
    rows = [(1, 1, 0.99, 1, [1.0, 0.0]), (1, 2, 0.98, 2, [1.0, 0.0]), (1, 3, 0.7, 3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id bigint, entry_id bigint, similarity double, rank int, embedding array<float>")
    assert [r.entry_id for r in search.rerank_diverse(df, 0.7).orderBy("place").collect()] == [1, 3, 2]
    assert [r.entry_id for r in search.rerank_diverse(df, 1.0).orderBy("place").collect()] == [1, 2, 3]


def test_store(spark, tmp_path):
    changes = [(1, "P", "a", "x", None, ["t1"]), (2, "P", "a", "y", None, ["t2"]), (3, "T", None, None, "t1", None), (4, "P", "b", "z", None, ["t1"]), (5, "R", None, "y", None, None), (6, "P", "a", "w", None, None), (7, "C", "b", None, None, None), (8, "P", "b", "v", None, [])]
    schema = "seq bigint, op string, scope string, entry_id string, tag string, tags array<string>"
    log = spark.createDataFrame(changes, schema)
    assert {r.entry_id for r in store.fold_log(log).collect()} == {"w", "v"}
    assert {r.entry_id for r in store.fold_log(store.compact(log)).collect()} == {"w", "v"}
    everything = log.unionByName(spark.createDataFrame([(9, "C", None, None, None, None)], schema))
    assert store.fold_log(everything).count() == 0
    s = spark.createDataFrame([(i, f"e{i}", [0.0], "p" * i, "r") for i in range(10)], "seq bigint, entry_id string, embedding array<float>, prompt string, response string")
    assert {r.seq for r in store.keep_bytes(s, 300).collect()} == {9, 8}
    assert {r.seq for r in store.keep_bytes(s, 1).collect()} == {9}
    used = spark.createDataFrame([("e0", 100)], "entry_id string, seq bigint")
    assert {r.entry_id for r in store.keep_recent(s, used, 2).collect()} == {"e0", "e9"}


def test_encryption(spark):
    df = spark.createDataFrame([("s", "prompt", "answer"), ("t", "prompt", "answer")], "scope string, prompt string, response string")
    key = F.lit("0123456789abcdef")
    sealed = store.encrypt(df, key).cache()
    assert len({r.prompt for r in sealed.collect()}) == 2
    assert {(r.prompt, r.response) for r in store.decrypt(sealed, key).collect()} == {("prompt", "answer")}
    with pytest.raises(Exception):
        store.decrypt(sealed.withColumn("scope", F.lit("other")), key).collect()


def test_state(spark):
    rows = [(i, "s", i % 4 == 0) for i in range(650)]
    path = state.adaptive(spark.createDataFrame(rows, "i int, scope string, refused boolean"), ["i"]).orderBy("window").collect()
    assert [round(r.threshold, 3) for r in path] == [0.945, 0.95, 0.955]
    seen = spark.createDataFrame([(i, "s", "ab"[i % 2]) for i in range(7)], "i int, scope string, prompt string")
    got = state.admission_summary(seen, ["i"], 2).first()
    assert (got.n_hit, got.n_stored, got.n_held_back) == (3, 2, 2)


def test_scores(spark):
    pairs = spark.createDataFrame([("Convert 1 kg", "Convert 2 kg", False), ("Sort an array", "sort an array", True), ("Convert 3 kg", "Convert 4 kg", True)], "a string, b string, should_match boolean")
    judged = score.rejected(pairs)
    got = score.corpus_score(judged).first()
    assert (got.caught, got.near_misses, got.kept, got.paraphrases, got.direction_disagreements) == (1, 1, 1, 2, 0)
    by = {r.guard: r for r in score.by_guard(judged, ["numeric", "unit"]).collect()}
    assert (by["numeric"].caught, by["numeric"].only, by["numeric"].lost, by["unit"].precision) == (1, 1, 1, None)
    low, high = score.wilson(F.col("k"), F.col("n"))
    w = spark.createDataFrame([(61, 86), (0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert (round(w[0].l, 3), round(w[0].h, 3)) == (0.606, 0.795) and tuple(w[1]) == (0.0, 1.0)
    assert len(score.grid()) == 30 and len(score.grid(0.90, 0.95)) == 6
    tried = {r.points: r.trials for r in score.trials_to_separate(spark.createDataFrame([(40.0,), (5.0,), (0.001,)], "points double"), 0.7).collect()}
    assert tried == {40.0: 20, 5.0: 1280, 0.001: 2**31 - 1}


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"about": "x", "pairs": [{"a": "1", "b": "2", "shouldMatch": True, "category": "c"}]}))
    assert [tuple(r) for r in readers.read_pairs(spark, f"file://{tmp_path}/p.json").collect()] == [("1", "2", True, "c")]
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "i", "question": "q", "answers": [{"text": "a"}]}]}]}]}))
    documents, questions = readers.read_articles(spark, f"file://{tmp_path}/q.json")
    assert documents.first().text == "c" and questions.first().answer == "a"
    ids = spark.createDataFrame([("0123456789abcdef0123456789ABCDEF",), ("x",)], "i string").select(readers.point_id(F.col("i")).alias("p")).collect()
    assert ids[0].p == "01234567-89ab-cdef-0123-456789abcdef" and len(ids[1].p) == 36


def test_presets_have_their_rules():
    names = {n: [g.name for g in make()] for n, make in G.PRESETS.items()}
    assert len(names["standard"]) == 11 and "substitution" not in names["prose"] and names["none"] == []
    assert names["response_aware"][-1] == "answer-anchor" and names["strict"][-1] == "length-ratio"
