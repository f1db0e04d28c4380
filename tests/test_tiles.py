"""Nearest entries by tiles against every pair's own sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import vectors as V
from palisade.operators import search, tiles

SCHEMA = "scope string, embedding array<float>, {t} timestamp"


def by_pairs(q, e, k, dim=None, as_of=False):
    """What every pair of a scope would say."""
    pairs = q.withColumnRenamed("embedding", "q_vec").join(e.withColumnRenamed("embedding", "e_vec"), "scope")
    pairs = pairs.where("created_at < ts") if as_of else pairs
    scored = pairs.select("query_id", "entry_id", V.dot(F.col("q_vec"), F.col("e_vec"), dim).alias("similarity"))
    return search.best(scored.where("similarity IS NOT NULL"), ["query_id"], [F.desc("similarity"), F.asc("entry_id")], k)


def rows(df):
    return sorted((r.query_id, r["rank"], r.entry_id, str(r.similarity)) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, few components, nulls, NaN and infinity, two lengths, a null scope, ids of text and times."""
    import datetime as dt

    r = np.random.default_rng(3)

    def vector(i):
        if i % 50 < 9:
            return [None, [], [1.0, None, 0.5], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, -1.0], [1.0, 2.0], [2.0, -1.0], [-0.0, 0.0, 0.0], [3e38, 3e38, 3e38]][i % 50]
        return [[0.5, 0.25, 0.125], [float(x) for x in r.integers(-2, 3, 3)], [float(x) for x in r.normal(size=3)]][i % 3]

    def made(n, own):
        return [(own(i), [None, "a", "a", "b", "c", "only " + own(i)[:1]][i % 6], vector(i // 2), dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=int(r.integers(0, 50))) if i % 41 else None) for i in range(n)]

    q = spark.createDataFrame(made(300, lambda i: f"q{i}"), "query_id string, " + SCHEMA.format(t="ts")).cache()
    e = spark.createDataFrame(made(400, lambda i: f"e{i * 7 % 400}"), "entry_id string, " + SCHEMA.format(t="created_at")).cache()
    return q, e


@pytest.mark.parametrize("options", [{}, {"dim": 3}, {"as_of": True}, {"salts": 3}])
def test_every_pair_counts(odd, options):
    q, e = odd
    want = rows(by_pairs(q, e, 5, **{k: v for k, v in options.items() if k != "salts"}))
    assert len(want) > 500 and rows(search.nearest(q, e, 5, **options)) == want


def test_small_blocks_and_parts(spark, odd, monkeypatch):
    q, e = odd
    monkeypatch.setattr(search, "QUERY_ROWS", 30)
    monkeypatch.setattr(search, "SALT_ROWS", 40)
    assert rows(search.nearest(q, e, 4)) == rows(by_pairs(q, e, 4))
    monkeypatch.setattr(tiles, "QUERY_BLOCK", 7)
    monkeypatch.setattr(tiles, "ENTRY_BLOCK", 11)
    r = np.random.default_rng(5)
    for n, made in ((3, lambda s: r.integers(-1, 2, s).astype(float)), (9, lambda s: r.normal(size=s))):
        a, b = made((40, n)), made((200, n))
        b = b[np.argsort((b @ a[0]))]  # the best come last
        want = [(i, j, s) for i in range(len(a)) for s, j in sorted(((tiles._exact(a[i], y), j) for j, y in enumerate(b)), key=lambda x: (-x[0], x[1]))[:3]]
        assert list(zip(*map(np.ndarray.tolist, tiles.best(a, b, 3)))) == want


def test_no_row_is_made_of_each_pair(spark):
    """A scope of 3,000 queries and 3,000 entries: nine million pairs, of which none is a row of a join."""
    r = np.random.default_rng(1)
    of = lambda name: spark.createDataFrame([(i, "s", v) for i, v in enumerate(r.normal(size=(3000, 4)).tolist())], f"{name} bigint, scope string, embedding array<float>")
    near = search.nearest(of("query_id"), of("entry_id"), 5, dim=4)
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 15_000


def one_by_one(v, similarity, weight):
    """Marginal relevance of one query's candidates, step by step."""
    order, left = [0], list(range(1, len(v)))
    while left:
        score = [weight * similarity[i] - (1 - weight) * max(float((v[i] * v[j]).sum()) for j in order) for i in left]
        order.append(left.pop(score.index(max(score))))
    return order


def test_diverse_orders_many_queries_at_once(spark):
    """Queries of one to seven candidates, copies among them, shuffled: one list a query, no group of rows in Python."""
    r = np.random.default_rng(2)
    rows, want = [], {}
    for q in range(200):
        n = q % 7 + 1
        v = r.integers(-2, 3, (n, 4)).astype(float)
        similarity = sorted(r.integers(0, 64, n) / 64, reverse=True)
        order = one_by_one(v, similarity, 0.75) if n > 2 else range(n)
        want |= {(q, 10 * q + i): (similarity[i], i + 1, place + 1) for place, i in enumerate(order)}
        rows += [(q, 10 * q + i, float(similarity[i]), i + 1, v[i].tolist()) for i in range(n)]
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "query_id bigint, entry_id bigint, similarity double, rank int, embedding array<float>")
    placed = search.rerank_diverse(df, 0.75)
    assert "FlatMapGroups" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert {(x.query_id, x.entry_id): (x.similarity, x["rank"], x.place) for x in placed.collect()} == want
