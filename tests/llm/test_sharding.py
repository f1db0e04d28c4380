import random
import zlib

import pytest

from palisade.llm import sharding as S


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    by = {k: [r for r in got if r.shard == k] for k in range(shards)}
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    total, most = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0)
    for mine in by.values():
        assert abs(sum(r["size"] for r in mine) - total / shards) <= 2 * most
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)


@pytest.mark.parametrize("hot", [False, True])
def test_near_equal_bytes(spark, hot):
    r = random.Random(4)
    rows = [(i, "same text" if hot and i % 3 == 0 else "x" * r.randint(0, 400) + str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = S.shard_by_bytes(df, shards=7, ranges_per_shard=4, samples_per_range=8).collect()
    check(rows, got, 7)
    again = S.shard_by_bytes(df.repartition(2), shards=7, ranges_per_shard=4, samples_per_range=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_awkward(awkward, empty):
    got = S.shard_by_bytes(awkward, shards=3).collect()
    check([(r.doc_id, r.text) for r in awkward.collect()], got, 3)
    assert S.shard_by_bytes(empty).collect() == []


def test_runs_no_python(awkward):
    plan = S.shard_by_bytes(awkward, shards=3)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
