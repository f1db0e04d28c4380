import re
from collections import defaultdict

import pytest

from palisade.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 6])
def test_against_grouping_by_text(spark, awkward, bits):
    got = X.exact_dedup(awkward, digest_bits=bits).collect()
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want


@pytest.mark.parametrize("bits", [64, 4])
def test_colliding_digests_are_told_apart(spark, bits):
    rows = [(i, f"text number {i % 40} " * (1 + i % 40)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df, digest_bits=bits).collect())
    assert got == sorted(brute(rows))


def test_cut_points_follow_content():
    import random

    data = random.Random(3).randbytes(200_000)
    first, moved = X.cut_points(data), X.cut_points(b"some bytes before" + data)
    chunks = lambda d, ends: {d[a:b] for a, b in zip([0, *ends], ends)}
    shared = chunks(data, first) & chunks(b"some bytes before" + data, moved)
    assert len(shared) > 0.9 * len(first)
    assert first[-1] == len(data) and max(b - a for a, b in zip([0, *first], first)) <= 8192 + 256


def test_empty(empty):
    assert X.exact_dedup(empty).collect() == []
