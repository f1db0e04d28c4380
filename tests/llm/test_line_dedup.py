import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palisade.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least, chars=1):
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and docs[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 5, "group_bytes": 100}])
def test_against_counting(spark, awkward, sizes):
    r = random.Random(2)
    lines = [f"Line {i}" for i in range(40)] + ["", " ", "été", "ÉTÉ"]
    rows = [(i, "\n".join(r.choice(lines) + r.choice(["", " ", "\r"]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(L.line_dedup(df, min_docs=10, **sizes)) == brute(rows, 10)
    same = [(x.doc_id, x.text) for x in awkward.collect()]
    assert rows_of(L.line_dedup(awkward, min_docs=2, **sizes)) == brute(same, 2)


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "A \nc")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.kept_text) for r in L.line_dedup(df, min_docs=2).collect()) == [(1, "b"), (2, "c")]


def test_perfect_hash_is_minimal():
    h = L.hashes_of([b"%d" % i for i in range(5000)])
    index = L.PerfectHash(h[:, 0], h[:, 1])
    assert sorted(index.find(h[:, 0], h[:, 1]).tolist()) == list(range(5000))
    counts = L.LineIndex(h[:, 0], h[:, 1], np.arange(5000))
    assert counts.count(h[:, 0], h[:, 1]).tolist() == list(range(5000))
    other = L.hashes_of([b"x%d" % i for i in range(5000)])
    assert not counts.count(other[:, 0], other[:, 1]).any()


def test_empty(empty):
    assert L.line_dedup(empty).collect() == []
