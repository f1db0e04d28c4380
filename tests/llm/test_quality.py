import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from palisade.llm import quality as Q


def corpus(n, seed):
    r = random.Random(seed)
    words = "the river of small towns went along a quiet road with many houses".split()
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 14))).capitalize() + "." for _ in range(r.randint(1, 8))]
        if not good:
            lines = [" | ".join(x.upper().split()) + " %%% !!" if r.random() < 0.8 else x for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Q.quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    want = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 40
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_marginals_are_those_of_all_paths():
    r = np.random.default_rng(0)
    field = Q.LineField(np.zeros(1), r.normal(size=(2, 2)))
    lines = np.array([1, 4, 3])
    emit = r.normal(size=8)
    chance, _, norm = field._sweep(emit, lines)
    at = 0
    for d, n in enumerate(lines):
        weights, ones = [], []
        for path in range(2**n):
            y = [(path >> k) & 1 for k in range(n)]
            weights.append(np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))))
            ones.append(y)
        w = np.array(weights)
        assert np.allclose(np.log(w.sum()), norm[d])
        assert np.allclose((w[:, None] * np.array(ones)).sum(0) / w.sum(), chance[at : at + n])
        at += n


def test_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = Q.quality(awkward, none).collect()
    assert len(got) == awkward.count() and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (6, 1), (6, 0), (7, None), (9, 7)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in Q.quality(awkward, labels).collect())
    assert Q.quality(empty, labels).collect() == []


def test_sample_is_bounded(spark, monkeypatch):
    rows, labels = corpus(60, 2)
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    fitted = []
    monkeypatch.setattr(Q.LineField, "fit", classmethod(lambda cls, x, size, lines, labels: fitted.append((len(x), len(labels))) or 0.5))
    Q.fit_quality(docs, marks, train_docs=20, train_lines=50)
    assert fitted and fitted[0][0] <= 50 and fitted[0][1] <= 20


def test_scores_are_those_of_each_document_alone(spark):
    """The query against messages passed along each text by itself, a few lines at a time."""
    rows, labels = corpus(150, 3)
    rows += [(1000, ""), (1001, None), (1002, "\n" * 70), (1003, "\n".join(t for _, t in rows[:30]))]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = Q.fit_quality(docs, marks)
    got = {r.doc_id: r.score for r in Q.quality(docs, marks).collect()}
    for i, text in rows:
        for block in (3, 1000):
            assert abs(got[i] - model.score_long((text or "").encode(), block)) < 1e-9


def test_many_lines_take_bounded_memory(spark):
    rows, labels = corpus(80, 4)
    docs = spark.createDataFrame([*rows, (900, "\n" * 300_000), (901, "word\n" * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in Q.quality(docs, spark.createDataFrame([*labels, (900, 0)], "doc_id bigint, quality int")).collect()}
    assert len(got) == 82 and 0 <= got[900] <= 1
    parts = list(Q._parts([b"a"] * 600 + [b"\n" * 30_000, b"b"]))
    assert [len(p) for p in parts] == [250, 250, 100, 1, 1]
