import random
from collections import defaultdict

import pytest

from palisade.llm import ngram_join as N
from palisade.llm.components import components
from palisade.llm.ngram_join import Plan, ngram_join


def brute(rows, words, p, q):
    """Sizes and smallest ids reachable, by comparing every pair."""
    sets = defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and q * len(x & y) >= p * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i in ids for s in sets[i])


def run(df, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df, **options).collect() if r.doc_id is not None)


def near_copies(seed, n, length, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [r.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(length)] = r.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "p", "length", "edits"), [(3, 90, 150, 6), (1, 80, 12, 3), (5, 80, 80, 4), (2, 60, 40, 12)])
def test_against_every_pair(spark, words, p, length, edits):
    texts = near_copies(1, 60, length, edits) + near_copies(2, 20, length, 2) + near_copies(3, 15, 4, 1)
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert run(df, words=words, p=p) == brute(rows, words, p, 100)


@pytest.mark.parametrize(("words", "p", "length", "edits"), [(3, 90, 150, 9), (2, 60, 40, 14)])
def test_groups_of_copies_a_little_too_far_apart(spark, monkeypatch, words, p, length, edits):
    """Groups around a text that isn't there, done in one part and split into many."""
    rows = [(i, t) for i, t in enumerate(near_copies(7, 110, length, edits) + near_copies(8, 40, length, 2 * edits)) if len(set(t.split())) < length]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows, words, p, 100)
    assert run(df, words=words, p=p) == want
    monkeypatch.setattr(N, "GROUP_ELEMENTS", 700)
    assert run(df, words=words, p=p) == want


def test_awkward(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert run(awkward, words=3, p=90) == brute(rows, 3, 90, 100)
    nameless = [r for r in ngram_join(awkward, words=3, p=90).collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id) for r in nameless] == [(1, None)]
    assert ngram_join(empty).collect() == []


def test_boundary_is_where_costs_meet():
    plan = Plan(90, 100)
    assert plan.boundary == 19
    assert plan._light_rows(19) <= plan._heavy_rows(19)
    assert plan._light_rows(20) > plan._heavy_rows(20)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (20, 9), (7, 7)], "a bigint, b bigint")
    assert sorted(map(tuple, components(links).collect())) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (20, 8)]
