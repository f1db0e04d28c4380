import math
import zlib
from collections import Counter

import numpy as np
import pytest

from palisade.llm import lm_score as M


def slow_log10(trie, history, symbol, order):
    """Method D with exclusion by definition. trie: context bytes to Counter of next bytes."""
    excluded, out = set(), 0.0
    for j in range(order, -1, -1):
        seen = {s: n for s, n in trie.get(bytes(history[len(history) - j :]), {}).items() if s not in excluded}
        if not seen:
            continue
        total = sum(seen.values())
        if symbol in seen:
            return out + math.log10((seen[symbol] - 0.5) / total)
        out += math.log10(len(seen) / 2 / total)
        excluded |= seen.keys()
    return out - math.log10(256 - len(excluded))


def brute(rows, order):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts, trie = Counter(), {}
    for (_, t), h in zip(rows, held):
        if h:
            continue
        counts.update(tokens(t))
        history = [M.START] * order
        for s in [*(t or "").encode(), M.END]:
            for j in range(order + 1):
                trie.setdefault(bytes(history[len(history) - j :]), Counter())[s] += 1
            history = (history + [s])[1:]
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(rows, held):
        history, score = [M.START] * order, 0.0
        for s in [*(t or "").encode(), M.END]:
            score += slow_log10(trie, history, s, order)
            history = (history + [s])[1:]
        w = tokens(t)
        out.append((i, h, len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), score))
    return out


@pytest.mark.parametrize("options", [{}, {"slice_words": 7}])
def test_against_definition(spark, options):
    rows = [(i, f"the cat number {i} sat on the mat {'purring ' * (i % 4)}") for i in range(40)] + [(50, None), (51, ""), (52, "Ünïcode zq"), (None, "nobody"), (3, "twice the id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in M.lm_score(df, max_order=3, **options).collect()), key=str)
    for g, w in zip(got, sorted(brute(rows, 3), key=str), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_awkward(spark, awkward, empty):
    assert M.lm_score(awkward).count() == awkward.count()
    assert all(math.isfinite(r.score) for r in M.lm_score(awkward).collect())
    assert M.lm_score(empty).collect() == []


def test_chances_sum_to_one():
    codes, n = M._tally(M.contexts([b"abracadabra", b"", b"aaaa"], 3)[0])
    trie = M.ByteTrie(codes, n, 3)
    for context in (b"abr", b"\xfe\xfe\xfe", b"zzz", b"zab"):
        every = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert (10 ** trie._through_escapes(every)).sum() == pytest.approx(1, abs=2e-2)


def test_order_falls_until_the_trie_fits(spark):
    df = spark.createDataFrame([(i, f"text {i} of many words {i * 7919}") for i in range(60)], "doc_id bigint, text string")
    counted = M._count(df, "text", 4).where("kind = 1").cache()
    assert M.train_trie(counted, 4, 10**6).order == 4
    small = M.train_trie(counted, 4, 200)
    assert small.order < 4 and len(small.codes[small.order]) <= 200


def test_adaptive_learns():
    assert M.adaptive_code_length(b"abc" * 50) < 0.3 * M.adaptive_code_length(bytes(range(32, 182)))


@pytest.mark.parametrize("options", [{"max_nodes": 1}, {"max_nodes": 50}, {"max_nodes": 50, "slice_words": 7}, {"max_nodes": 200}])
def test_order_stays_and_no_context_is_left_out_in_slices(spark, options):
    rows = [(i, f"the cat number {i} sat on the mat {'purring ' * (i % 4)}") for i in range(12)] + [(50, None), (51, ""), (52, "Ünïcode zq"), (None, "nobody"), (3, "twice the id")]
    if options["max_nodes"] == 1:  # a slice for each context
        rows = [(i, "ab" * i) for i in range(4)] + [(52, "ba"), (53, "zab")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in M.lm_score(df, max_order=3, **options).collect()), key=str)
    for g, w in zip(got, sorted(brute(rows, 3), key=str), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_ranges_cover_all_contexts_within_the_bound(spark):
    df = spark.createDataFrame([(i, f"text {i} of many words {i * 7919}") for i in range(60)], "doc_id bigint, text string")
    longest = M._count(df, "text", 4).where("kind = 1").cache()
    ranges = M.trie_ranges(longest, 4, 40)
    back = M.reversed_contexts(M._arrays(longest)[0], 4)
    counts = [int(((back >= lo) & (back < hi)).sum()) for lo, hi in ranges]
    assert len(ranges) > 1 and max(counts) <= 40 and sum(counts) == len(back)
    assert [lo for lo, _ in ranges] == [0, *(hi for _, hi in ranges[:-1])] and ranges[-1][1] == 1 << 32
