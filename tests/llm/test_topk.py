import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import topk as K


def brute(rows, is_query, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            c = [math.floor(256 * float(np.float32(x))) for x in v]
            ok[i] = min(ok.get(i, c), c)
    out = []
    for q, a in ok.items():
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok.items() if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 7, "tile_rows": 3}])
def test_against_every_pair(spark, sizes):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in np.round(r.normal(size=8), 1)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [1.0] * 8), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, []), (3, rows[3][1]), (600, [1e6] * 8), (650, [-3e7] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"id": F.lit(1), "codes": F.lit(2), "part": F.lit(3)}).repartition(4)
    got = sorted(map(tuple, K.top_k(df, F.col("id") % 50 == 0, 5, **sizes).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert K.top_k(df, F.col("id") % 50 == 0).collect() == []


def test_large_components_take_part(spark):
    rows = [(0, [2.0**54, -1.0]), (1, [2.0**54, 3.5]), (2, [-(2.0**100), 2.0**100]), (3, [1.0, 2.0**54]), (4, [3e38, -3e38]), (50, [1.0, 2.0]), (5, [2.0**-60, 0.0]), (100, [2.0**100, 2.0**100]), (6, [float("-inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    codes = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i != 6}
    want = []
    for q in (0, 50, 100):
        scored = sorted((-limit(sum(x * y for x, y in zip(codes[q], c))), i) for i, c in codes.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, K.top_k(df, F.col("id") % 50 == 0, 5).collect())) == want
