"""The queries that compare vectors make no row of a pair that isn't among its query's best."""

import pytest

from palisade import catalog
from palisade.functions import vectors as V

#: By finding.
NAMES = ["lookup_diverse", "cache_written", "lookup_recorded", "lookup_standard", "cache_stats", "lookup_confident", "lookup_scope_thresholds", "lookup_tenants", "cache_answers", "calibrate_recommended", "lookup_decisions", "nearest_diverse"]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One scope of 500 requests and 500 entries."""
    path = str(tmp_path_factory.mktemp("hot"))
    unit = [[1.0 if i % 64 == j else 0.3 if i % 7 == j else 0.0 for j in range(64)] for i in range(1000)]
    spark.createDataFrame([(i, v, 3) for i, v in enumerate(unit)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"file://{path}/embeddings.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("name", NAMES)
def test_no_row_of_each_pair(spark, hot, name, monkeypatch):
    def pair(*_):
        raise AssertionError("a row of each pair is scored")

    monkeypatch.setattr(V, "dot", pair)
    df = catalog.queries()[name](spark, hot)
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() in (500, 2500) or name in ("calibrate_recommended", "cache_stats", "cache_written")
