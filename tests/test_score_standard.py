from collections import Counter

from palisade.plans import prompts, queries


def test_score_standard_takes_every_pair(spark, tmp_path):
    orders = [(i, 7 * i + 1) for i in range(1, 97)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = Counter(prompts.PAIRS[i % len(prompts.PAIRS)][0] for i, _ in orders)
    same = {"same", "typo", "grouped"}
    got = {r.kind: r for r in queries.score_standard(spark, str(tmp_path)).collect()}
    for kind, n in kinds.items():
        assert (got[kind].near_misses, got[kind].paraphrases) == ((0, n) if kind in same else (n, 0))
    # {n} is 500 and 50 for each of key % 9, {m} the same of custkey % 7; a numeric pair is caught where they differ.
    numeric = [(i, c) for i, c in orders if prompts.PAIRS[i % len(prompts.PAIRS)][0] == "numeric"]
    assert got["numeric"].caught == sum(i % 7 != c % 9 for i, c in numeric)
    assert got["same"].kept == kinds["same"]
