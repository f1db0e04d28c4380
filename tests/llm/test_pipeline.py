import re

import corpus_pipeline as P
from palisade.llm.queries import oracle_sql, queries

from .test_ngram_join import brute


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{path}/documents.parquet")
    labels = [(i, 0 if t and "%%%" in t else 1, 0) for i, t, *_ in rows if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages_take_effect(spark, tmp_path):
    words = "river town quiet road house many small along went stone bridge green hill".split()
    sentence = lambda k, n: " ".join(words[(k * 7 + j * j + j * k) % len(words)] + (str(k) if j % 5 == 0 else "") for j in range(n)).capitalize() + "."
    rows = [(i, "\n".join(sentence(i + 100 * j, 12) for j in range(6)), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, "%%% | ".join(w.upper() for w in sentence(i, 30).split()) + " %%%", "en", "s", 1) for i in range(40)]
    rows += [(200, rows[0][1].replace(" ", "  "), "en", "s", 1), (201, rows[1][1] + " more", "en", "s", 1)]
    d = write(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, d), "test")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == P.STAGES[-1][0] or docs.columns == columns
    assert kept["quality_classifier"] >= set(range(60)) and not kept["quality_classifier"] & set(range(100, 140))
    assert 200 in kept["quality_classifier"] and 200 not in kept["exact_dedup"]
    text = {i: re.sub(r"\s+", " ", t) for i, t, *_ in rows}
    near = {i for i, _, c in brute([(i, text[i]) for i in kept["exact_dedup"]], 5, 80, 100) if i == c}
    assert kept["ngram_jaccard_join"] == near and 201 not in near
    assert kept["packing"] == near
    assert {r.doc_id for r in P.run(spark, d).collect()} == near


def test_awkward(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(1, 1), (8, 0)], "doc_id bigint, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for stage in (P.keep_quality, P.drop_copies, P.drop_near_copies):
        assert stage(spark, awkward, f"file://{tmp_path}").columns == awkward.columns
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0
    assert P.pack(spark, empty, "").count() == 0
    kept = P.drop_copies(spark, awkward, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 6, 7, 8, 8, 9, None, 10, 12], key=str)
    packed = P.pack(spark, awkward, "").collect()
    assert sorted({r.doc_id for r in packed}, key=str) == sorted({r.doc_id for r in awkward.collect()}, key=str)


def test_run_on_odd_tables(spark, tmp_path):
    rows = [(i, "\n".join(f"Plain sentence {i} number {j} about a quiet town." for j in range(4)), "en", "s", 1) for i in range(30)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (None, "a row without an id and some words", "en", "s", 1), (52, "long words here " * 60_000, "en", "s", 1), (53, "\n" * 40_000, "en", "s", 1)]
    got = {r.doc_id for r in P.run(spark, write(spark, rows, tmp_path / "odd")).collect()}
    assert got >= {0, 52, None} and 51 not in got
    none = write(spark, rows[:0], tmp_path / "none")
    assert P.run(spark, none).collect() == []


def test_quality_stage_keeps_every_column(spark, awkward, tmp_path):
    spark.createDataFrame([(1, 1), (8, 1)], "doc_id bigint, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.keep_quality(spark, awkward, f"file://{tmp_path}").columns == awkward.columns


def test_every_number_has_a_query():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
