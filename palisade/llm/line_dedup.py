"""Line dedup by a sharded minimal perfect hash over line hashes.

The lines' 128-bit hashes are counted by documents; those found in enough documents are dealt to shards, and each
shard becomes a minimal perfect hash with two compact arrays beside it, a 64-bit fingerprint and a count for each
place. Shards are sent out in groups of bounded size, documents probe the arrays for their lines, and no line is
joined. One group is the common case; with more, each group makes its own pass over the documents and the passes'
marks are united.

A line's key is the line without white space at both ends, A-Z in lower case. A null or empty text is one empty
line. Lines with keys shorter than min_chars code points always stay. A line counts once for each row it is in;
rows repeated with the same doc_id count each. The chance that a line is taken for another is below 2^-60 for
each probe. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import ASCII_SPACE, map_batches, materialize, mix64, prepare, table, texts_of

#: Keys in one shard, and bytes of shards sent out at once: what an executor's worker holds.
SHARD_KEYS, GROUP_BYTES = 500_000, 96 << 20
_BYTES_A_KEY = 20
_SCHEMA = "hi bigint, lo bigint, n bigint"


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _chars(key: bytes) -> int:
    return sum((b & 0xC0) != 0x80 for b in key) if len(key) < 64 else len(key.decode())


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """(n, 2) of unsigned 64-bit halves of the keys' hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


class PerfectHash:
    """Maps n distinct 128-bit hashes to 0 .. n-1: levels of bits, each for the keys that met others in the levels before."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, load: float = 1.5):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.rest: dict[tuple[int, int], int] = {}
        placed = 0
        while len(hi):
            if len(self.levels) >= 40:
                self.rest = {(int(a), int(b)): placed + i for i, (a, b) in enumerate(zip(hi, lo, strict=True))}
                break
            size = -(-max(64, int(len(hi) * load)) // 64) * 64
            at = self._at(hi, lo, len(self.levels), size)
            single = np.bincount(at, minlength=size) == 1
            words = np.packbits(single, bitorder="little").view(np.uint64)
            ranks = placed + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64)
            self.levels.append((size, words, ranks))
            placed += int(single.sum())
            left = ~single[at]
            hi, lo = hi[left], lo[left]

    @staticmethod
    def _at(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(hi ^ mix64(lo, level), level) % np.uint64(size)).astype(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where no level has it. A hash that wasn't built in may get any place."""
        out, open_ = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._at(hi[open_], lo[open_], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = ranks[at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get((int(hi[i]), int(lo[i])), -1)
        return out


class LineIndex:
    """One shard: the perfect hash, and at each place its key's fingerprint and count."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(hi, lo)
        at = self.hash.find(hi, lo)
        self.prints, self.counts = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint32)
        self.prints[at], self.counts[at] = hi, np.minimum(counts, 2**32 - 1)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        at = self.hash.find(hi, lo)
        safe = np.maximum(at, 0)
        return np.where((at >= 0) & (self.prints[safe] == hi), self.counts[safe], 0)


def _counted(df: DataFrame, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    def lines(batch: pa.RecordBatch) -> dict:
        each: list[bytes] = []
        for text in texts_of(batch.column(0)):
            each += {k for k in map(line_key, text.split(b"\n")) if _chars(k) >= min_chars}
        if not each:
            return None
        hi, lo, n = _unique(hashes_of(each))
        return {"hi": hi.view(np.int64), "lo": lo.view(np.int64), "n": n}

    counted = map_batches(df.select(text_col), lines, _SCHEMA).groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_docs)


def _unique(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes' halves, and how often each is there."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    hi, lo = pairs[order, 0], pairs[order, 1]
    starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[starts], lo[starts], np.diff(np.append(starts, len(hi)))


def _shard_arrays(counted: DataFrame, shards: int) -> DataFrame:
    """One row for each shard, with its hashes and counts as bytes; a shard has about SHARD_KEYS keys at any input size."""

    def pack(key, pdf):
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "hi": [pdf["hi"].to_numpy().tobytes()], "lo": [pdf["lo"].to_numpy().tobytes()], "n": [pdf["n"].to_numpy().tobytes()]})

    dealt = counted.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack, "shard int, hi binary, lo binary, n binary")


def _probe(df: DataFrame, id_col: str, text_col: str, group, shards: int, min_docs: int, min_chars: int, whole: bool) -> DataFrame:
    """Marks each document's lines that the group's shards hold; with whole, drops them at once."""

    def mark(batch: pa.RecordBatch) -> dict:
        indexes = group.value
        texts = [t.split(b"\n") for t in texts_of(batch.column(1))]
        lines = [x for t in texts for x in t]
        keys = list(map(line_key, lines))
        drop = np.zeros(len(lines), bool)
        long = np.flatnonzero([len(k) > 0 and _chars(k) >= min_chars for k in keys])
        if len(long) and indexes:
            h = hashes_of([keys[i] for i in long])
            shard = (h[:, 0].view(np.int64) % shards) if len(h) else h
            for s, index in indexes.items():
                own = np.flatnonzero(shard == s)
                drop[long[own]] = index.count(h[own, 0], h[own, 1]) >= min_docs
        return _kept(batch, texts, drop) if whole else _marks(batch, texts, drop)

    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string" if whole else "doc_id bigint, row binary, marks binary"
    return map_batches(df.select(id_col, text_col), mark, schema)


def _kept(batch, texts, drop) -> dict:
    at, kept, dropped = 0, [], []
    for t in texts:
        mine = drop[at : at + len(t)]
        at += len(t)
        dropped.append(int(mine.sum()))
        kept.append(b"\n".join([x for x, d in zip(t, mine.tolist(), strict=True) if not d]) if dropped[-1] else b"\n".join(t))
    return {
        "doc_id": batch.column(0).cast(pa.int64()),
        "n_lines": pa.array([len(t) for t in texts], pa.int64()),
        "n_dropped": pa.array(dropped, pa.int64()),
        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
    }


def _marks(batch, texts, drop) -> dict:
    at, rows, marks = 0, [], []
    for t in texts:
        rows.append(hashlib.sha256(b"\n".join(t)).digest())
        marks.append(np.packbits(drop[at : at + len(t)]).tobytes())
        at += len(t)
    return {"doc_id": batch.column(0).cast(pa.int64()), "row": pa.array(rows, pa.binary()), "marks": pa.array(marks, pa.binary())}


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and kept_sha256 of each row, without the lines found in min_docs rows or more."""
    spark = df.sparkSession
    prepare(spark)
    counted = materialize(_counted(df, text_col, min_docs, min_chars), "line-counts")
    total = counted.count()
    shards = max(1, -(-total // shard_keys))
    arrays = materialize(_shard_arrays(counted, shards), "line-shards")
    at_once = max(1, group_bytes // (shard_keys * _BYTES_A_KEY))
    groups = []
    for start in range(0, shards, at_once):
        rows = arrays.where(F.col("shard").between(start, start + at_once - 1)).collect()  # at most group_bytes
        indexes = {r["shard"]: LineIndex(np.frombuffer(r["hi"], np.uint64), np.frombuffer(r["lo"], np.uint64), np.frombuffer(r["n"], np.int64)) for r in rows}
        group = spark.sparkContext.broadcast(indexes)
        if shards <= at_once:
            return _probe(df, id_col, text_col, group, shards, min_docs, min_chars, whole=True)
        groups.append(materialize(_probe(df, id_col, text_col, group, shards, min_docs, min_chars, whole=False), "line-marks"))
        group.destroy()
    return _united(df, groups, id_col, text_col)


def _united(df: DataFrame, groups: list[DataFrame], id_col: str, text_col: str) -> DataFrame:
    """Drops the lines that any group's pass has marked. Rows of one doc_id and text have the same marks."""
    marks = groups[0]
    for g in groups[1:]:
        marks = marks.unionByName(g)
    marks = marks.groupBy("row").agg(F.collect_set("marks").alias("marks"))  # as many as there are groups, at most

    def drop(batch: pa.RecordBatch) -> dict:
        texts, drops = [t.split(b"\n") for t in texts_of(batch.column(1))], []
        for t, found in zip(texts, batch.column(2).to_pylist(), strict=True):
            bits = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in found])
            drops.append(np.unpackbits(bits)[: len(t)].astype(bool))
        return _kept(batch, texts, np.concatenate(drops))

    keyed = df.select(F.col(id_col), F.col(text_col), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("row"))
    return map_batches(keyed.join(marks, "row").select(id_col, text_col, "marks"), drop, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("kept_text")


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id,
       count(*) AS n_lines,
       count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY k.doc_id
"""
