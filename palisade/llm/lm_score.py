"""Language-model scores by prediction by partial matching over bytes.

The corpus's byte contexts form a trie: for each context of up to max_order bytes, the bytes seen after it and how
often. A byte is predicted by its longest context that has been seen; a context that hasn't seen the byte escapes
to the next shorter one (method D: half of each distinct byte's first sighting goes to the escape), where the bytes
it has seen are excluded, down to all bytes alike. The model is pretrained on the training documents;
`adaptive_code_length` starts every text with an empty trie and learns as it goes.

Only the longest contexts are counted; shorter ones are their sums. The order is max_order whatever the corpus, and
no context is left out: neither the trie nor the vocabulary of the unigram base has a bound, so both are sent in
slices, of max_nodes longest contexts with their next byte and of slice_words words, a pass over the documents for
each pair of slices. A slice of the trie is a range of contexts in the order of their bytes from the last one back, so the
shorter contexts that a byte escapes to lie in the same range; those that reach over its ends are sent in full.

Nulls: a null text is empty, and still has its end. A row whose id is null is never learned from and counts as held
out. Rows that repeat an id are learned and scored each. Without training documents the score is the uniform one
and every token unknown. An empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import map_batches, materialize, mix64, prepare, table, texts_of, word_hashes

MAX_ORDER, MAX_NODES, SLICE_WORDS = 5, 4_000_000, 6_000_000
#: Two bytes that UTF-8 never has: before a text, and its end.
START, END = 0xFE, 0xFF
_PIECE = 1 << 21
_COUNTS = "kind int, code bigint, n bigint"


def contexts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the order bytes before it and itself, as a number; each text's count."""
    pad = bytes([START]) * order
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, bytes([END]))), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    codes = np.zeros(len(data), np.uint64)
    for back in range(order, -1, -1):
        codes <<= np.uint64(8)
        codes[back:] |= data[: len(data) - back]
    starts = np.cumsum(sizes + order) - sizes
    keep = np.ones(len(data), bool)
    for i in range(order):
        keep[starts - 1 - i] = False
    return codes[keep], sizes


def reversed_contexts(codes: np.ndarray, order: int) -> np.ndarray:
    """The codes' contexts as numbers with the last byte first; order is at least 1."""
    return (codes >> np.uint64(8)).byteswap() >> np.uint64(64 - 8 * order)


def _pieces(texts: list[bytes]):
    """Ranges of texts of about _PIECE bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < _PIECE or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[starts], np.add.reduceat(n[order], starts) if len(starts) else n


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[starts], np.diff(np.append(starts, len(codes)))


def _count(train: DataFrame, text_col: str, order: int) -> DataFrame:
    """kind 0: words (by hash), kind 1: the longest contexts with their next byte, kind 2: texts."""

    def count(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(0))
        words, grams = [], []
        for a, b in _pieces(texts):
            words.append(_tally(word_hashes([w for t in texts[a:b] for w in t.lower().split()])))
            grams.append(_tally(contexts(texts[a:b], order)[0]))
        (w, wn), (g, gn) = _add_up(words), _add_up(grams)
        kind = np.concatenate([np.zeros(len(w), np.int32), np.ones(len(g), np.int32), [np.int32(2)]]).astype(np.int32)
        return {"kind": kind, "code": np.concatenate([w, g, np.zeros(1, np.uint64)]).view(np.int64), "n": np.concatenate([wn, gn, [len(texts)]]).astype(np.int64)}

    return map_batches(train.select(text_col), count, _COUNTS).groupBy("kind", "code").agg(F.sum("n").alias("n"))


class _HashTable:
    """Values of 64-bit keys, found in whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.at, self.keys, self.values = np.full(size, -1, np.int32), keys, values
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of those that want one slot, the last gets it
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, and whether each is there."""
        out, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        if not len(self.keys):
            return out, there
        slot, open_ = self._slot(keys), None
        while True:
            own = self.at[slot]
            asked = keys if open_ is None else keys[open_]
            hit = (own >= 0) & (self.keys[own] == asked)
            if open_ is None:
                out[hit], there[hit] = self.values[own[hit]], True
                open_ = np.flatnonzero(~hit & (own >= 0))
                slot = slot[open_] + 1
            else:
                out[open_[hit]], there[open_[hit]] = self.values[own[hit]], True
                more = ~hit & (own >= 0)
                open_, slot = open_[more], slot[more] + 1
            slot &= (1 << self.bits) - 1
            if not len(open_):
                return out, there


class ByteTrie:
    """The pretrained model, from the counts of the longest contexts with their next byte."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, shorter: list[tuple[np.ndarray, np.ndarray]] | None = None, within: tuple[int, int] | None = None):
        """shorter: codes and counts of each order below, where the longest contexts of a slice don't add up to them.
        within: the slice's range of reversed contexts."""
        self.order, self.within = order, within
        self.codes: list[np.ndarray] = [np.zeros(0)] * (order + 1)
        self.counts, self.ctx, self.total, self.kinds = list(self.codes), list(self.codes), list(self.codes), list(self.codes)
        by = np.argsort(codes)
        codes, counts = codes[by].astype(np.uint64), counts[by].astype(np.float64)
        for j in range(order, -1, -1):
            mask = np.uint64((1 << 8 * (j + 1)) - 1)
            codes, counts = _add_up([(codes & mask, counts)]) if shorter is None or j == order else shorter[j]
            heads = codes >> np.uint64(8)
            starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, int)
            self.codes[j], self.counts[j], self.ctx[j] = codes, counts, heads[starts]
            self.total[j] = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0)
            self.kinds[j] = np.diff(np.append(starts, len(codes))).astype(np.float64)
        #: Of a context's bytes, how often they follow the next shorter context: what is excluded there.
        self.excluded: list[np.ndarray] = [np.zeros(0)] * (order + 1)
        for j in range(1, order + 1):
            mask = np.uint64((1 << 8 * j) - 1)
            below = self.counts[j - 1][np.searchsorted(self.codes[j - 1], self.codes[j] & mask)]
            starts = np.searchsorted(self.codes[j] >> np.uint64(8), self.ctx[j])
            self.excluded[j] = np.add.reduceat(below, starts) if len(starts) else np.zeros(0)
        top = np.searchsorted(self.ctx[order], self.codes[order] >> np.uint64(8))
        self.known = _HashTable(self.codes[order], np.log10((self.counts[order] - 0.5) / self.total[order][top]))

    @staticmethod
    def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_, keys), max(0, len(sorted_) - 1))
        return at, (sorted_[at] == keys) if len(sorted_) else np.zeros(len(keys), bool)

    def _through_escapes(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the chance of each (context, byte), from the longest context down."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        gone_n, gone_kinds = np.zeros(len(codes)), np.zeros(len(codes))
        for j in range(self.order, -1, -1):
            code = codes[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            at, seen = self._find(self.ctx[j], code >> np.uint64(8))
            if not len(self.ctx[j]):
                continue
            kinds = np.where(seen, self.kinds[j][at] - gone_kinds[left], 0)
            room = np.where(seen, self.total[j][at] - gone_n[left], 0)
            entry, there = self._find(self.codes[j], code)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[left] += np.where(there, np.log10((self.counts[j][entry] - 0.5) / room), np.where(kinds > 0, np.log10(kinds / 2 / room), 0))
            gone_n[left] = np.where(seen, self.excluded[j][at] if j else 0, gone_n[left] * 0)
            gone_kinds[left] = np.where(seen, self.kinds[j][at], 0)
            left = left[~there]
        out[left] -= np.log10(256 - gone_kinds[left])
        return out

    def _each(self, codes: np.ndarray) -> np.ndarray:
        each, there = self.known.find(codes)
        if not there.all():
            rare, inverse = np.unique(codes[~there], return_inverse=True)
            each[~there] = self._through_escapes(rare)[inverse]
        return each

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's chance, its end included; of a slice, what the bytes whose context is in it add to that."""
        out = np.zeros(len(texts))
        for a, b in _pieces(texts):
            codes, sizes = contexts(texts[a:b], self.order)
            if self.within is None:
                each = self._each(codes)
            else:
                each, back = np.zeros(len(codes)), reversed_contexts(codes, self.order)
                own = (back >= np.uint64(self.within[0])) & (back < np.uint64(self.within[1]))
                each[own] = self._each(codes[own])
            out[a:b] = np.add.reduceat(each, np.cumsum(sizes) - sizes)
        return out


def adaptive_code_length(text: bytes, order: int = MAX_ORDER) -> float:
    """Bits that a model which starts empty and learns each byte after coding it needs for the text and its end."""
    trie: dict[bytes, dict[int, int]] = {}
    history, bits = bytes([START]) * order, 0.0
    for symbol in [*text, END]:
        excluded: set[int] = set()
        for j in range(order, -1, -1):
            seen = {s: n for s, n in trie.get(history[len(history) - j :], {}).items() if s not in excluded}
            if not seen:
                continue
            room = sum(seen.values())
            if symbol in seen:
                bits -= math.log2((seen[symbol] - 0.5) / room)
                break
            bits -= math.log2(len(seen) / 2 / room)
            excluded |= seen.keys()
        else:
            bits += math.log2(256 - len(excluded))
        for j in range(order + 1):
            node = trie.setdefault(history[len(history) - j :], {})
            node[symbol] = node.get(symbol, 0) + 1
        history = (history + bytes([symbol]))[1:] if order else b""
    return bits


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """code and n of a bounded table, in the order of the unsigned code."""
    t = df.select("code", "n").toArrow()
    codes, n = t.column("code").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def train_trie(counts: DataFrame, max_order: int, max_nodes: int) -> ByteTrie:
    """The trie of the highest order that keeps it within max_nodes longest contexts and next bytes.

    For callers that want one small trie; lm_score keeps its order and slices the trie.
    """
    order = max_order
    while order and counts.count() > max_nodes:
        order -= 1
        counts = materialize(counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("code")).agg(F.sum("n").alias("n")), "contexts")
    return ByteTrie(*_arrays(counts), order)


def _reversed(order: int) -> F.Column:
    """reversed_contexts of the column code."""
    byte = lambda i: F.shiftright("code", 8 * (i + 1)).bitwiseAND(F.lit(255))
    out = F.lit(0).cast("long")
    for i in range(order):
        out = out.bitwiseOR(F.shiftleft(byte(i), 8 * (order - 1 - i)))
    return out


def trie_ranges(longest: DataFrame, order: int, max_nodes: int) -> list[tuple[int, int]]:
    """Ranges of reversed contexts that cover them all and have max_nodes longest nodes at most, or are one context."""
    if longest.count() <= max_nodes or not order:
        return [(0, 1 << 8 * order)]
    nodes = longest.select(_reversed(order).alias("back"))
    depth = min(2, order)
    split = lambda df: {r.at: r.n for r in df.groupBy(F.shiftright("back", 8 * (order - depth)).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = {(at << 8 * (order - depth)): n for at, n in split(nodes).items()}
    while depth < order and (large := [lo for lo, n in cells.items() if n > max_nodes]):
        # Cells that are still too large are as wide as the last depth has left them.
        inside = F.shiftright("back", 8 * (order - depth)).isin([lo >> 8 * (order - depth) for lo in large])
        depth += 1
        for lo in large:
            del cells[lo]
        cells |= {(at << 8 * (order - depth)): n for at, n in split(nodes.where(inside)).items()}
    starts, held = [0], 0
    for lo, n in sorted(cells.items()):
        if held and held + n > max_nodes:
            starts, held = [*starts, lo], 0
        held += n
    return list(zip(starts, [*starts[1:], 1 << 8 * order], strict=True))


def trie_nodes(longest: DataFrame, order: int) -> DataFrame:
    """depth, code, n of the contexts of every order with their next byte, and low and high, their range of reversed contexts."""
    masks = F.array(*[F.lit((1 << 8 * (j + 1)) - 1 if j < 7 else -1).cast("long") for j in range(order + 1)])
    every = longest.select(F.posexplode(masks).alias("depth", "mask"), "code", "n")
    summed = every.groupBy("depth", F.col("code").bitwiseAND(F.col("mask")).alias("code")).agg(F.sum("n").alias("n"))
    low = _reversed(order)  # bytes that a shorter context lacks are 0
    return summed.withColumn("low", low).withColumn("high", F.col("low") + F.element_at(F.array(*[F.lit(1 << 8 * (order - j)).cast("long") for j in range(order + 1)]), F.col("depth") + 1))


def trie_slice(nodes: DataFrame, order: int, within: tuple[int, int]) -> ByteTrie:
    t = nodes.where((F.col("low") < within[1]) & (F.col("high") > within[0])).select("depth", "code", "n").toArrow()
    depth, codes, n = t.column("depth").to_numpy(), t.column("code").to_numpy().view(np.uint64), t.column("n").to_numpy()
    tables = [_add_up([(codes[depth == j], n[depth == j].astype(np.float64))]) for j in range(order + 1)]
    return ByteTrie(*tables[order], order, tables[:order], within)


def _words(texts: list[bytes], codes: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Each text's words, how many of them the slice has, and their log10(count + 1)."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(s) for s in split])
    hashes = word_hashes([w for s in split for w in s])
    at, there = ByteTrie._find(codes, hashes)
    each = np.zeros(len(hashes))
    each[there] = np.log10(counts[at[there]] + 1.0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    known, logs = np.concatenate([[0], np.cumsum(there)]), np.concatenate([[0], np.cumsum(each)])
    return sizes.tolist(), (known[ends[1:]] - known[ends[:-1]]).tolist(), (logs[ends[1:]] - logs[ends[:-1]]).tolist()


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2, max_order: int = MAX_ORDER, max_nodes: int = MAX_NODES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from rows whose crc32 of the id as text, mod `mod`, isn't `held`.
    """
    spark = df.sparkSession
    prepare(spark)
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == held, F.lit(True))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"))
    counted = materialize(_count(rows.where(~F.col("held_out")), "text", max_order), "lm-counts")
    words = counted.where("kind = 0")
    vocabulary, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = tokens + ends, vocabulary + (ends > 0)
    longest = counted.where("kind = 1").select("code", "n")
    ranges = trie_ranges(longest, max_order, max_nodes)
    slices = max(1, -(-vocabulary // slice_words))
    passes = max(slices, len(ranges))
    nodes = materialize(trie_nodes(longest, max_order), "contexts") if len(ranges) > 1 else None

    def trie_part(i: int) -> ByteTrie | None:
        if i >= len(ranges):
            return None
        return ByteTrie(*_arrays(longest), max_order) if nodes is None else trie_slice(nodes, max_order, ranges[i])

    def part(i: int):
        """Slice i of the vocabulary and of the trie; None where there are fewer. The driver holds one at a time."""
        own = words.where(F.pmod(F.col("code"), F.lit(slices)) == i) if slices > 1 else words
        sent = spark.sparkContext.broadcast(trie_part(i))
        return spark.sparkContext.broadcast(_arrays(own) if i < slices else None), sent

    (base, trie), end_log, less = part(0), math.log10(ends + 1), math.log10(tokens + 1 * (distinct + 1))

    def score(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(1))
        sizes, known, logs = [], [], []
        for a, b in _pieces(texts):
            s, k, g = _words(texts[a:b], *base.value)
            sizes, known, logs = sizes + s, known + k, logs + g
        n = np.array(sizes) + 1
        out = {
            "doc_id": batch.column(0).cast(pa.int64()),
            "held_out": batch.column(2),
            "n_tokens": n,
            "n_known": np.array(known) + (ends > 0),
            "train_tokens": np.full(len(n), tokens),
            "base_score": np.array(logs) + end_log - n * less,
            "score": trie.value.log10(texts),
        }
        return out | {"row": pa.array([hashlib.sha256(t).digest() if passes > 1 else None for t in texts], pa.binary())}

    scored = map_batches(rows, score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, row binary")
    if passes == 1:
        return scored.drop("row")
    scored, more = materialize(scored, "lm-scores"), None
    base.destroy()
    trie.destroy()
    for i in range(1, passes):
        own, tries = part(i)

        def add(batch: pa.RecordBatch, i=i, own=own, tries=tries) -> dict:
            texts = texts_of(batch.column(0))
            parts = [_words(texts[a:b], *own.value) for a, b in _pieces(texts)] if i < slices else []
            known, logs = (np.array([x for p in parts for x in p[at]], kind) if parts else np.zeros(len(texts), kind) for at, kind in ((1, np.int64), (2, np.float64)))
            chance = tries.value.log10(texts) if i < len(ranges) else np.zeros(len(texts))
            return {"row": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), "known": known, "logs": logs, "chance": chance}

        added = materialize(map_batches(rows.select("text"), add, "row binary, known bigint, logs double, chance double").withColumn("part", F.lit(i)), "lm-slice")
        own.destroy()
        tries.destroy()
        more = added if more is None else more.unionByName(added)
    # Equal texts have equal sums: one row of each slice is enough, and hot texts shrink before the shuffle.
    sums = more.groupBy("row", "part").agg(*[F.first(c).alias(c) for c in ("known", "logs", "chance")])
    sums = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "logs", "chance")]).select(F.unhex(F.hex("row")).alias("row"), "known", "logs", "chance")
    return scored.join(sums, "row").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), "train_tokens", (F.col("base_score") + F.col("logs")).alias("base_score"), (F.col("score") + F.col("chance")).alias("score"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
