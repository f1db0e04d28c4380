"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; what a line looks like, what its neighbours look like and the labels next to it decide.
The field is fitted on lines that carry their document's label, forward-backward gives each line's chance to be
good, and their mean, weighted by the lines' lengths, is calibrated to the documents' labels. Only the text is an
input.

Fitting takes a bounded sample: train_docs labelled rows in the order of a hash of their id, and of these as many
as fit into train_lines lines, whole documents each. Scoring reads every row and the whole text.

Nulls: a null or empty text is one empty line and gets a score like any other. A row whose id is null is scored
and counts as held out. Very long texts are read a block of lines at a time. Ties: documents of one hash are chosen in the
order of their ids. Labels other than 0 and 1 teach nothing; a row labelled twice teaches twice. Without
labels of both kinds every document gets the share of good ones as its score (0.5 without labels). An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import exp, log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import map_batches, materialize, prepare, table, texts_of

TRAIN_DOCS, TRAIN_LINES = 4_000, 200_000
#: Lines whose features are held at once.
BLOCK_LINES = 20_000
#: Bytes by kind: other, lower case, upper case, digit, common punctuation, symbol, white space.
_KINDS = np.zeros(256, np.uint8)
_KINDS[np.arange(ord("a"), ord("z") + 1)] = 1
_KINDS[0x80:] = 1
_KINDS[np.arange(ord("A"), ord("Z") + 1)] = 2
_KINDS[np.arange(ord("0"), ord("9") + 1)] = 3
_KINDS[np.frombuffer(b".,;:'\"?-()", np.uint8)] = 4
_KINDS[np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{|}~", np.uint8)] = 5
_KINDS[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 6
_OWN = 14
#: Own, previous and next line's features, the mean of the document, first and last line, bias.
WIDTH = 4 * _OWN + 3


def _own_features(texts: list[bytes], seen: set[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What lines look like themselves (lines, _OWN), each line's length + 1, and each document's number of lines. seen: the
    lines of the same document before a single text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    size = (ends - starts + 1).astype(np.float64)
    kinds = _KINDS[data]
    per = lambda mask: np.add.reduceat(mask.astype(np.float32), starts).astype(np.float64)
    count = [per(kinds == k) for k in range(1, 7)]
    lower, upper, digit, punct, symbol, space = count
    letters = lower + upper
    after = np.concatenate([[False], kinds[1:] == kinds[:-1]])
    same = np.concatenate([[False], data[1:] == data[:-1]])
    word_start = (kinds != 6) & ~(np.concatenate([[False], kinds[:-1] != 6]))
    words = np.maximum(per(word_start), 1)
    symbol_words = per((kinds == 5) & ~(after & (kinds == 5)))
    odd = per(same & (kinds >= 3) & (kinds <= 5))
    capital_words = per(word_start & (kinds == 2))
    upper_runs = per(after & (kinds == 2))
    own = np.empty((len(size), _OWN))
    own[:, 0] = np.log1p(size) / 5
    own[:, 1] = size <= 1
    own[:, 2] = upper / np.maximum(letters, 1)
    own[:, 3] = digit / size
    own[:, 4] = punct / words
    own[:, 5] = np.minimum(symbol_words / words, 2)
    own[:, 6] = symbol / size
    own[:, 7] = np.minimum(odd / words, 3)
    own[:, 8] = np.minimum((size - space) / words / 10, 3)
    own[:, 9] = capital_words / words
    own[:, 10] = upper_runs / np.maximum(letters, 1)
    last = data[np.maximum(ends - 1, starts)]
    own[:, 11] = (last == ord(".")) | (last == ord("?")) | (last == ord("!"))
    own[:, 12], own[:, 13] = _repeats(texts, seen)
    return own, size, lines


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, WIDTH), each line's length + 1, and each document's number of lines."""
    own, size, lines = _own_features(texts)
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    out = np.zeros((len(size), WIDTH))
    out[:, :_OWN] = own
    inner = np.ones(len(size), bool)
    inner[first] = False
    out[inner, _OWN : 2 * _OWN] = own[np.flatnonzero(inner) - 1]
    follows = np.roll(inner, -1)
    follows[-1] = False
    out[follows, 2 * _OWN : 3 * _OWN] = own[np.flatnonzero(follows) + 1]
    mean = np.add.reduceat(own * size[:, None], first) / np.add.reduceat(size, first)[:, None]
    out[:, 3 * _OWN : 4 * _OWN] = np.repeat(mean, lines, axis=0)
    out[first, 4 * _OWN] = 1
    out[~follows, 4 * _OWN + 1] = 1
    out[:, 4 * _OWN + 2] = 1
    return out, size, lines


def _repeats(texts: list[bytes], before: set[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line that isn't empty was in the document before; the share of its words that repeat the word before."""
    lines: list[bool] = []
    words: list[float] = []
    for t in texts:
        seen: set[bytes] = set() if before is None else before
        for x in t.split(b"\n"):
            lines.append(bool(x) and x in seen)
            seen.add(x)
            each = x.split()
            words.append(sum(map(eq, each, each[1:])) / len(each) if len(each) > 1 else 0.0)
    return np.array(lines), np.array(words)


class LineField:
    """Weights of a two-state chain: `weights` score state 1 against 0, `steps` score the pairs of neighbours."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, slope: float = 1.0, level: float = 0.0):
        self.weights, self.steps, self.slope, self.level = weights, steps, slope, level

    def _sweep(self, emit: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's chance of state 1, the chances of neighbours' states, and each document's log of the sum over paths."""
        order = np.argsort(-lines, kind="stable")
        first = np.concatenate([[0], np.cumsum(lines)[:-1]])[order]
        n, most = lines[order], int(lines.max())
        rest = np.searchsorted(-n, -np.arange(most), side="left")  # documents with more than t lines
        step = np.exp(self.steps)
        up = np.exp(np.clip(emit, -30, 30))
        scale = 1 + up
        one = np.stack([1 / scale, up / scale], 1)
        alpha, beta, norm = np.empty((len(emit), 2)), np.ones((len(emit), 2)), np.zeros(len(order))
        for t in range(most):
            at = first[: rest[t]] + t
            a = one[at] if t == 0 else (alpha[at - 1] @ step) * one[at]
            z = a.sum(1)
            alpha[at] = a / z[:, None]
            norm[: rest[t]] += np.log(z) + np.log(scale[at])
        for t in range(most - 2, -1, -1):
            at = first[: rest[t + 1]] + t
            b = (one[at + 1] * beta[at + 1]) @ step.T
            beta[at] = b / b.sum(1)[:, None]
        both = alpha * beta
        chance = both[:, 1] / both.sum(1)
        head = np.ones(len(emit), bool)
        head[first] = False
        at = np.flatnonzero(head)
        pair = alpha[at - 1][:, :, None] * step[None] * (one[at] * beta[at])[:, None, :]
        pair /= pair.sum((1, 2))[:, None, None]
        out = np.empty(len(order))
        out[order] = norm
        return chance, pair, out

    def chances(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return self._sweep(x @ self.weights, lines)[0]

    def good_share(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum(lines)[:-1]])
        return np.add.reduceat(self.chances(x, lines) * size, first) / np.add.reduceat(size, first)

    def score(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return self._calibrated(self.good_share(x, size, lines))

    def _calibrated(self, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(self.level + self.slope * np.log(share / (1 - share)))))

    def score_long(self, text: bytes, block: int = BLOCK_LINES) -> float:
        """The score of one text of many lines: features are made for a block of lines at a time, and only each line's
        evidence, length and messages are kept. Messages are log odds of state 1."""
        ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text))
        n = len(ends)
        cuts = [*range(0, n, block), n]

        def blocks():
            seen: set[bytes] = set()
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, size, _ = _own_features([text[0 if a == 0 else ends[a - 1] + 1 : ends[b - 1]]], seen)
                yield a, b, own, size

        size, emit, total = np.empty(n), np.empty(n), np.zeros(_OWN)
        for a, b, own, part in blocks():
            size[a:b] = part
            total += part @ own
        w = self.weights
        common = total / size.sum() @ w[3 * _OWN : 4 * _OWN] + w[4 * _OWN + 2]
        last = None
        for a, b, own, _ in blocks():
            emit[a:b] = own @ w[:_OWN] + common
            if last is not None:
                emit[a] += last @ w[_OWN : 2 * _OWN]
                emit[a - 1] += own[0] @ w[2 * _OWN : 3 * _OWN]
            emit[a + 1 : b] += own[:-1] @ w[_OWN : 2 * _OWN]
            emit[a : b - 1] += own[1:] @ w[2 * _OWN : 3 * _OWN]
            last = own[-1]
        emit[0] += w[4 * _OWN]
        emit[-1] += w[4 * _OWN + 1]
        emit = np.clip(emit, -30, 30)
        (s00, s01), (s10, s11) = np.exp(self.steps).tolist()
        odds = emit.copy()
        message = 0.0
        for t, e in enumerate(emit.tolist()):
            if t:
                message = log((s01 + r * s11) / (s00 + r * s10))
            odds[t] += message
            r = exp(e + message)
        message = 0.0
        for t in range(n - 2, -1, -1):
            r = exp(emit[t + 1] + message)
            message = log((s10 + r * s11) / (s00 + r * s01))
            odds[t] += message
        return float(self._calibrated(np.array([(size / (1 + np.exp(-odds))).sum() / size.sum()]))[0])

    @classmethod
    def fit(cls, x: np.ndarray, size: np.ndarray, lines: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.1, penalty: float = 1e-3) -> LineField:
        """Maximum conditional likelihood by gradient steps (Adam), then a calibration of documents' scores."""
        y = np.repeat(labels, lines).astype(np.float64)
        head = np.ones(len(y), bool)
        head[np.concatenate([[0], np.cumsum(lines)[:-1]])] = False
        self, n = cls(np.zeros(x.shape[1]), np.zeros((2, 2))), len(labels)
        # A line weighs less in a long document, so that each document counts alike.
        weight = np.repeat(1 / lines, lines)
        state = np.zeros((2, x.shape[1] + 4))
        pair_weight = weight[head]
        seen = np.zeros((2, 2))
        for a in (0, 1):
            seen[a, a] = (pair_weight * (y[head] == a)).sum()
        for t in range(1, rounds + 1):
            chance, pair, _ = self._sweep(x @ self.weights, lines)
            grad_w = x.T @ ((y - chance) * weight) / n - penalty * self.weights
            grad_s = (seen - (pair * pair_weight[:, None, None]).sum(0)) / n - 10 * penalty * self.steps
            grad = np.concatenate([grad_w, grad_s.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.999 * state[1] + 0.001 * grad**2
            move = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
            self.weights = self.weights + move[: x.shape[1]]
            self.steps = self.steps + move[x.shape[1] :].reshape(2, 2)
        self._calibrate(np.clip(self.good_share(x, size, lines), 1e-9, 1 - 1e-9), labels)
        return self

    def _calibrate(self, share: np.ndarray, labels: np.ndarray) -> None:
        """Newton steps of a logistic fit of the labels on the share's log odds."""
        u = np.stack([np.ones(len(share)), np.log(share / (1 - share))], 1)
        # Pulled towards the share itself by as much as a few documents weigh, so that a perfect fit stays finite.
        prior, w = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
            grad = u.T @ (labels - p) - 2.0 * (w - prior)
            step = np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + 2.0 * np.eye(2), grad)
            w = w + np.clip(step, -1, 1)
        self.level, self.slope = float(w[0]), float(max(w[1], 1e-3))


def _held_out(id_col: str, mod: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineField | float:
    """The field fitted on labelled rows whose crc32 of the id, mod `mod`, is not 0; or the share of good ones."""
    rows = labels.where(F.col("quality").isin(0, 1) & ~_held_out("doc_id", mod))
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id", "label").limit(train_docs)

    # A document of more lines than all of the sample may have can't be chosen: no features are made of it.
    def features(batch: pa.RecordBatch) -> dict | None:
        texts = texts_of(batch.column(1))
        keep = [i for i, t in enumerate(texts) if t.count(b"\n") < train_lines]
        if not keep:
            return None
        batch = batch.take(pa.array(keep))
        x, size, lines = line_features([texts[i] for i in keep])
        ends = np.cumsum(lines)
        cut = lambda a: [a[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends, lines, strict=True)]
        return {"id": batch.column(0).cast(pa.int64()), "label": batch.column(2), "lines": lines.astype(np.int64), "x": pa.array(cut(x), pa.binary()), "size": pa.array(cut(size), pa.binary())}

    joined = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
    found = map_batches(joined.select(id_col, text_col, "label"), features, "id bigint, label int, lines bigint, x binary, size binary")
    found = materialize(found, "line-features")
    # Of documents in the order of a hash, as many as fit into train_lines: what the driver holds stays bounded.
    order, chosen_ids, left = lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["label"]), set(), train_lines
    for r in sorted(found.select("id", "label", "lines").collect(), key=order):
        if r["lines"] <= left:
            chosen_ids.add(r["id"])
            left -= r["lines"]
    fit = sorted(found.where(F.col("id").isin(*chosen_ids)).collect() if chosen_ids else [], key=order)
    y = np.array([r["label"] for r in fit], np.float64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.frombuffer(b"".join(r["x"] for r in fit), np.float32).reshape(-1, WIDTH).astype(np.float64)
    size = np.frombuffer(b"".join(r["size"] for r in fit), np.float32).astype(np.float64)
    return LineField.fit(x, size, np.array([r["lines"] for r in fit]), y)


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in parts of at most 250 and BLOCK_LINES lines; a longer text is a part of its own."""
    part, left = [], BLOCK_LINES
    for t in texts:
        n = t.count(b"\n") + 1
        if part and (len(part) == 250 or n > left):
            yield part
            part, left = [], BLOCK_LINES
        part.append(t)
        left -= n
    if part:
        yield part


def score_quality(docs: DataFrame, model: LineField | float, extra: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns `extra` of docs, with score and predicted."""

    def score(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(0))
        if isinstance(model, float):
            scores = np.full(len(texts), model)
        else:
            scores = np.concatenate([np.array([model.score_long(p[0])]) if p[0].count(b"\n") >= BLOCK_LINES else model.score(*line_features(p)) for p in _parts(texts)])
        kept = {name: batch.column(i + 1) for i, name in enumerate(extra)}
        return kept | {"score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema.fields)
    return map_batches(docs.select(F.col(text_col).alias("_text"), *extra), score, f"{schema}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    prepare(docs.sparkSession)
    model = fit_quality(docs, labels, mod=mod)
    rows = docs.select("doc_id", "text", _held_out("doc_id", mod).alias("held_out"))
    return score_quality(rows, model, ["doc_id", "held_out"], threshold=threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
