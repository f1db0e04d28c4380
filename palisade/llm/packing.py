"""Hierarchical multi-length packing.

Every document is tokenised, ends with one end id, and is cut only where a window ends. Full windows of the
longest tier are filled straight away; what is left of a document goes to the shortest tier that holds it. A tier
opens a window with each piece that is more than half its size and fills the gap from the shorter tiers' waiting
pieces, longest first, cutting the last one to fit. Each task packs what it reads, so no ids are shuffled; the
pieces that wait are bounded in number. What is left at a task's end is laid end to end and cut into windows of the tiers'
sizes, so that a task leaves one short sequence at most. Sequences of one tier are numbered over the whole table, from
the counts that each task has made of each tier, and dealt in that order to step groups of the same number of tokens;
only a tier's last group may be smaller.

Nulls: a null or empty text is its end id alone. A null doc_id is carried through. Rows that repeat a doc_id, or are the
same altogether, are packed each. Very long texts are tokenised a slice at a time. An empty table gives no rows.
Ties: pieces of one length wait in the order they come.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize, prepare, table, texts_of

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group; pieces that may wait in a tier before they are packed by themselves.
STEP_TOKENS, WAITING = 65_536, 512
#: Bytes of words and ids that a worker remembers, its objects' own bytes included, and the longest word; only speed depends on them.
_REMEMBERED, _ENTRY, _LONGEST = 192 << 20, 200, 64
#: Bytes of text that are split into words at once.
_SLICE = 1 << 20
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, padded_to bigint, task int, tier int, nth bigint"
_UP_TO_027F = bytes(b for b in range(256) if b < 0xCA)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a tokenizer that never joins what white space parts,
    doesn't tell A-Z from a-z, and splits a letter from punctuation after it.

    Such a tokenizer's ids of a text are its words' ids one after another, and a word's are those of what comes
    before its last punctuation and of that. So each distinct core is tokenised once, many in one call with a mark
    of their own between them.
    """

    _MARK, _TOGETHER = "\x01", 100

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids of words: those met of late, and those met before that; what is met again moves from one to the other.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0
        self.mark = self.tokenizer.encode(self._MARK, add_special_tokens=False).ids
        self.letters, self.letter_mark = self._letters_only()

    def _letters_only(self) -> tuple:
        """The same tokenizer for words of ASCII letters alone: its merges, without the normalising and splitting that
        leave such words, in lower case, as they are. Where that doesn't hold, the whole tokenizer."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = self.tokenizer.model.end_of_word_suffix or ""
        mark = (self.tokenizer.id_to_token(self.mark[0]) or "").removesuffix(suffix) if len(self.mark) == 1 else ""
        short = Tokenizer(self.tokenizer.model)
        short.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        for probe in ("a", "the", "strawberries", "zqxjkvb", mark):
            if not probe or short.encode(probe).ids != self.tokenizer.encode(self._MARK if probe == mark else probe, add_special_tokens=False).ids:
                return self.tokenizer, self._MARK
        return short, mark

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids. Texts are read in slices that end at white space, whole words each."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, slices, size = [], [], 0
        for i, text in enumerate(texts):
            for part in _slices(text):
                if slices and size + len(part) > _SLICE:
                    self._encode(slices, owners, out)
                    owners, slices, size = [], [], 0
                owners.append(i)
                slices.append(part)
                size += len(part)
        self._encode(slices, owners, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode(self, slices: list[bytes], owners: list[int], out: list[list[bytes]]) -> None:
        split = [(t.lower() if _lowers_alike(t) else t).split() for t in slices]
        every = [w for words in split for w in words]
        found = list(map(self.known.get, every))
        missed = [i for i, x in enumerate(found) if x is None]
        if missed:
            fresh = self._ids_of({every[i] for i in missed})
            for i in missed:
                found[i] = fresh[every[i]]
        at = 0
        for i, words in zip(owners, split, strict=True):
            out[i].append(b"".join(found[at : at + len(words)]))
            at += len(words)
        if self.held > _REMEMBERED // 2:
            self.before, self.known, self.held = self.known, {}, 0

    def _ids_of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't in `known`, and of their cores; puts them there."""
        ids, parts, cores, fresh = {}, [], set(), []
        before = self.before.get
        for w in words:
            if (old := before(w)) is not None:
                ids[w] = old
            else:
                core, tail = _core(w)
                if core == w:
                    fresh.append(w)
                else:
                    parts.append((w, core, tail))
                    cores.add(core)
                    cores.add(tail)
        cores.difference_update(fresh, ids, (b"",))
        for x in cores:
            old = self.known.get(x)
            if old is None:
                old = before(x)
            if old is not None:
                ids[x] = old
            else:
                fresh.append(x)
        plain, other = [], []
        for x in fresh:
            (plain if x.isalpha() else other).append(x)
        for tokenizer, mark, each in ((self.letters, self.letter_mark, plain), (self.tokenizer, self._MARK, other)):
            for at in range(0, len(each), 50_000):
                ids.update(zip(each[at : at + 50_000], self._tokenise(tokenizer, mark, each[at : at + 50_000]), strict=True))
        for w, core, tail in parts:
            ids[w] = ids[core] + ids[tail] if tail else ids[core]
        kept = ids if max(map(len, ids)) <= _LONGEST else {w: x for w, x in ids.items() if len(w) <= _LONGEST}
        known = len(self.known)
        self.known |= kept
        self.held += (len(self.known) - known) * _ENTRY + sum(map(len, kept)) + sum(map(len, kept.values()))
        return ids

    def _tokenise(self, tokenizer, mark: str, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        alone = len(self.mark) != 1 or any(self._MARK in t for t in texts)
        size = 1 if alone else self._TOGETHER
        joined = [f" {mark} ".join(texts[i : i + size]) for i in range(0, len(texts), size)]
        found = [x.ids for x in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        if alone:
            return [np.array(ids, "<u4").tobytes() for ids in found]
        ids = np.array([i for x in found for i in (*x, self.mark[0])], "<u4")
        ends, data = np.flatnonzero(ids == self.mark[0]).tolist(), ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about _SLICE bytes; a part ends before white space, so that no word is cut."""
    at = 0
    while len(text) - at > _SLICE:
        cut = _SPACE.search(text, at + _SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _core(word: bytes) -> tuple[bytes, bytes]:
    """The word up to its last punctuation, in lower case if it is ASCII, and that punctuation; the whole word and nothing where
    the cut could matter."""
    core = word.rstrip(b".,;:!?")
    if b"<|" in word or not core[-1:].isalpha():
        return word, b""
    return core.lower() if word.isascii() else core, word[len(core) :]


def _lowers_alike(text: bytes) -> bool:
    """Whether the tokenizer reads the text and the text with A-Z in lower case alike: no character up to U+027F joins with
    another one when texts are composed, and marks of special tokens have a case."""
    return b"<|" not in text and not text.translate(None, _UP_TO_027F)


def encoder(path: str) -> WordEncoder:
    """One for each worker process, which keeps it between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Packs pieces (document row, start, ids as bytes) as they come. Lengths are in tokens, 4 bytes each."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING):
        self.tiers, self.waiting = tuple(sorted(tiers)), waiting
        self.pending: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held = 0
        self.done: list[tuple[int, list]] = []

    def add(self, row: tuple, ids: bytes) -> None:
        longest, n, at = self.tiers[-1], len(ids) // 4, 0
        while n - at >= longest:
            self.done.append((longest, [(row, at, ids[4 * at : 4 * (at + longest)])]))
            at += longest
        if n > at:
            self._wait(row, at, ids[4 * at :])
        while self.held > self.waiting:
            self._fill()

    def _wait(self, row: tuple, start: int, ids: bytes) -> None:
        tier = next(t for t in self.tiers if t * 4 >= len(ids))
        self.pending[tier].append((row, start, ids))
        self.held += 1

    def _take(self, most: int) -> tuple | None:
        """A waiting piece of the longest tier that has one no longer than `most`; else the last of the shortest tier."""
        for tier in reversed(self.tiers):
            queue = self.pending[tier]
            for _ in range(min(len(queue), 8)):
                if len(queue[0][2]) <= 4 * most:
                    self.held -= 1
                    return queue.popleft()
                queue.rotate(-1)
        for tier in self.tiers:
            if self.pending[tier]:
                self.held -= 1
                return self.pending[tier].popleft()
        return None

    def _fill(self) -> None:
        """One window of the longest tier that has a piece waiting, its gap filled from what else waits."""
        tier = next(t for t in reversed(self.tiers) if self.pending[t])
        window, room = [], tier
        while room:
            piece = self._take(room)
            if piece is None:
                break
            row, start, ids = piece
            head, rest = ids[: 4 * room], ids[4 * room :]
            window.append((row, start, head))
            room -= len(head) // 4
            if rest:
                self._wait(row, start + len(head) // 4, rest)
        if not room:
            self.done.append((tier, window))
            return
        # Nothing else waits: lay what there is out in shorter windows; the last may stay short.
        self._cut(window)

    def _cut(self, window: list) -> None:
        left = sum(len(x[2]) for x in window) // 4
        while left:
            size = next((t for t in reversed(self.tiers) if t <= left), left)
            out, room = [], size
            while room:
                row, start, ids = window.pop(0)
                out.append((row, start, ids[: 4 * room]))
                if len(ids) > 4 * room:
                    window.insert(0, (row, start + room, ids[4 * room :]))
                room -= len(out[-1][2]) // 4
            self.done.append((size, out))
            left -= size

    def finish(self) -> None:
        while self.held:
            self._fill()

    def drain(self) -> list[tuple[int, list]]:
        out, self.done = self.done, []
        return out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row for each piece. A sequence that fills a tier is padded no further; any other is padded to the longest.

    The ids themselves are a column only on request: what nobody reads isn't sent to the JVM.
    """
    spark = df.sparkSession
    prepare(spark)
    longest, end = max(tiers), end_id.to_bytes(4, "little")
    kinds = [0, *sorted(tiers)]
    schema = _SCHEMA + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(tokenizer_path), Packer(tiers)
        context = TaskContext.get()
        task, made, nth = context.partitionId() if context else 0, 0, [0] * len(kinds)
        base = task << 36

        def rows() -> pa.RecordBatch | None:
            nonlocal made
            cols: list[list] = [[] for _ in names]
            for size, window in packer.drain():
                length = sum(len(ids) for _, _, ids in window) // 4
                kind = kinds.index(length) if length in kinds else 0
                offset = 0
                for (doc, tokens), start, ids in window:
                    n = len(ids) // 4
                    for col, x in zip(cols, (doc, start, n, zlib.crc32(ids), tokens, base + made, offset, length, kinds[kind] or longest, task, kind, nth[kind], ids), strict=False):
                        col.append(x)
                    offset += n
                nth[kind] += 1
                made += 1
            if not cols[0]:
                return None
            types = [pa.int32() if x in ("task", "tier") else pa.binary() if x == "ids" else pa.int64() for x in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for at in range(0, len(docs), 200):
                for doc, ids in zip(docs[at : at + 200], words.encode(texts[at : at + 200]), strict=True):
                    packer.add((doc, len(ids) // 4 + 1), ids + end)
                if (out := rows()) is not None:
                    yield out
        packer.finish()
        if (out := rows()) is not None:
            yield out

    pieces = materialize(df.select(id_col, text_col).mapInArrow(run, schema), "pieces")
    # One row for each task and tier: what the tasks before it have made of the tier.
    counts = pieces.groupBy("task", "tier").agg((F.max("nth") + 1).alias("made"))
    before = counts.select("task", "tier", (F.sum("made").over(Window.partitionBy("tier").orderBy("task")) - F.col("made")).alias("before"))
    width = F.element_at(F.array(*(F.lit(max(1, step_tokens // (k or longest))) for k in kinds)), F.col("tier") + 1)
    group = F.call_function("shiftleft", F.col("tier").cast("long"), F.lit(48)) + F.floor((F.col("before") + F.col("nth")) / width)
    found = pieces.join(before, ["task", "tier"]).withColumn("step_group", group)
    return found.select(*names[:9], "step_group", *names[12:])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
