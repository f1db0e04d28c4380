"""SentencePiece encoding by best path, streamed, and decoding.

A text is escaped (spaces become U+2581, one is put before it) and cut into the pieces whose scores sum to the most;
of equally good paths the one whose last piece is longest is taken, as the library's unigram encoder does. The
Viterbi pass keeps a window of the positions that a piece can still reach, as many as the longest piece has
characters. Whenever all paths that survive in the window go through one boundary, the ids before it are committed
and dropped, and scores start from 0 there, so memory doesn't grow with the text.

Where two neighbouring characters occur side by side in no piece, every path has a boundary between them. Those
boundaries are known before the pass: texts are cut there into words, and a new word once more before its last punctuation
where that is such a boundary. Each segment goes through the same pass, and the ids that it commits are remembered, so
that a segment that comes again isn't passed again.

A character that no piece covers becomes its UTF-8 bytes' pieces if the model has them, else the unknown piece; it
scores 10 less than the least piece. Decoding joins the pieces and bytes and undoes the escape, and gives back the
text. Nulls: a null or empty text has no ids. A null id is carried through, rows that repeat an id are encoded
each, an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import map_batches, prepare, table, texts_of

SPACE = "▁"
#: Longer segments are not remembered.
_REMEMBERED_CHARS = 48
#: Bytes of segments and ids that a worker remembers, its objects' own bytes included; characters cut at once. Only speed depends on them.
_REMEMBERED, _ENTRY, _SLICE = 240 << 20, 260, 1 << 20
_UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")
_NO_PIECE = (_NEVER, -1, 0)
_models: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces, scores and byte pieces of a SentencePiece file; piece types: 1 normal, 4 user-defined, 6 byte."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(processor.get_piece_size())
        self.unknown = processor.unk_id()
        special = lambda i: processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) or processor.is_byte(i)
        self.pieces = [processor.id_to_piece(i) for i in every]
        self.scores = [processor.get_score(i) for i in every]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in every if processor.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.ids = {self.pieces[i]: i for i in every if not special(i)}
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - _UNKNOWN_PENALTY
        joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._follow: dict[str, set[str]] = {}
        for a, b in joined:
            self._follow.setdefault(a, set()).add(b)
        # Every beginning of a piece, with its score, id and length if it is one itself: a look-up that fails ends the search.
        self.steps = {p[:i]: _NO_PIECE for p in self.ids for i in range(1, len(p))} | {p: (self.scores[i], i, len(p)) for p, i in self.ids.items()}
        self.coded = [i.to_bytes(4, "little") for i in every]
        # Ids of segments: those met of late, and those met before that; what is met again moves from one to the other.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    # Streamed pass -----------------------------------------------------------------------------------------------

    def stream(self, chars: str):
        """Yields (ids, characters committed) as paths converge. A position that no piece goes over is a boundary of
        all paths at once; beyond `longest` open positions the surviving paths are followed back to where they meet."""
        n, base, step, longest, uncovered = len(chars), 0, self.steps.get, self.longest, (self.unknown_score, -1, 1)
        best, last = [0.0], [uncovered]  # by position from the last boundary: score; score, id and length of the last piece
        for start in range(n):
            here = start - base
            so_far, size, end, at = best[here], len(best), start + 1, here + 1
            value = step(chars[start], _NO_PIECE)
            if value is _NO_PIECE:
                value = uncovered
            while value is not None:
                if value is not _NO_PIECE:
                    score = so_far + value[0]
                    if at >= size:
                        while at > size:
                            best.append(_NEVER)
                            last.append(_NO_PIECE)
                            size += 1
                        best.append(score)
                        last.append(value)
                        size += 1
                    elif score > best[at]:
                        best[at], last[at] = score, value
                if end == n:
                    break
                end += 1
                at += 1
                value = step(chars[start:end])
            if size == here + 2:
                yield self._ids(chars, base, here + 1, last), here + 1
                best, last, base = [0.0], [uncovered], start + 1
            elif here >= longest:
                # Which positions can a later piece still start at? Those after `start` that are reached.
                meet = self._meeting({e for e in range(here + 1, size) if best[e] > _NEVER}, last)
                if meet > 0:
                    yield self._ids(chars, base, meet, last), meet
                    best, last, base = [x - best[meet] for x in best[meet:]], last[meet:], base + meet

    @staticmethod
    def _meeting(live: set[int], last: list[tuple]) -> int:
        """The last position through which the paths to all live positions go."""
        open_ = set(live)
        while len(open_) > 1:
            far = max(open_)
            open_.discard(far)
            open_.add(far - last[far][2])
        return open_.pop()

    def _ids(self, chars: str, base: int, end: int, last: list[tuple]) -> list[int]:
        out: list[int] = []
        while end > 0:
            _, found, length = last[end]
            if found >= 0:
                out.append(found)
            else:
                out += reversed(self._spelled(chars[base + end - 1]))
            end -= length
        out.reverse()
        return out

    def _spelled(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    # Texts -------------------------------------------------------------------------------------------------------

    def splitter(self) -> re.Pattern:
        """Matches segments between boundaries that every path has: a run of U+2581 and what follows it up to the
        next one, if U+2581 follows nothing else inside a piece; line feeds alone, if no piece has one."""
        if any(SPACE in f for c, f in self._follow.items() if c != SPACE):
            return re.compile(r".+", re.S)
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        return re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes. Texts are cut into segments a slice at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for part in self._slices(text):
                if parts and size + len(part) > _SLICE:
                    self._encode(parts, owners, out)
                    owners, parts, size = [], [], 0
                owners.append(i)
                parts.append(part)
                size += len(part)
        self._encode(parts, owners, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _slices(self, text: str) -> Iterator[str]:
        """The escaped text in parts of about _SLICE characters that end before a space after something else, where the
        splitter always cuts; whole if it doesn't cut there."""
        at, lead = 0, SPACE if text else ""
        while len(text) - at > _SLICE and self._cuts:
            cut = text.find(" ", at + _SLICE)
            while cut > 0 and text[cut - 1] in " " + SPACE:
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield lead + text[at:cut].replace(" ", SPACE)
            at, lead = cut, ""
        yield lead + (text[at:] if at else text).replace(" ", SPACE)

    def _encode(self, parts: list[str], owners: list[int], out: list[list[bytes]]) -> None:
        split = [self._find(p) for p in parts]
        every = [s for segments in split for s in segments]
        found = list(map(self.known.get, every))
        missed = [i for i, x in enumerate(found) if x is None]
        fresh = {s: self._fresh(s) for s in {every[i] for i in missed}}
        for i in missed:
            found[i] = fresh[every[i]]
        at = 0
        for i, segments in zip(owners, split, strict=True):
            out[i].append(b"".join(found[at : at + len(segments)]))
            at += len(segments)
        if self.held > _REMEMBERED // 2:
            self.before, self.known, self.held = self.known, {}, 0

    def _fresh(self, segment: str) -> bytes:
        """Ids of a segment, from its part before the last punctuation and that, where every path has a boundary there."""
        found = self.known.get(segment) or self.before.get(segment)
        if found is None:
            head = segment.rstrip(punctuation)
            if 0 < len(head) < len(segment) and segment[len(head)] not in self._follow.get(head[-1], ()):
                found = self._remembered(head) + self._remembered(segment[len(head) :])
            else:
                found = self._streamed(segment)
        self._remember(segment, found)
        return found

    def _remembered(self, segment: str) -> bytes:
        found = self.known.get(segment)
        if found is None:
            found = self.before.get(segment)
            if found is None:
                found = self._streamed(segment)
            self._remember(segment, found)
        return found

    def _remember(self, segment: str, ids: bytes) -> None:
        if len(segment) <= _REMEMBERED_CHARS and segment not in self.known:
            self.known[segment] = ids
            self.held += _ENTRY + len(ids)

    def _streamed(self, segment: str) -> bytes:
        return b"".join([self.coded[i] for ids, _ in self.stream(segment) for i in ids])

    @property
    def _find(self) -> Callable[[str], list[str]]:
        if not hasattr(self, "_splits"):
            self._splits = self.splitter()
        return self._splits.findall

    @property
    def _cuts(self) -> bool:
        """Whether the splitter cuts before each run of spaces."""
        return len(self._find(f"a{SPACE}a")) == 2

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that has these ids."""
        text = b"".join([self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return text[1:] if text.startswith(b" ") else text

    @property
    def bytes_of(self) -> list[bytes]:
        if not hasattr(self, "_bytes_of"):
            self._bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        return self._bytes_of


def model(path: str) -> PieceModel:
    """One for each worker process, which keeps it between tasks."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit)."""
    prepare(df.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        pieces, texts, out = model(model_path), texts_of(batch.column(1)), []
        for at in range(0, len(texts), 200):
            out += pieces.encode([t.decode() for t in texts[at : at + 200]])
        return {"doc_id": batch.column(0).cast(pa.int64()), "ids": pa.array(out, pa.binary())}

    return map_batches(df.select(id_col, text_col), run, "doc_id bigint, ids binary")


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text, and what says which ids they came from."""
    prepare(df.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        pieces, ids = model(model_path), [x or b"" for x in batch.column(1).to_pylist()]
        texts = [pieces.decode(x) for x in ids]
        return {"doc_id": batch.column(0).cast(pa.int64()), "n_ids": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())}

    return map_batches(df.select("doc_id", "ids"), run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, text string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, and the sha256 of the text that decoding gives."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
