import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palisade.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, tokenizer):
    docs = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs[r.doc_id, r.doc_tokens].append(r)
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.ids) for r in got)
    want = sorted(((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows), key=str)
    texts = defaultdict(list)
    for i, ids in want:
        texts[i].append(ids)
    for (i, n), mine in docs.items():
        whole = [x for x in texts[i] if len(x) == n]
        joined = b"".join(r.ids for r in sorted(mine, key=lambda r: r.start))
        assert len(joined) == 4 * n * len(whole)
        if len(whole) == 1:
            assert tuple(np.frombuffer(joined, "<u4").tolist()) == whole[0]
    assert sum(len(x) for _, x in want) == sum(r.length for r in got) and len(pieces) == len(got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and all(r.sequence_tokens == at for r in mine)
        assert mine[0].padded_to == (at if at in P.TIERS else 4096)


def test_round_trip(spark, awkward, empty):
    rows = [(100 + i, f"Some words, and number {i}: don't stop! " * (1 + i * i % 170)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = P.pack(df, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    check(rows, got, tokenizer)
    padding = sum({r.sequence_id: r.padded_to for r in got}.values()) - sum(r.length for r in got)
    assert padding <= 3 * 4096
    check([(r.doc_id, r.text) for r in awkward.collect()], P.pack(awkward, PATH).collect(), tokenizer)
    assert P.pack(empty, PATH).collect() == []


def test_words_apart_have_the_texts_ids():
    tokenizer, words = Tokenizer.from_file(PATH), P.encoder(PATH)
    texts = ["It's we'll DON'T x.y,z!! a.b. ... ?!", "\x01 mark \x01inside", "été ÉTÉ naïve ß İstanbul", "<|endoftext|> and<|startoftext|>x", "é combining ́ start", "snake_case 12345 3.14", "a b　c", ""]
    for t, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packer_fills_gaps_from_shorter_tiers():
    packer = P.Packer((4, 8, 16), waiting=4)
    for k, n in enumerate([13, 3, 2, 7, 40, 1, 1, 9]):
        packer.add(("d", k), bytes(4 * n))
    packer.finish()
    done = packer.drain()
    assert sum(len(x[2]) // 4 for _, w in done for x in w) == 76
    short = [size for size, w in done if sum(len(x[2]) // 4 for x in w) not in (4, 8, 16)]
    assert len(short) <= 1


def test_words_remembered_are_bounded_and_long_texts_sliced(monkeypatch):
    tokenizer, words = Tokenizer.from_file(PATH), P.WordEncoder(PATH)
    monkeypatch.setattr(P, "_REMEMBERED", 20_000)
    monkeypatch.setattr(P, "_SLICE", 100)
    texts = [" ".join(f"word{i * j}," for i in range(80)) for j in range(30)] + ["x" * 500 + " y", "\n" * 300, " " + "z" * 99]
    for t, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert words.held <= 20_000 and all(len(w) <= P._LONGEST for w in words.known)


def test_step_groups_are_full_over_the_whole_table(spark):
    rows = [(i, "some words here " * (5 + 37 * i % 900)) for i in range(300)]
    got = P.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), PATH, step_tokens=8192).collect()
    tokens = defaultdict(dict)
    for r in got:
        tokens[r.step_group][r.sequence_id] = r.padded_to
    tiers = defaultdict(list)
    for group, mine in tokens.items():
        tiers[group >> 48].append((group, sum(mine.values())))
    for mine in tiers.values():
        sizes = [n for _, n in sorted(mine)]
        assert all(n == 8192 for n in sizes[:-1]) and sizes[-1] <= 8192


def test_words_that_case_or_a_mark_could_change():
    import random

    encoder, r = P.WordEncoder(PATH), random.Random(5)
    parts = ["Hello", "H\u0331", "h\u0331", "I\u0307", "\u0130", "\u00c9COLE", "Stra\u00dfe", "A\u03a3", "\u03a3", "K\u212a", "it's", "IT'S", "x", "9", ".", ",", "!", ";", "$", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00a0", "\u0301", " ", "\n", "\x01"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for again in range(2):
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, (again, text)


def test_words_move_between_generations(monkeypatch):
    encoder = P.WordEncoder(PATH)
    texts = [f"common word{i}, and other{i}. Words".encode() for i in range(300)]
    want = [x for t in texts for x in encoder.encode([t])]
    monkeypatch.setattr(P, "_REMEMBERED", 4_000)
    small = P.WordEncoder(PATH)
    assert [x for t in texts for x in small.encode([t])] == want
    assert small.held <= 2_000 and len(small.known) + len(small.before) < 30
