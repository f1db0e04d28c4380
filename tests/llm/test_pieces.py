import random

import numpy as np
import public_tokenizers

from palisade.llm import pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(model, chars):
    """The best path by trying every last piece; of equal ones the longest last piece."""
    best = [(0.0, [])]
    for end in range(1, len(chars) + 1):
        options = []
        for start in range(max(0, end - model.longest), end):
            found = model.ids.get(chars[start:end])
            if found is not None:
                options.append((best[start][0] + model.scores[found], -start, best[start][1] + [found]))
            elif end - start == 1:
                options.append((best[start][0] + model.unknown_score, -start, best[start][1] + [model.byte_ids[b] for b in chars[start:end].encode()]))
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


TEXTS = ["Hello world, this is a  test\nof theé thing 漢字 x", " ", "a", "\n\n a  b", "trail  ", "tab\tx", "😀 emoji", "<s> x </s>", "x" * 300, "abcdefghij" * 12]


def test_best_path_and_round_trip():
    model, r = S.model(PATH), random.Random(1)
    texts = TEXTS + ["".join(r.choice("abcde the ing\nÉ漢.#$") for _ in range(r.randint(1, 60))) for _ in range(60)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        chars = S.SPACE + t.replace(" ", S.SPACE)
        assert np.frombuffer(ids, "<u4").tolist() == brute(model, chars), t
        assert [i for part, _ in model.stream(chars) for i in part] == brute(model, chars), t
        assert model.decode(ids) == t.encode()


def test_commits_before_the_end():
    model = S.model(PATH)
    parts = list(model.stream(S.SPACE + S.SPACE.join(["stream", "of", "words"] * 200)))
    assert len(parts) > 100 and max(n for _, n in parts) < 60


def test_words_that_the_library_splits_alike():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # best path over the same pieces
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), S.model(PATH)
    words = "convert streaming tokens quickly around mountains river analysis building".split()
    for w, ids in zip(words, model.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.nbest_encode_as_ids(w, 1)[0]


def test_awkward(spark, awkward, empty):
    got = S.decode(S.encode(awkward, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=str)
    assert S.encode(empty, PATH).collect() == []


def test_slices_and_bounded_memory(monkeypatch):
    import public_tokenizers

    from palisade.llm import pieces as P

    whole = P.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    small = P.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["several  words and   runs of spaces " * 20, " lead", "trail ", "x" * 300, "", "a▁b ▁ c " * 30, "line\nfeeds\n\n and é 日本 " * 10]
    want = whole.encode(texts)
    monkeypatch.setattr(P, "_SLICE", 40)
    monkeypatch.setattr(P, "_REMEMBERED", 5_000)
    assert small.encode(texts) == want and small.held <= 5_000
    assert [small.decode(x).decode() for x in small.encode(texts)][:5] == texts[:5]
