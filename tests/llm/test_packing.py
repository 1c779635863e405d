import os
import random
import zlib

import numpy as np
import pytest

from lodeframe.llm import packing

from .data import DOCS, corpus, frame


def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_round_trip(spark):
    """Pieces are the whole texts in order, and every sequence is gapless and within the limit."""
    rows, t = corpus(60), tokenizer()
    got = packing.pack(frame(spark, rows)).collect()
    want = sorted((str(i), tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, *_ in rows)
    pieces = sorted(got, key=lambda r: (str(r.doc_id), r.piece))
    docs = []
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
    for doc in sorted({str(r.doc_id) for r in pieces}):
        own = [r for r in pieces if str(r.doc_id) == doc]
        copies = sum(r.piece == 0 for r in own)
        now = own[::copies]
        assert [r.start for r in now] == list(np.cumsum([0, *[r.length for r in now]])[:-1])
        docs += [(doc, tuple(x for r in now for x in r.ids))] * copies
    assert sorted(docs) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= 1024


def naive(lengths, limit):
    """Best fit decreasing, a piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(limit - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng, limit = random.Random(seed), 64
    lengths = [min(limit, max(1, int(rng.expovariate(1 / rng.choice([5, 20, 40]))))) for _ in range(rng.choice([1, 30, 400]))]
    counts = {n: lengths.count(n) for n in lengths}
    used = {}
    for n, runs in packing.best_fit_decreasing(counts, limit).items():
        at = 0
        for rank, per, sequences, first, offset in runs:
            assert rank == at
            for k in range(per * sequences):
                used.setdefault(first + k // per, []).append((offset + n * (k % per), n))
            at += per * sequences
        assert at == counts[n]
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])
    assert sorted(limit - sum(n for _, n in p) for p in used.values()) == naive(lengths, limit)


def test_ids_of_any_text(spark):
    """Ids equal those of the tokenizer's own library, as it comes, for awkward and random texts of many alphabets."""
    import public_tokenizers

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    alphabets = ["ab '\ns", "".join(map(chr, range(1, 256))), "é ü\u00a0ñ½²ªµ'sll ve", "漢字かな ", "a1 \t\r\n", "'s'll've 're!?"]
    texts = ["it's  ''s we've 12³ ½x _a_\n\n  b\t\tc ", "".join(map(chr, range(1, 256))), "漢字 kana é", "", "   ", "a <|endoftext|> b", "x" * 50_000, " " * 999 + "y", "!" * 4_001, *(x or "" for _, x, *_ in corpus(30))]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in alphabets for _ in range(300)]
    plain = tokenizer()
    assert [x.tolist() for x in packing._encoder(path, as_text=False)(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    plain.encode_special_tokens = True
    assert [x.tolist() for x in packing._encoder(path)(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers_use_their_own_library():
    spec = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    assert packing._ranks(spec) is None and packing._ranks({"model": {"type": "Unigram"}}) is None


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    assert os.path.basename(packing.default_tokenizer()) == "byte_bpe_50k.json"


def test_special_tokens(spark):
    """A special token in a text has the id that the tokenizer gives by default, and its neighbours theirs."""
    t, texts = tokenizer(), ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> é", "漢 <|endoftext|>", "<|endoftext |> plain"]
    got = {r.doc_id: r.ids for r in packing.token_pieces(spark.createDataFrame([(k, x, "en", "s", 1) for k, x in enumerate(texts)], DOCS)).collect()}
    assert got == {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in enumerate(texts)} and got[0] == [64, 220, 50256, 275, 2]
