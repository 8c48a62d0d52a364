"""Byte-level BPE and packing."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fillgauge.llm import words
from fillgauge.llm.bpe import Ranks, decode, encode, match_words, read_ranks
from fillgauge.llm.packing import best_fit_plan, pack, pack_documents, token_pieces, windows

from .conftest import EDGE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a  b", "a   b", "  x", "x  ", "x \n", "\n\n x", " ", "   ", "a \n b", "a\n\n  b", "it's we'll 's 'S", "1 22  333",
       "\u00a0x\u2003 y", "a \u2003 b", "tab\t\ttwo \t", "\x1c \x1f x", "<|endoftext|> x", "e\u0301 \u1100\u1161"]


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()),
                                 special_tokens={})


def test_words_hold_whole_matches(encoder):
    import pyarrow as pa

    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(" \n\t\u00a0ab1.'s", k=rng.randrange(14))) for _ in range(3000)]
    cut = match_words(public_tokenizers.PATTERN)(pa.array(texts, pa.string())).to_pylist()
    for text, parts in zip(texts, cut):
        assert "".join(parts) == text
        assert [t for p in parts for t in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


def test_encode_and_decode(shipped, edge, encoder, monkeypatch):
    ranks = Ranks(shipped, RANKS, public_tokenizers.PATTERN)
    encoded = encode(edge, ranks)
    got = decode(encoded, ranks).collect()
    want = sorted((encoder.encode_ordinary(t or ""), (t or "").encode()) for _, t in EDGE)
    assert sorted((r["token_ids"], bytes(r["decoded"])) for r in got) == want
    assert all(bytes(r["ids_le"]) == np.array(r["token_ids"], "<u4").tobytes() for r in got)
    same = encode(edge, ranks, decoded=True).collect()
    assert sorted((r["token_ids"], bytes(r["decoded"])) for r in same) == want


def test_decode_of_unknown_and_null_ids(shipped):
    ranks = Ranks(shipped, RANKS, public_tokenizers.PATTERN)
    held = shipped.createDataFrame([([15, 99999999, -1, 15],), (None,), ([],)], "token_ids array<int>")
    got = decode(held, ranks).collect()
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in got] == [b"00", None, b""]


def test_empty_tables(shipped, empty):
    assert encode(empty, Ranks(shipped, RANKS, public_tokenizers.PATTERN)).count() == 0
    assert pack_documents(empty, WORDS).count() == 0


def test_small_blocks_give_the_same(shipped, edge, monkeypatch):
    ranks = Ranks(shipped, RANKS, public_tokenizers.PATTERN)
    want = sorted(r["token_ids"] for r in encode(edge, ranks).collect())
    monkeypatch.setattr(words, "STEP_BYTES", 64)
    monkeypatch.setattr(words, "BUCKET_BYTES", 2000)
    assert sorted(r["token_ids"] for r in encode(edge, ranks).collect()) == want


def naive(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


def placed(plan, counts):
    out = []
    for length, count in counts.items():
        own = plan[plan[:, 0] == length]
        for rank in range(count):
            run = own[own[:, 1] <= rank][-1]
            step, rest = divmod(rank - run[1], run[3])
            out.append((int(run[2] + step), int(run[4] + rest * length), length))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, 3) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    out = placed(best_fit_plan(counts, capacity), counts)
    used = {}
    for window, offset, length in out:
        assert used.get(window, 0) == offset
        used[window] = offset + length
    assert sorted(used) == list(range(len(used)))
    assert sorted(capacity - u for u in used.values()) == naive(lengths, capacity)


def test_plan_does_not_grow_with_the_pieces():
    counts = {n: 10**9 + 7 * n for n in range(1, 257)}
    assert len(best_fit_plan(counts, 256)) < 5000


def test_a_piece_too_long_is_an_error(shipped):
    with pytest.raises(ValueError):
        pack(shipped.createDataFrame([(9,)], "length int"), capacity=8)


def test_lengths_without_room_and_clashing_names(shipped):
    held = shipped.createDataFrame([(3, "x"), (None, "y"), (0, "z"), (-1, "w"), (5, "v"), (8, "u")],
                                   "length int, offset string")
    got = {r["length"]: (r["sequence_id"], r["offset"]) for r in pack(held, capacity=8).collect()}
    assert got == {8: (0, 0), 5: (1, 0), 3: (1, 5), None: (None, None), 0: (None, None), -1: (None, None)}


def test_packed_documents(shipped, edge):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    pieces = token_pieces(edge, WORDS, capacity=256)
    packed = pack(pieces, capacity=256, order=["doc_id", "start"]).cache()
    rows = packed.collect()
    whole = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 256 and r["offset"] + r["length"] <= 256
        assert r["start"] % 256 == 0
    # documents of equal id are told apart by their ids here
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in EDGE)
    for r in rows:
        whole.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(bytes(r["ids"]))
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    firsts = sorted(np.frombuffer(b, "<u4").tolist() for (_, _, s), bs in whole.items() if s == 0 for b in bs)
    assert firsts == sorted(w[:256] for w in want)
    filled = windows(packed, capacity=256).collect()
    assert all(len(r["ids"]) == 1024 for r in filled)
    assert sum(r["used"] for r in filled) == sum(map(len, want))
    assert packed.select("sequence_id").distinct().count() == packed.agg(F.max("sequence_id")).first()[0] + 1
    packed.unpersist()


def test_special_tokens_in_texts_are_encoded_as_the_library_does(shipped):
    from tokenizers import Tokenizer

    texts = ["end of text <|endoftext|> here", "a<|endoftext|>b", "<|startoftext|><|endoftext|>.", "x <|ENDOFTEXT|>, y",
             "<|endoftext|>", "end.<|endoftext|>,End", "\n<|startoftext|> \t<|endoftext|>\n", "<| endoftext |>"]
    tokenizer = Tokenizer.from_file(WORDS)
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_pieces(docs, WORDS).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
