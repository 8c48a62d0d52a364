"""Hidden Markov scores and the pipeline."""

import collections
import itertools
import math
import re
import string

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fillgauge.llm import hmm
from fillgauge.session import settle

from .conftest import EDGE

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def small_model(rng, states=3, classes=4):
    def share(*shape):
        x = rng.random(shape) + 0.1
        return x / x.sum(-1, keepdims=True)

    return hmm.Model(share(states), share(states, states), share(states, classes))


def test_forward_sums_over_all_ways():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    sequences = [rng.integers(0, 4, n) for n in (1, 4, 2, 5, 3, 1)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    got = hmm.log10_forward(hmm.Batch(np.concatenate(sequences), ends), model)
    for seq, value in zip(sequences, got):
        total = 0.0
        for way in itertools.product(range(3), repeat=len(seq)):
            p = model.start[way[0]] * model.emit[way[0], seq[0]]
            for t in range(1, len(seq)):
                p *= model.move[way[t - 1], way[t]] * model.emit[way[t], seq[t]]
            total += p
        assert math.isclose(value, math.log10(total), rel_tol=1e-9)


def test_expected_counts_sum_over_all_ways():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    sequences = [rng.integers(0, 4, n) for n in (3, 1, 4)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    got = hmm.expected_counts(hmm.Batch(np.concatenate(sequences), ends), model)
    want = np.zeros_like(got)
    for seq in sequences:
        ways = {}
        for way in itertools.product(range(3), repeat=len(seq)):
            p = model.start[way[0]] * model.emit[way[0], seq[0]]
            for t in range(1, len(seq)):
                p *= model.move[way[t - 1], way[t]] * model.emit[way[t], seq[t]]
            ways[way] = p
        total = sum(ways.values())
        for way, p in ways.items():
            want[way[0], 0] += p / total
            for t, k in enumerate(way):
                want[k, 4 + seq[t]] += p / total
                if t:
                    want[way[t - 1], 1 + k] += p / total
    assert np.allclose(got, want, rtol=1e-5)


def test_stretches_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    model = small_model(rng)
    lengths = [1, 700, 33, 2, 250, 250]
    batch = hmm.Batch(rng.integers(0, 4, sum(lengths)), np.cumsum([0] + lengths))
    whole, likelihood = hmm._expect(batch, model)
    monkeypatch.setattr(hmm, "STRETCH_TOKENS", 64)
    parts, again = hmm._expect(batch, model)
    assert np.allclose(whole, parts, rtol=1e-5) and math.isclose(likelihood, again, rel_tol=1e-9)
    assert math.isclose(likelihood, hmm.log10_forward(batch, model).sum() * math.log(10), rel_tol=1e-9)


def test_training_ends_by_itself(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = hmm.prepare(docs, F.lit(True))
    assert 1 < hmm.train(corpus).rounds < hmm.ROUNDS
    assert hmm.train(corpus, tolerance=1.0).rounds == 2


def test_a_very_long_text_does_not_underflow():
    rng = np.random.default_rng(3)
    batch = hmm.Batch(rng.integers(0, 4, 200_000), np.array([0, 200_000]))
    value = hmm.log10_forward(batch, small_model(rng))[0]
    assert -200_000 < value < -50_000


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def test_base_scores_and_edge_cases(shipped, edge, empty):
    picked = F.col("doc_id") % 2 == 1
    rows = hmm.score_texts(edge, picked).collect()
    count = collections.Counter(t for i, text in EDGE if i is not None and i % 2 == 1 for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, text in EDGE:
        own = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        want.append((str(i), len(own), sum(count[t] > 0 for t in own), total, round(base, 4)))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert hmm.score_texts(empty, picked).count() == 0
    nothing = hmm.score_texts(edge, F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(math.isfinite(r["score"]) for r in nothing)


def test_training_raises_the_likelihood(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = hmm.prepare(docs, F.lit(True))

    def likelihood(rounds):
        model = hmm.train(corpus, rounds=rounds)
        return hmm.score(corpus, model, docs.schema["doc_id"].dataType).agg(F.sum("score")).first()[0]

    values = [likelihood(n) for n in (0, 1, 2, 4)]
    assert values == sorted(values)


def test_token_probabilities_add_up(shipped):
    """Over all known one-word texts and one for all unknown words, per class, with the end after it."""
    docs = shipped.createDataFrame([(1, "a b c d a b a"), (2, "b d e")], "doc_id long, text string")
    corpus = hmm.prepare(docs, F.lit(True))
    assert (corpus.tokens, corpus.distinct) == (12, 6)
    model = hmm.train(corpus, rounds=2)
    assert np.isclose(model.start.sum(), 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.emit.sum(1), 1)


def test_pipeline(shipped):
    folder = "/root/testdata/sf0.001"
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, settle(stage(shipped, kept, folder))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
            assert kept.join(before, "doc_id", "left_anti").count() == 0
    final = corpus_pipeline.run(shipped, folder)
    # which of two pieces of one length comes first may differ, where each document is cut does not
    cut = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, final.select(cut).collect())) == sorted(map(tuple, kept.select(cut).collect()))
    ids = {r["doc_id"] for r in final.collect()}
    labels = shipped.read.parquet(f"{folder}/labels.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in ids for i in bad) <= 0.1 * len(bad)
    # what was dropped was short, bad, or has a copy that stays
    assert len({texts[i].translate(LOWER) for i in ids}) == len(ids)
