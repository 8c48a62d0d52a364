"""Ranked search over bags of words."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fillgauge.llm import search as lexical
from fillgauge.llm.search import bag_classes, bags, search, terms_of

from .conftest import EDGE

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "Some words, and MORE words!"), (2, None), (3, "number after number naïve"), (1, "Some words, and MORE words!"),
         (None, "漢字 \U0001f600 follow"), (5, "nothing_like_this")]


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    total = sum(1 for _, c in held if c)
    size = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            n = sum(c.values())
            m = 25 + 75 * n * total // max(1, size)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [4 * 1024 * 1024, 60])
def test_against_brute_force(edge, shipped, item_bytes):
    items = shipped.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    got = search(edge, items, item_bytes=item_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGE, ITEMS)


def test_ties_and_hot_bags(shipped, monkeypatch):
    """One bag owns two thirds of the rows, many bags tie, and batches are tiny."""
    rng = np.random.default_rng(3)
    rows = [(i, "hot bag of words" if i % 3 else " ".join(rng.choice(["hot", "bag", "cold", "of", "x"], 3)))
            for i in rng.permutation(900).tolist()]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = shipped.createDataFrame([(1, "bag words"), (2, "cold hot hot"), (3, "x")], "item_id long, text string")
    monkeypatch.setattr(lexical, "SCORE_CELLS", 6)
    got = search(docs, items, top=12).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, [tuple(r) for r in items.collect()], 12)


def test_equal_bags_are_one_class(shipped):
    docs = shipped.createDataFrame([(4, "b a a"), (2, "A b A"), (9, "a a b"), (3, "a b b")], "doc_id long, text string")
    held = bags(docs, pa.array(["a", "b"]))
    classes = bag_classes(held, 4, 12, top=2).collect()
    assert sorted((tuple(r["tfs"]), tuple(r["members"])) for r in classes) == [((1, 2), (3,)), ((2, 1), (2, 4))]


def test_terms():
    texts = ["", "Ab-c9_ÄÖ x\x7fy\U0001f600z", " .. "]
    assert terms_of(pa.array(texts)).to_pylist() == [terms(t) for t in texts]


def test_empty_tables(edge, empty, shipped):
    items = shipped.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert search(empty, items).count() == 0 and search(edge, none).count() == 0
    assert search(edge, none).columns == ["item_id", "rank", "doc_id", "score"]
