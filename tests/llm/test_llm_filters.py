"""URL rules, shards, languages and quality."""

import collections
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fillgauge.llm import language, quality, url_filter
from fillgauge.llm.sharding import shard_by_bytes
from fillgauge.llm.url_filter import judge_urls

from .conftest import EDGE


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_against_brute_force(shipped, monkeypatch):
    rng = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "com", "b.com", "xb.com", "c.b.com"]
    paths = ["/", "/e", "/en/", "/en/1", "/en/12", "/es/"]
    rules = {(h, p): rng.choice(["allow", "block"]) for h in hosts for p in rng.sample(paths, 3)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = ["http://" + rng.choice(["", "www.", "A.", "m.x."]) + rng.choice(hosts + ["net", "", ".", "com.", "borg"])
            + rng.choice(paths + ["", "/en/1?q=/es/", "/EN/1", "#/en/1", "/en/\U0010ffffz"]) for _ in range(400)]
    urls += [None, "", "no scheme/en/", "http://", "x://y://com/e", "http://COM/e"] + ["http://com/e"] * 50
    pages = shipped.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                                    "page_id int, url string, verdict string, key string").repartition(4)
    table = shipped.createDataFrame(rules, "verdict string, host string, path string")
    for size in (500_000, 40):
        monkeypatch.setattr(url_filter, "SWEEP_ROWS", size)
        monkeypatch.setitem(url_filter.sweep.__kwdefaults__, "task_rows", size)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, table).collect()}
        assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_urls_without_rules_or_pages(shipped):
    pages = shipped.createDataFrame([(1, "http://a.org/x")], "page_id int, url string")
    rules = shipped.createDataFrame([("block", None, "/"), (None, "org", "/")], "verdict string, host string, path string")
    row = judge_urls(pages, rules).first()
    assert (row["rule"], row["verdict"]) == (None, "allow")
    assert judge_urls(pages.limit(0), rules).count() == 0
    both = shipped.createDataFrame([("allow", "A.org", None), ("block", "a.org", "")], rules.schema)
    assert judge_urls(pages, both).first()["verdict"] == "block"


def shards_of(docs, n, **options):
    out = collections.defaultdict(list)
    for r in shard_by_bytes(docs, n, **options).collect():
        out[r["shard"]].append(r)
    for held in out.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return out


def test_shards_are_even_and_copies_lie_together(shipped):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 400) + str(i) for i in range(3000)] + ["one text"] * 1500
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = shards_of(docs, 8)
    sizes = [sum(r["size"] for r in out[i]) for i in range(8)]
    mean = sum(len(t) + 1 for t in texts) / 8
    assert sum(sizes) == 8 * mean and max(abs(s - mean) for s in sizes) <= 0.001 * mean + 405
    where = sorted({s for s, held in out.items() for r in held if r["text_crc32"] == zlib.crc32(b"one text")})
    assert where == list(range(where[0], where[-1] + 1))


def test_shards_of_one_hot_row(shipped):
    docs = shipped.createDataFrame([(7, "same")] * 1000, "doc_id long, text string").repartition(3)
    assert sorted(len(v) for v in shards_of(docs, 8).values()) == [125] * 8


def test_shards_of_edge_cases(edge, empty):
    out = shards_of(edge, 8)
    assert sum(map(len, out.values())) == len(EDGE)
    assert all(r["size"] >= 1 for held in out.values() for r in held)
    assert shard_by_bytes(empty, 8).count() == 0


def test_language_of_held_out_texts(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") > 100)
    model = language.fit(docs.filter(~language.held_out()))
    right = language.identify(docs, model).filter(language.held_out()).select(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_edge_cases(shipped, edge, empty):
    taught = shipped.createDataFrame([("a", "some words are here"), ("b", "der die das und"), (None, "x"), ("c", None)],
                                     "lang string, text string")
    model = language.fit(taught)
    assert model.languages == ["a", "b"]
    got = language.identify(edge, model)
    assert set(got.columns) == set(edge.columns)
    rows = got.collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("a", "b") and 0 <= r["score"] <= 1
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(taught.limit(0))
    assert {r["lang_pred"] for r in language.identify(edge, nothing).collect()} == {"und"}
    assert language.keep_known(edge, model).schema == edge.schema


def test_texts_of_no_learned_language_are_rejected(shipped):
    """Unlearned scripts and random letters go; the learned languages' texts stay."""
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    least = language.least_score(docs, model)
    assert least >= 3 / model.prototypes.shape[1] ** 0.5
    rng = np.random.default_rng(4)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "".join(map(chr, range(0x430, 0x450))),
               "georgian": "".join(map(chr, range(0x10D0, 0x10F0)))}
    rows = [(kind, " ".join("".join(rng.choice(list(x), rng.integers(2, 9))) for _ in range(150)))
            for kind, x in letters.items() for _ in range(100)]
    strange = language.keep_known(shipped.createDataFrame(rows, "kind string, text string"), model, least=least)
    assert all(r["count"] <= 5 for r in strange.groupBy("kind").count().collect())
    kept = language.keep_known(docs, model)
    assert kept.count() >= 0.98 * docs.filter("text rlike '[a-zA-Z]'").count()


def plain_profile(text, seed, dimensions):
    """The sum of the bound vectors of all letter groups, one by one."""
    points = [0]
    for ch in (text or "").lower():
        point = ord(ch) if unicodedata.category(ch)[0] == "L" else 0
        if point or points[-1]:
            points.append(point)
    points += [0] if points[-1] else []
    total = np.zeros(dimensions, dtype=np.int64)
    for a, b, c in zip(points, points[1:], points[2:]):
        if b:
            first, second, third = (language._signs(x, seed, dimensions).astype(np.int64) for x in (a, b, c))
            total += np.roll(first, 2) * np.roll(second, 1) * third
    return total


def test_language_against_plain_profiles(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = docs.collect()
    model = language.fit(docs)
    prototypes = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + plain_profile(r["text"], model.seed, language.DIMENSIONS)
    assert model.languages == sorted(prototypes)
    assert np.array_equal(model.prototypes, np.array([prototypes[x] for x in model.languages]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    for r in rows:
        profile = plain_profile(r["text"], model.seed, language.DIMENSIONS)
        if profile.any():
            near = {x: p @ profile / np.linalg.norm(p) / np.linalg.norm(profile) for x, p in prototypes.items()}
            best = max(sorted(near), key=near.get)
            assert got[r["doc_id"]][0] == best and abs(got[r["doc_id"]][1] - max(0.0, near[best])) < 1e-5


def test_language_does_not_depend_on_partitions(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = language.fit(docs.coalesce(1)), language.fit(docs.repartition(7))
    assert one.languages == many.languages and np.array_equal(one.prototypes, many.prototypes)


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(inside))


def test_measures_against_brute_force():
    rng = random.Random(2)
    texts = [t or "" for _, t in EDGE]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "\n", "# ", "\u00a0d "]) for _ in range(rng.randrange(90)))
              for _ in range(500)]
    got = quality.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(m[i]) for m in got[:5]) == brute_measures(text), text[:200]


def test_quality_against_labels(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = shipped.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").filter(~F.col("base_failed")).collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    right_good, right_bad = np.array([0.99, 0.97, 0.95, 0.98]), np.array([0.6, 0.5, 0.7, 0.4])
    right = rng.random((20000, 4)) < np.where(good[:, None], right_good, right_bad)
    votes = np.where(right == good[:, None], 1, 2)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.05
    assert np.allclose(model.right_if_good, right_good, atol=0.03)
    assert np.allclose(model.right_if_bad, right_bad, atol=0.08)


def test_quality_edge_cases(edge, empty):
    got = quality.judge(edge)
    rows = got.collect()
    assert len(rows) == len(EDGE) and not any(r["kept"] for r in rows if r["n_words"] < 20)
    assert sorted(r["n_words"] for r in rows) == sorted(brute_measures(t)[0] for _, t in EDGE)
    assert quality.judge(empty).count() == 0
    assert quality.keep_good(edge).schema == edge.schema


@pytest.mark.parametrize("votes", [np.zeros((0, 3), dtype=int), np.zeros((1, 3), dtype=int)])
def test_estimation_without_evidence(votes):
    model = quality.estimate(votes, np.ones(len(votes)))
    assert 0 < model.prior < 1 and len(model.right_if_good) == 3
