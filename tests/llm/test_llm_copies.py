"""Exact copies, near copies and web pages."""

import collections
import hashlib
import random
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fillgauge.llm import near_dup
from fillgauge.llm.exact_dedup import ContentTable, drop_copies, exact_groups
from fillgauge.llm.html_text import extract, label, main_text, parse
from fillgauge.llm.near_dup import drop_near_copies, near_classes, similar

from .conftest import EDGE

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [32 * 1024 * 1024, 40])
def test_exact_groups(edge, bucket_bytes):
    rows = exact_groups(edge, bucket_bytes=bucket_bytes).collect()
    assert sorted([tuple(r[:3]) + (r["text_sha256"],) for r in rows], key=str) == brute_groups(EDGE)
    kept = collections.Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_a_hot_text_and_many_small_buckets(shipped):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_groups(docs, bucket_bytes=200)
    assert sorted([tuple(r[:3]) + (r["text_sha256"],) for r in got.collect()], key=str) == brute_groups(rows)


def test_survivors_keep_their_columns(edge, empty):
    kept = drop_copies(edge)
    assert kept.schema == edge.schema
    want = {keep for _, keep, _, _ in brute_groups(EDGE)}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len({r[3] for r in brute_groups(EDGE)})
    # of copies that differ in case the row with the largest id stays as it was
    assert next(r["text"] for r in rows if r["doc_id"] == 9).startswith("SOME")
    assert drop_copies(empty).count() == 0 and exact_groups(empty).count() == 0


def test_the_table_compares_contents():
    table, digest = ContentTable(), b"\0" * 32  # all digests alike: only contents tell
    numbers = [table.place(str(i % 900).encode(), digest) for i in range(3000)]
    assert numbers == [i % 900 for i in range(3000)]


def words_of(rng, n):
    return [rng.choice(string.ascii_lowercase) + str(rng.randrange(3000)) for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[at] = "new" + str(rng.randrange(10**6))
        elif kind < 0.8:
            del words[at]
        else:
            words.insert(at, "put" + str(rng.randrange(10**6)))
    return words


def ordered_similarity(a, b):
    a = [tuple(a[i:i + 5]) for i in range(max(1, len(a) - 4))] if a else []
    b = [tuple(b[i:i + 5]) for i in range(max(1, len(b) - 4))] if b else []
    numbers = {x: i for i, x in enumerate(dict.fromkeys(a + b))}
    other = np.array([numbers[x] for x in b], dtype=int)
    row = np.zeros(len(b) + 1, dtype=int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == numbers[x])))
    both = len(a) + len(b)
    return row[-1] / max(1, both - row[-1])


def test_banded_alignment_is_exact():
    rng = random.Random(4)
    numbers = {}
    for _ in range(300):
        base = words_of(rng, rng.randint(1, 60)) if rng.random() < 0.7 else [rng.choice("ab") for _ in range(30)]
        other = edited(rng, base, rng.randint(0, 3)) if rng.random() < 0.8 else words_of(rng, 20)

        def shingled(words):
            out = [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
            return np.array([numbers.setdefault(s, len(numbers)) for s in out], dtype=np.uint64)

        want = ordered_similarity(base, other) >= 0.8 - 1e-12 if base and other else False
        assert similar(shingled(base), shingled(other)) == want


def corpus(rng):
    """Texts with a large family of near copies, a passage that many share, copies and chains."""
    texts = [words_of(rng, rng.randint(30, 90)) for _ in range(150)]
    base = words_of(rng, 150)
    texts += [base] + [edited(rng, base, rng.randint(1, 5)) for _ in range(120)]
    passage = words_of(rng, 60)
    texts += [words_of(rng, 40) + passage + words_of(rng, 40) for _ in range(80)]
    step = words_of(rng, 120)
    for _ in range(6):
        texts.append(step)
        step = edited(rng, step, 2)
    texts += [texts[3]] * 40 + [words_of(rng, 3), words_of(rng, 3)] + [["one", "two"]] * 2
    return [" ".join(t) for t in texts]


def test_near_classes_against_brute_force(shipped, monkeypatch):
    texts = corpus(random.Random(9))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    split = [t.split() for t in texts]
    sets = [collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in split]
    links = []
    for i in range(len(texts)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            if common >= 0.8 / 1.8 * (sets[i].total() + sets[j].total()):  # else no alignment can reach it
                if split[i] == split[j] or ordered_similarity(split[i], split[j]) >= 0.8:
                    links.append((i, j))
                    parent[find(i)] = find(j)
    want = collections.defaultdict(set)
    for i in range(len(texts)):
        want[find(i)].add(i)
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for few in (near_dup.FEW_CLASSES, 3):  # with 3, buckets are dealt out anew
        monkeypatch.setattr(near_dup, "FEW_CLASSES", few)
        rows = near_classes(docs).collect()
        got = collections.defaultdict(set)
        for r in rows:
            got[r["class"]].add(r["id"])
            assert r["class_id"] <= r["id"]
        of = {i: c for c, ids in got.items() for i in ids}
        missed = [(i, j) for i, j in links if of[i] != of[j]]
        assert len(missed) <= 0.01 * len(links)
        assert all(any(ids <= w for w in want.values()) for ids in got.values())
        assert all(r["class_size"] == len(got[r["class"]]) for r in rows)
    stay = drop_near_copies(docs).collect()
    assert len(stay) == len(got) and {r["doc_id"] for r in stay} == {min(ids) for ids in got.values()}


def test_no_link_of_a_shared_sketch_is_missed(shipped, monkeypatch):
    rng = random.Random(12)
    base = words_of(rng, 150)
    texts = [base] + [edited(rng, base, rng.randint(1, 5)) for _ in range(150)]
    # the rim of the family: too far from its middle, each near to some other on the rim
    for _ in range(60):
        rim = edited(rng, base, rng.randint(5, 9))
        texts += [rim, edited(rng, rim, rng.randint(1, 3)), edited(rng, rim, rng.randint(1, 3))]
    passage = words_of(rng, 100)
    for _ in range(60):
        own = passage + words_of(rng, 30)
        texts += [own, edited(rng, own, 3)]
    rng.shuffle(texts)
    hashes, ends = near_dup.shingles(*near_dup.word_numbers(pa.array([" ".join(t) for t in texts])))
    keys = near_dup.sketches(hashes, ends)
    own = [hashes[a:b] for a, b in zip(ends[:-1], ends[1:])]
    links = [(i, j) for i in range(len(texts)) for j in range(i)
             if (keys[i] == keys[j]).any() and similar(own[i], own[j])]
    docs = shipped.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for few, slice_rows in ((near_dup.FEW_CLASSES, 512), (3, 7)):
        monkeypatch.setattr(near_dup, "FEW_CLASSES", few)
        monkeypatch.setattr(near_dup, "SLICE_ROWS", slice_rows, raising=False)
        of = {r["id"]: r["class"] for r in near_classes(docs.repartition(4)).collect()}
        assert [(i, j) for i, j in links if of[i] != of[j]] == []


def test_near_classes_edge_cases(shipped, edge, empty):
    rows = near_classes(edge).collect()
    assert len(rows) == len(EDGE)
    sizes = collections.Counter(r["class"] for r in rows)
    assert sorted(sizes.values()) == [1] * 7 + [2, 3]  # the repeated row; the two copies and the one in capitals
    stored = shipped.createDataFrame(edge.collect(), edge.schema)
    kept = drop_near_copies(stored)
    assert kept.schema == edge.schema and kept.count() == len(sizes)
    assert near_classes(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_long_chains_are_one_class(shipped):
    links = shipped.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["place"]: r["label"] for r in near_dup.classes(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert near_dup.classes(links.limit(0)).count() == 0


def text_of(page, template=()):
    root = parse(page)
    label(root)
    return main_text(root, set(template))


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<br>c", "a\nb c"),
    ("<body><nav>x</nav><div class='ad box'>y</div><p>a &amp; b&nbsp;&#233;</p><footer>z</footer>", "a & b é"),
    ("<header>x</header><article><header><h1>T</h1></header><p>a</p></article><p>out</p>", "T\na"),
    ("<article><p>a <b>bold</b>ly</p><div class=comments><p>no</p></div><form>f</form></article>", "a boldly"),
    ("<script>var t='</p>';</script><style>p{}</style><p>a<!-- c --><p>b", "a\nb"),
    ("<article><p>cut off <a href='x", "cut off"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<article><p>a</p><p><b>x<br><p>y</article><aside>s</aside>", "a\nx\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>", "a\nb\nc\nd\ne\nf"),
    ("<p title='a>b'>x</p><p hidden>h</p><p style='display: none'>h</p>", "x"),
    ("</p></div><title>t</title>x", "x"), ("<p>" * 5000 + "deep", "deep"), ("<div>" * 5000 + "deep", "deep"),
    ("<p>say &lt;b&gt;\n\t twice</p>", "say <b> twice")])
def test_main_text(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page, want", [
    ("<div class='content no-sidebar'><p>a</p></div>", "a"), ("<div id='page-with-banner'><p>a</p></div>", "a"),
    ("<article class='post has-comments'><p>a</p></article>", "a"),
    ("<article class='post comments'><p>a</p><div class='x comments'>no</div></article>", "a"),
    ("<div class=sidebar><div><article><p>a</p></article></div></div><div class='sidebar left'>no</div>", "a"),
    ("<div class=sidebar><aside><article>no</article></aside>no</div><p>a</p>", "a")])
def test_names_drop_no_article(page, want):
    assert text_of(page) == want


def test_templates_go_and_articles_stay(shipped):
    def page(i, text, menu="<div class=x><a>Home</a> <a>News</a></div>"):
        return (i, f"http://a.org/{i}", f"<body>{menu}<div id=c><h1>Head {i}</h1><p>{text}</p></div><p>All rights {i % 2}</p>")

    rows = [page(i, f"words {i}") for i in range(20)]
    # an article copied on many pages stays; a page of another host keeps what only looks like the menu
    rows += [(100 + i, f"http://a.org/c{i}", f"<body><div class=x>m{i}</div><article><div><p>same</p><p>text</p></div>"
              "</article>") for i in range(12)]
    rows += [(200, "http://b.org/1", rows[0][2]), (201, None, rows[0][2]), (202, "http://a.org/e", None),
             (203, "http://a.org/f", "")]
    pages = shipped.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert [got[i] for i in range(20)] == [f"Head {i}\nwords {i}" for i in range(20)]
    assert {got[100 + i] for i in range(12)} == {"same\ntext"}
    assert got[200] == got[201] == "Home News\nHead 0\nwords 0\nAll rights 0"
    assert got[202] == got[203] == ""


def test_template_of_a_large_host_goes(shipped):
    rows = [(i, f"http://big.org/{i}", f"<body><div id=c><p>words {i}</p>{'<div>Old notice</div>' if i < 6 else ''}</div>")
            for i in range(2000)]
    pages = shipped.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert got == {i: f"words {i}" for i in range(2000)}


def test_pages_edge_cases(shipped):
    pages = shipped.createDataFrame([(1, "http://a/", "<p>x", "old", 5)] * 3,
                                    "page_id int, url string, html string, host string, n_chars int")
    got = extract(pages)
    assert [tuple(r) for r in got.collect()] == [(1, "http://a/", "<p>x", "old", "x", 1)] * 3
    assert extract(pages.limit(0)).count() == 0
    long = shipped.createDataFrame([(1, "http://a/", "<p>word</p>" * 200_000)], "page_id int, url string, html string")
    assert extract(long).select(F.max("n_chars")).first()[0] == 5 * 200_000 - 1
