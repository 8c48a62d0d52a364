"""Repeated strings of bytes against a plain dictionary of all strings."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm import repeats
from fillgauge.llm.repeats import LENGTH, covered, op12_repeats, places, remove_repeats, runs_of

from .conftest import EDGE


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[:len(t)]])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(frame):
    return sorted(((r["doc_id"], len(r["text"]), sum(e - s for s, e in zip(r["starts"], r["ends"])), len(r["starts"]),
                    hashlib.sha256(r["kept"]).hexdigest()) for r in frame.collect()), key=str)


def passages(rng, n, length):
    """Texts that share passages of about ``length`` characters, with other words and edits around them."""
    def words(k, letters="abcde"):
        return "".join(rng.choice(letters) for _ in range(k))

    shared = [words(rng.randrange(max(1, length - 4), 3 * length)) for _ in range(6)] + ["ab" * length, "z" * 2 * length, "é" * length]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            s = list(rng.choice(shared))
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.choice("xyab")
            parts += [words(rng.randrange(12)), "".join(s)]
        out.append((i, "".join(parts) + words(rng.randrange(8))))
    return out + out[:9]


@pytest.mark.parametrize(("length", "block_bytes", "bucket_bytes"), [(20, 1 << 24, 1 << 26), (33, 2000, 3000), (1, 500, 10**6)])
def test_against_brute_force(shipped, length, block_bytes, bucket_bytes, tmp_path):
    rng = random.Random(length)
    rows = passages(rng, 150, length)
    shipped.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = shipped.read.parquet(f"{tmp_path}/docs")
    spans = covered(docs, length=length, block_bytes=block_bytes, bucket_bytes=bucket_bytes)
    got = []
    for r in spans.collect():
        kept = repeats._kept(bytes(r["text"]), np.array(r["starts"]), np.array(r["ends"]))
        got.append((r["doc_id"], len(r["text"]), sum(e - s for s, e in zip(r["starts"], r["ends"])), len(r["starts"]),
                    hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=str) == brute(rows, length)


def test_edge_rows(edge, empty, tmp_path):
    edge.write.parquet(f"{tmp_path}/edge")
    docs = edge.sparkSession.read.parquet(f"{tmp_path}/edge")
    for length in (20, LENGTH):
        assert digest(remove_repeats(docs, length=length)) == brute(EDGE, length)
    assert remove_repeats(empty).count() == 0


def test_query(shipped, tmp_path):
    rng = random.Random(8)
    rows = passages(rng, 60, LENGTH)
    shipped.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op12_repeats(shipped, str(tmp_path)).collect()), key=str) == brute(rows, LENGTH)


@pytest.mark.parametrize("length", [1, 2, 7, 200])
def test_anchors_depend_on_the_string_alone(length, monkeypatch):
    """Runs cover every string once, and equal strings have their anchor at the same place, whatever the pieces."""
    monkeypatch.setattr(repeats, "PIECE_BYTES", 700)
    rng = random.Random(2)
    texts = [t.encode() for _, t in passages(rng, 40, max(8, length))]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    raw = b"".join(texts)
    anchor, start, stop = runs_of(raw, offsets, length)
    at: dict[bytes, int] = {}
    seen = []
    for a, p, q in zip(anchor.tolist(), start.tolist(), stop.tolist()):
        for s in range(p, q + 1):
            seen.append(s)
            assert 0 <= a - s < places(length)
            assert at.setdefault(raw[s:s + length], a - s) == a - s
    assert seen == [o + p for o, t in zip(offsets.tolist(), texts) for p in range(len(t) - length + 1)]


def test_hot_passage(shipped, tmp_path):
    """A passage in every text, each time between other words, so that its ends stay open everywhere."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, f"{rng.random()}{passage}{rng.random()}") for i in range(400)]
    shipped.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    docs = shipped.read.parquet(f"{tmp_path}/docs").withColumn("kept", F.lit("x"))
    assert digest(remove_repeats(docs, length=60)) == brute(rows, 60)


def test_rounds_in_jobs_and_in_a_task_agree(shipped):
    rng = random.Random(6)
    length = 20
    n = places(length)
    contexts = []
    for i in range(300):
        first = rng.randrange(n)
        last = rng.randrange(first, n)
        left, right = ("".join(rng.choice("ab") for _ in range(last)), "".join(rng.choice("ab") for _ in range(n - 1 - first)))
        core = rng.choice("xyz") * (length - n + 1)
        contexts.append((i, first, last, rng.random() < 0.1, bytearray((left + core + right).encode())))
    frame = shipped.createDataFrame(contexts, repeats._CONTEXT)

    def places_of(rows):
        return sorted({(c, p) for c, a, b in rows for p in range(a, b + 1)})

    inside = places_of(map(tuple, repeats.refine(frame, length).collect()))
    assert inside == places_of(map(tuple, repeats.refine(frame, length, large_bucket=20).collect()))
    seen = collections.Counter()
    strings = {}
    for i, first, last, several, context in contexts:
        for p in range(first, last + 1):
            strings[i, p] = (p, bytes(context[last - p:last - p + length]))
            seen[strings[i, p]] += 2 if several else 1
    assert inside == sorted(k for k, s in strings.items() if seen[s] > 1)


def test_blocks_travel_in_small_rows(shipped, tmp_path, monkeypatch):
    """No row holds a whole block, and the parts of a block give it back whatever their order."""
    monkeypatch.setattr(repeats, "PART_DOCS", 40)
    rng = random.Random(9)
    texts = [(i, None if i % 50 == 7 else rng.randbytes(rng.choice([0, 3, 9000])).hex()) for i in range(300)]
    shipped.createDataFrame(texts, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    source, build = repeats._blocks(shipped.read.parquet(f"{tmp_path}/docs"), "doc_id", "text", 1 << 19)
    parts = repeats._parts(source, build, T.LongType()).toArrow()
    assert max(map(len, parts.column("raw").to_pylist())) <= repeats.PART_BYTES * 1.01
    assert max(map(len, parts.column("ids").to_pylist())) <= 40
    blocks = parts.column("block").unique().to_pylist()
    assert 2 < len(blocks) < len(parts) / 2
    back = []
    for block in blocks:
        own = parts.filter(pa.compute.equal(parts.column("block"), block))
        number, ids, offsets, raw = repeats._whole(own.take(rng.sample(range(len(own)), len(own))))
        assert number == block and offsets[-1] == len(raw)
        back += [(i, raw[a:b].decode()) for i, a, b in zip(ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())]
    assert sorted(back) == [(i, t or "") for i, t in texts]


def test_spans_and_kept_in_one_pass_of_python(shipped, tmp_path):
    """No Python node feeds another in the same task: each would have a worker with memory of its own."""
    rows = passages(random.Random(4), 40, 30)
    shipped.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    plan = remove_repeats(shipped.read.parquet(f"{tmp_path}/docs"), length=30)._jdf.queryExecution().executedPlan().toString()
    depth, seen = [], 0
    for line in plan.splitlines():
        at, name = len(line) - len(line.lstrip(" +-:*()0123456789")), line.lstrip(" +-:*()0123456789").split(" ")[0]
        depth = [d for d in depth if d[0] < at] + [(at, name)]
        if name == "MapInArrow":
            seen += 1
            above = [n for _, n in depth[:-1]]
            since = above[max((i for i, n in enumerate(above) if "Exchange" in n), default=-1) + 1:]
            assert "MapInArrow" not in since
    assert seen
