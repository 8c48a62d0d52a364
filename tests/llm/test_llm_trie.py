"""The prefix trie against a plain walk over prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.prefix_trie import (ends_digest, list_positions, number_turns, op11_prefix_trie, prefix_trie, rebuilt,
                                       running)

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("num", T.StringType()), T.StructField("place", T.StringType())])


def brute(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ended[tuple(ts)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saves = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saves[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saves[p],
                   hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest())
                  for p, cs in members.items())


def conversations(rng, n):
    out = []
    for c in range(n):
        for turn in range(rng.randrange(9)):
            out.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]),
                        rng.choice(["hi", "go on", "", None, "naïve 漢字 " * 3])))
    out += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (None, 1, "user", "nobody's")]
    out += [(1000 + c, t, "user", f"shared {t}") for c in range(40) for t in range(30)]  # copies, deep
    out += [(2000, t, "bot", str(t % 7)) for t in range(160)]  # one deep conversation
    out += [(300 + 100 * (c % 3) + 1, 0, "user", "x" * 30_000) for c in range(3)]
    rng.shuffle(out)
    return out


def trie(frame, **sizes):
    turns = number_turns(frame)
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    nodes, ends = prefix_trie(rebuilt(turns, convs), convs, **sizes)
    return nodes.join(ends_digest(ends), "num", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 1000, "last_rows": 900}])
def test_against_brute_force(shipped, sizes):
    rows = conversations(random.Random(4), 250)
    frame = shipped.createDataFrame([r + ("a", "b") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, trie(frame, **sizes).collect()), key=lambda r: (r[0], r[1])) == brute(rows)


def test_query_and_empty_table(shipped, tmp_path):
    empty = shipped.createDataFrame([], SCHEMA)
    assert trie(empty).count() == 0
    rows = [(101, 0, "user", "a"), (100, 0, "user", "b"), (100, 1, None, None)]
    shipped.createDataFrame([r + ("", "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_prefix_trie(shipped, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == brute(rows)


def test_positions_of_a_shuffled_list(shipped):
    order = list(range(5000))
    random.Random(1).shuffle(order)
    after = {a: b for a, b in zip(order, order[1:])}
    items = shipped.createDataFrame([(i, after.get(i)) for i in range(5000)], "id long, next long")
    got = {r["id"]: r["position"] for r in list_positions(items, part_rows=400, last_rows=2500).collect()}
    assert got == {v: i for i, v in enumerate(order)}


def test_running_totals_over_many_ranges(shipped):
    frame = shipped.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    got = running(frame, ["k"], ["id"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("id"))}).collect()
    seen = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["id"]):
        seen[r["k"]].append(r["id"])
        assert (r["n"], r["s"]) == (len(seen[r["k"]]), sum(seen[r["k"]]))
