"""Prefix trie of conversations, summed over subtrees along its Euler tour.

A node is a distinct sequence of first turns.  What lies below a node is found without
walking the tree:

1. Turns are numbered, and prefixes named, by running counts and running exclusive ors of
   turn hashes over ranges of (conversation, place), so a conversation may span many
   tasks.  Every node then proves that its members agree in parent, role and text, so equal
   names of different prefixes would be found out (and end the run).
2. Every node but the root has an enter and an exit arc.  The arc after each is known from
   first children, next siblings and parents, which come from one ordering by (parent,
   node) that may cut the children of a node anywhere.
3. The list of arcs is ranked: tasks join what is linked inside a range of arcs, which
   lie close together when conversations that share turns do; rounds of random mates then splice
   out a quarter of what is left at a time, until a bounded rest is ranked in one task; the
   way back gives every arc its position.
4. Running sums over positions, read at the two arcs of a node, give its subtree's leaves
   and savings.

Turns are ordered by turn number (NULL first), ties by role and then text; NULL role or
text is empty.  Rows without a conversation id belong to no conversation and are left out.
Repeated rows are turns of their own.  Very long texts are hashed where they lie and carried
once per node and task.  An empty table has no nodes, not even a root.  Other columns are
not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import rows
from fillgauge.operators.joins import attach
from fillgauge.session import settle

#: Arcs whose links one task joins at a time, and positions it sums over.
PART_ROWS = 65_536
#: Chains of arcs that are ranked in one task.
LAST_ROWS = 8_192
#: Ids that are folded into one row before a node's ids are hashed in order.
FOLD_IDS = 4_096
#: Characters of a text that take part in cutting turns into ranges.
RANGE_CHARS = 64

_FOLDS: dict[str, tuple[Callable, Callable]] = {
    "count": (F.sum, lambda a, b: a + b), "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(table: DataFrame, keys: Sequence[str], order: Sequence[str], folds: Mapping[str, tuple[str, Column]], *,
            ranges: Sequence[Column] | None = None) -> DataFrame:
    """``table`` with running folds per key in this order, the row itself included.

    ``folds`` gives for each new column its kind (count, sum or xor) and what is folded.
    ``ranges`` are the columns by which rows are cut into ranges, if not all of ``order``;
    they must not decrease along it.  A key may span any number of tasks.
    """
    keys, order = list(keys), list(order)
    cut = [*keys, *(order if ranges is None else ranges)]
    values = {n: F.lit(1).cast("long") if kind == "count" else value for n, (kind, value) in folds.items()}
    parts = settle(table.withColumns({f"__v_{n}": v for n, v in values.items()})
                   .repartitionByRange(*cut).withColumn("__part", F.spark_partition_id()))
    fold = {n: _FOLDS[kind][0] for n, (kind, _) in folds.items()}
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "__part").agg(*[fold[n](f"__v_{n}").alias(f"__t_{n}") for n in folds])
    offsets = totals.select(*keys, "__part", *[
        F.coalesce(fold[n](f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in folds])
    local = parts.withColumns({f"__r_{n}": fold[n](f"__v_{n}").over(inside) for n in folds})
    out = attach(local, offsets, [*keys, "__part"], null_safe=True)
    return out.select(*table.columns, *[
        _FOLDS[kind][1](F.col(f"__r_{n}"), F.col(f"__b_{n}")).alias(n) for n, (kind, _) in folds.items()])


def number_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv, place, role, text): the turns of each conversation, numbered from 1."""
    clean = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))
    numbered = running(clean, ["conv"], ["turn", "role", "text"], {"place": ("count", F.lit(1))},
                       ranges=[F.col("turn"), F.col("role"), F.substring("text", 1, RANGE_CHARS)])
    return numbered.select("conv", "place", "role", "text")


def prefix_names(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, place, role, text) with the names ``k1, k2`` of each prefix and ``p1, p2`` of the one before."""
    own = turns.withColumns({f"h{i}": F.xxhash64(F.lit(i), "place", "role", "text") for i in (1, 2)})
    named = running(own, ["conv"], ["place"], {f"k{i}": ("xor", F.col(f"h{i}")) for i in (1, 2)})
    return named.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)}).drop("h1", "h2")


def trie_nodes(named: DataFrame) -> DataFrame:
    """One row per prefix of at least one turn: number, smallest member, depth, names, members, length of its last text."""
    last = F.struct("p1", "p2", "role", "text")
    nodes = settle(named.groupBy(F.col("place").alias("depth"), "k1", "k2").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"),
        F.min(last).alias("__first"), F.max(last).alias("__last")))
    if not nodes.filter("__first != __last").isEmpty():
        raise RuntimeError("two prefixes share a name")
    flat = nodes.select("depth", "k1", "k2", F.col("__first.p1").alias("p1"), F.col("__first.p2").alias("p2"),
                        "n_convs", "conv_id", F.char_length("__first.text").cast("long").alias("n_chars"))
    return settle(running(flat, [], ["conv_id", "depth"], {"num": ("count", F.lit(1))}).withColumn("num", F.col("num") - 1))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the number and smallest member of the parent; those below the root have number -1."""
    above = nodes.select(F.col("depth").alias("__d"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"),
                         F.col("num").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    same = (F.col("depth") - 1 == F.col("__d")) & (F.col("p1") == F.col("__k1")) & (F.col("p2") == F.col("__k2"))
    deep = nodes.filter("depth > 1").join(above, same).drop("__d", "__k1", "__k2")
    first = nodes.filter("depth = 1").withColumn("parent", F.lit(-1).cast("long")).withColumn(
        "parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType))
    return settle(deep.unionByName(first))


def tour(nodes: DataFrame) -> DataFrame:
    """(id, next, num, leaf, saved): the enter arc 2 num and the exit arc 2 num + 1 of every node, and the arc after."""
    ranged = settle(nodes.select("num", "parent", "leaf", "saved", "first_child")
                    .repartitionByRange("parent", "num").withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("parent", "__part").orderBy("num")
    after = ranged.groupBy("parent", "__part").agg(F.min("num").alias("__begin"))
    over = Window.partitionBy("parent").orderBy("__part")
    after = after.select("parent", "__part", F.lead("__begin").over(over).alias("__begin"))
    linked = attach(ranged.withColumn("__sib", F.lead("num").over(inside)), after, ["parent", "__part"])
    sibling = F.coalesce("__sib", "__begin")
    enter, leave = 2 * F.col("num"), 2 * F.col("num") + 1
    next_in = F.coalesce(2 * F.col("first_child"), leave)
    next_out = F.coalesce(2 * sibling, F.when(F.col("parent") >= 0, 2 * F.col("parent") + 1))
    zero = F.lit(0).cast("long")
    arcs = F.array(F.struct(enter.alias("id"), next_in.alias("next"), F.col("leaf").alias("leaf"), F.col("saved").alias("saved")),
                   F.struct(leave.alias("id"), next_out.alias("next"), zero.alias("leaf"), zero.alias("saved")))
    return linked.select("num", F.explode(arcs).alias("arc")).select("arc.id", "arc.next", "num", "arc.leaf", "arc.saved")


_CHAIN = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "head", "offset", "next", "length")])


def _joined_links(table: pa.Table) -> pa.Table:
    """The chains inside a group of (id, next, length): head and offset of each id; after and length at the heads."""
    ids, length = table.column("id").to_numpy(), table.column("length").to_numpy()
    order = np.argsort(ids)
    ids, length = ids[order], length[order]
    after = table.column("next").combine_chunks().fill_null(-1).to_numpy()[order]
    at = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
    inside = ids[at] == after
    before = np.arange(len(ids))
    before[at[inside]] = np.flatnonzero(inside)
    offset = np.where(before == np.arange(len(ids)), 0, length[before])
    while True:  # twice as far each time
        further = before[before]
        if np.array_equal(further, before):
            break
        offset, before = offset + offset[before], further
    tail = np.flatnonzero(~inside)
    beyond, total = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    beyond[before[tail]], total[before[tail]] = after[tail], offset[tail] + length[tail]
    return pa.Table.from_batches([rows(_CHAIN, [ids, ids[before], offset, beyond, total])])


def _chains(items: DataFrame, part: Column) -> DataFrame:
    return settle(items.withColumn("__part", part).groupBy("__part").applyInArrow(
        lambda table: _joined_links(table.select(["id", "next", "length"])), _CHAIN))


def list_positions(items: DataFrame, *, part_rows: int = PART_ROWS, last_rows: int = LAST_ROWS) -> DataFrame:
    """(id, position) in a list of (id, next); ids are whole numbers from 0 on, the last one's ``next`` is NULL.

    A group inside a task holds at most ``part_rows`` ids, or ``last_rows`` chains at the end.
    """
    local = _chains(items.select("id", "next", F.lit(1).cast("long").alias("length")),
                    F.floor(F.col("id") / part_rows))
    left = local.filter("id = head").select("id", F.when(F.col("next") >= 0, F.col("next")).alias("next"), "length")
    spliced: list[DataFrame] = []
    while left.count() > last_rows:
        def heads(c: str, turn: int = len(spliced)) -> Column:
            return F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 1

        goes = left.filter(heads("id")).select(F.col("id").alias("__id"), F.col("next").alias("__next"),
                                               F.col("length").alias("__length"))
        met = settle(left.join(goes, (F.col("next") == F.col("__id")) & ~heads("id"), "left"))
        gone = met.filter("__id is not null").select(F.col("__id").alias("id"), F.col("id").alias("__head"),
                                                     F.col("length").alias("__offset"))
        spliced.append(gone)
        left = settle(met.join(gone.select("id"), "id", "left_anti").select(
            "id", F.when(F.col("__id").isNotNull(), F.col("__next")).otherwise(F.col("next")).alias("next"),
            (F.col("length") + F.coalesce("__length", F.lit(0))).alias("length")))
    at = _chains(left, F.lit(0)).select("id", F.col("offset").alias("position"))
    for gone in reversed(spliced):
        back = gone.join(at.withColumnRenamed("id", "__head"), "__head").select(
            "id", (F.col("position") + F.col("__offset")).alias("position"))
        at = settle(at.unionByName(back))
    return local.select(F.col("id").alias("__own"), "head", "offset").join(at, F.col("head") == F.col("id")).select(
        F.col("__own").alias("id"), (F.col("position") + F.col("offset")).alias("position"))


def subtree_sums(arcs: DataFrame, positions: DataFrame, *, part_rows: int = PART_ROWS) -> DataFrame:
    """(num, leaves, saves): sums over each subtree, from running sums read at the node's two arcs."""
    placed = settle(arcs.join(positions, "id").withColumn("part", F.floor(F.col("position") / part_rows)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s")).select(
        "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("l", "s")])
    upto = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("num", "part", (F.col("id") % 2).alias("side"), "leaf", "saved",
                           F.sum("leaf").over(upto).alias("l"), F.sum("saved").over(upto).alias("s"))
    summed = attach(summed, starts, ["part"])

    def read(total: str, start: str, own: str) -> Column:
        # all up to the exit, without what came before the enter arc
        upto_here = F.col(total) + F.col(start)
        return F.sum(F.when(F.col("side") == 1, upto_here).otherwise(F.col(own) - upto_here))

    return summed.groupBy("num").agg(read("l", "__l", "leaf").alias("n_leaves"), read("s", "__s", "saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, members: DataFrame, *, part_rows: int = PART_ROWS,
                last_rows: int = LAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and where each conversation ends.

    ``turns`` has (conv, place, role, text) with places from 1 without gaps, ``members`` every
    conv once, also those without turns.  The first result has one row per node: num (-1 for
    the root), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; the
    second (conv, num).
    """
    named = settle(prefix_names(turns))
    nodes = with_parents(trie_nodes(named))
    below = nodes.groupBy(F.col("parent").alias("num")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("num").alias("first_child"))
    below = settle(below)
    full = settle(nodes.join(below, "num", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "leaf": F.col("first_child").isNull().cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("n_chars")}))
    arcs = settle(tour(full))
    sums = subtree_sums(arcs, list_positions(arcs, part_rows=part_rows, last_rows=last_rows), part_rows=part_rows)
    least = members.agg(F.min("conv")).first()[0]
    inner = full.join(sums, "num").select("num", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                          "n_leaves", "saved_tokens")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(least)))  # below the root
    everything = full.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"),
                          F.sum((F.col("parent") == -1).cast("long")).alias("children")).first()
    root = members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(-1).cast("long").alias("num"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast(inner.schema["conv_id"].dataType).alias("parent_conv_id"), "n_convs",
        F.lit(everything["children"] or 0).cast("long").alias("n_children"),
        F.lit(everything["leaves"] or 1).cast("long").alias("n_leaves"),
        F.lit(everything["saves"] or 0).cast("long").alias("saved_tokens"))
    first = inner.schema["conv_id"].dataType
    out = inner.unionByName(root.withColumn("conv_id", F.col("conv_id").cast(first)).withColumn(
        "parent_conv_id", F.col("parent_conv_id").cast(first)))

    lengths = named.groupBy("conv").agg(F.max("place").alias("place"))
    last = named.select("conv", "place", "k1", "k2").join(lengths, ["conv", "place"])
    keys = nodes.select(F.col("depth").alias("place"), "k1", "k2", "num")
    ends = last.join(keys, ["place", "k1", "k2"]).select("conv", "num")
    turnless = members.select("conv").join(lengths.select("conv"), "conv", "left_anti").select(
        "conv", F.lit(-1).cast("long").alias("num"))
    return out, ends.unionByName(turnless)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(num, ends_sha256): SHA-256 of each node's conversation ids in numeric order, joined by commas.

    A node's ids are ordered over many tasks and folded to long strings there; only those meet, and are
    hashed one after another.
    """
    folded = T.StructType([T.StructField("num", T.LongType()), T.StructField("at", T.LongType()),
                           T.StructField("ids", T.StringType())])
    digest = T.StructType([T.StructField("num", T.LongType()), T.StructField("ends_sha256", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num, conv = batch.column("num").to_numpy(), batch.column("conv").to_numpy()
            cuts = np.flatnonzero(np.diff(num)) + 1
            cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(num), FOLD_IDS), [len(num)]]))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:])]
            yield rows(folded, [num[cuts[:-1]], conv[cuts[:-1]], text])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for num, ids in zip(batch.column("num").to_pylist(), batch.column("ids").to_pylist()):
                if num != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = num, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(digest, [[d[0] for d in done], [d[1] for d in done]])
        if state is not None:
            yield rows(digest, [[current], [state.hexdigest()]])

    ordered = ends.repartitionByRange("num", "conv").sortWithinPartitions("num", "conv")
    return (ordered.select("num", "conv").mapInArrow(fold, folded).repartition("num")
            .sortWithinPartitions("num", "at").mapInArrow(hashed, digest))


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its hundred.

    ``turns`` are numbered turns, ``convs`` all their conversations (conv, n).
    """
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    base = F.col("conv") - F.col("conv") % 100
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = settle(convs.select("conv", taken.alias("h"), base.alias("base")).join(sizes, "base", "left").select(
        "conv", "base", "h", (F.col("h") - F.least("h", F.coalesce("base_n", F.lit(0)))).alias("gap")))
    own = attach(turns.filter(F.col("place") > taken), plan.select("conv", "gap"), ["conv"], settled=True).select(
        "conv", (F.col("place") - F.col("gap")).alias("place"), "role", "text")
    heads = turns.filter((F.col("conv") % 100 == 0) & (F.col("place") <= 5)).withColumnRenamed("conv", "base")
    shared = plan.filter("h > 0").join(heads, "base").filter(F.col("place") <= F.col("h")).select(
        "conv", "place", "role", "text")
    return own.unionByName(shared)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node."""
    turns = settle(number_turns(spark.read.parquet(f"{folder}/conversations.parquet")))
    convs = settle(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    nodes, ends = prefix_trie(rebuilt(turns, convs), convs)
    digests = ends_digest(ends)
    return nodes.join(digests, "num", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id
                    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS turns,
                  xor(4294967295, list_reduce(
                    list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                          lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h
           FROM t GROUP BY c),
     r AS (SELECT o.c, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
           FROM o LEFT JOIN o b ON b.c = o.c - o.c % 100),
     p AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ended FROM r, unnest(range(len(turns) + 1)) AS u(d)),
     n AS (SELECT d, prefix, min(c) AS c, count(*) AS n_convs,
                  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
                  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[d].text) END AS saved
           FROM p GROUP BY d, prefix),
     k AS (SELECT a.d, a.prefix, count(b.d) AS n_children FROM n a
           LEFT JOIN n b ON b.d = a.d + 1 AND b.prefix[1:a.d] = a.prefix GROUP BY a.d, a.prefix),
     s AS (SELECT a.d, a.prefix, sum((k.n_children = 0)::INT) AS n_leaves, sum(b.saved) AS saved_tokens
           FROM n a JOIN n b ON b.d >= a.d AND b.prefix[1:a.d] = a.prefix
           JOIN k ON k.d = b.d AND k.prefix = b.prefix GROUP BY a.d, a.prefix)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN k USING (d, prefix) JOIN s USING (d, prefix)
LEFT JOIN n u ON u.d = n.d - 1 AND u.prefix = n.prefix[1:n.d - 1]
"""
