"""Passages that occur more than once, found by merging the sorted suffixes of many shards.

A byte goes if a string of ``length`` bytes around it starts anywhere else too.  In the
Burrows-Wheeler transform of the whole corpus those strings are the intervals of suffixes
that share ``length`` first bytes.  The transforms of shards are merged without sorting all
suffixes again: the interleave starts as one interval and every round splits each interval
by further bytes, those that follow the common string or, on the transform's side, those
before it; an interval with one suffix is finished and takes no part in later rounds.

Two things keep that within a few bytes per byte of text, where the plain form reads
every suffix once per byte of the common string:

* **Sampled suffixes.**  A string of ``length`` bytes has one anchor: its rightmost least
  hash of ``core`` bytes.  Equal strings have their anchors at equal places, so only
  anchors need to be merged, one per 60 bytes or so.  The strings with the same anchor
  make a run; the run's place in the string goes from ``first`` to ``last`` bytes.
* **Doubling.**  A round splits intervals at the middle of a run instead of by one byte: block
  [u, v] of places has as common string the bytes from u before the anchor to length - v
  behind it, which all its strings hold, and its halves share more bytes to the right or to the left.
  With 128 places eight rounds do.

The stages:

1. Each task cuts its documents into blocks (the shards), sorts the anchors' cores there, and sends
   every distinct core once with what its run looks like as a whole.  Cores that one block
   holds alone are finished.  If all runs of a core look alike, every string of theirs is
   repeated, and the core is finished too.
2. Blocks meet their answers; only runs of cores with unlike contexts stay open.  Each block
   gives one row per distinct context.
3. The rounds, over open contexts only.  Contexts alike in a block of places are repeated there,
   and one of them goes on to be compared with the others.  Contexts of one core go through
   all rounds in one task if they are few; where they are many, as around a passage that a
   large share of all texts quotes, each round is a job of joins and aggregates.
4. Documents with open runs get the intervals found; covered bytes are joined to spans.

Cores are compared by 64-bit hashes, which can only keep a run open that need not be; runs
are told apart by 64 bits more of another hash within a core, contexts in the rounds by 128-bit digests.
What many shards share arrives once per shard and is folded further by partial aggregates.

NULL text counts as empty; texts shorter than ``length`` keep everything.  Repeated rows repeat their
strings, so they lose them; strings may also recur, and overlap, inside one text.  Very long texts
are worked on in pieces, but lie whole in one task.  Rows with equal or NULL ids stay apart.  An
empty table gives no rows.  Other columns than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import (arrow_type, give_back, one_chunk, rows, squeeze, steps, text_bytes, texts_of, trimmed,
                                 unsqueeze, with_bytes)
from fillgauge.operators.joins import attach
from fillgauge.session import settle

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of text per block, and per bucket of the exchange of cores.
BLOCK_BYTES = 16 * 1024 * 1024
BUCKET_BYTES = 64 * 1024 * 1024
#: Bytes of text whose anchors are looked for at a time.
PIECE_BYTES = 96 * 1024
#: Bytes of text, and documents, in a row that carries a part of a block: a block in one row
#: would need several contiguous buffers of its size in the JVM.
PART_BYTES = 256 * 1024
PART_DOCS = 16 * 1024
#: Bytes of a row group of stored texts; a task holds one while it writes, and while it reads.
GROUP_BYTES = 16 * 1024 * 1024
#: Bits of an anchor's key that tell its place in a piece.
_PLACE_BITS = 21
#: Odd constants of the rolling hash; any would do.
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Most contexts with one core that a task takes through all rounds.
LARGE_BUCKET = 4096
#: What is known of a core.
ALONE, ALIKE, OPEN = 0, 1, 2


def places(length: int) -> int:
    """Places an anchor may have in a string: a power of two of at most 0.64 of its bytes."""
    return 1 << max(0, int(0.64 * length).bit_length() - 1)


def _piece_anchors(raw: np.ndarray, length: int) -> np.ndarray:
    """Where the anchor of each string of ``length`` bytes of a piece lies in the piece."""
    n_places = places(length)
    core = length - n_places + 1
    step = raw.astype(np.uint64) + np.uint64(1)
    step *= _MIX[0]
    step ^= step >> np.uint64(29)
    held, size = step, 1
    for bit in bin(core)[3:]:  # from hashes of n bytes to those of 2n, and of one more
        held = (held[:-size] * _MIX[1]) ^ (held[size:] * _MIX[2])
        held ^= held >> np.uint64(31)
        size *= 2
        if bit == "1":
            held = (held[:-1] * _MIX[1]) ^ (step[size:] * _MIX[2])
            held ^= held >> np.uint64(31)
            size += 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    held = (held & ~low) | (low - np.arange(len(held), dtype=np.uint64))
    wide = 1
    while wide < n_places:
        held = np.minimum(held[:-wide], held[wide:])
        wide *= 2
    return (low - (held & low)).astype(np.int64)


def runs_of(raw: bytes, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each run of strings, in order; no string crosses an end of a text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, max(0, len(data) - length + 1), PIECE_BYTES):
        anchor = a + _piece_anchors(data[a:a + PIECE_BYTES + length - 1], length)
        b = a + len(anchor)
        inside, begins = np.zeros(b - a, dtype=bool), np.zeros(b - a, dtype=bool)
        for d in range(int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b, side="left"))):
            first, last = max(int(offsets[d]), a), min(int(offsets[d + 1]) - length + 1, b)
            if first < last:
                inside[first - a:last - a] = True
                begins[first - a] = first == offsets[d]
        starts = np.flatnonzero(inside)
        if len(starts):
            own, begins = anchor[starts], begins[starts]
            fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | begins[1:]])
            at = np.flatnonzero(fresh)
            found.append((own[at], a + starts[at], a + starts[np.append(at[1:] - 1, len(starts) - 1)]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    anchor, start, stop = (np.concatenate(x) for x in zip(*found))
    # a run that an end of a piece has cut
    same = (anchor[1:] == anchor[:-1]) & (start[1:] == stop[:-1] + 1) & ~np.isin(start[1:], offsets)
    keep = np.concatenate([[True], ~same])
    return anchor[keep], start[keep], stop[np.append(~same, True)]


class Shard:
    """A block of texts: its runs, their cores in order, and whether a core's runs look alike."""

    def __init__(self, raw: bytes, offsets: np.ndarray, length: int):
        self.raw, self.offsets, self.length = raw, offsets, length
        self.anchor, self.start, self.stop = runs_of(raw, offsets, length)
        core = length - places(length) + 1
        view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
        cores, looks = (np.empty(len(self.anchor), dtype=np.uint64) for _ in range(2))
        for at in range(0, len(cores), 16384):  # a list of all places would take more than the text
            own = [x[at:at + 16384].tolist() for x in (self.anchor, self.start, self.stop)]
            cores[at:at + 16384] = [digest(view[a:a + core]) for a in own[0]]
            looks[at:at + 16384] = [digest(view[p:q + length], a - p + 1) for a, p, q in zip(*own)]
        #: distinct cores, and which one each run has
        self.cores, self.core_of, count = np.unique(cores, return_inverse=True, return_counts=True)
        self.several = count > 1
        self.look = np.zeros(len(self.cores), dtype=np.uint64)
        self.look[self.core_of] = looks
        unlike = np.zeros(len(self.cores), dtype=bool)
        unlike[self.core_of[looks != self.look[self.core_of]]] = True
        self.unlike = unlike
        self.check = zlib.crc32(raw)


def judge_cores(cores: list[np.ndarray], looks: list[np.ndarray], flags: list[np.ndarray]) -> list[np.ndarray]:
    """What is known of the cores of several shards, for each shard; flags: 1 several runs, 2 unlike ones."""
    core, look, flag = (np.concatenate(x) for x in (cores, looks, flags))
    order = np.argsort(core, kind="stable")
    core, look, flag = core[order], look[order], flag[order]
    first = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]])) if len(core) else np.zeros(0, dtype=np.int64)
    group = np.cumsum(np.concatenate([[False], core[1:] != core[:-1]])) if len(core) else first
    n = np.diff(np.append(first, len(core)))
    unlike = (look != look[first][group]) | (flag & 2 > 0) if len(core) else np.zeros(0, dtype=bool)
    mixed = np.bincount(group[unlike], minlength=len(first)) > 0 if len(core) else np.zeros(0, dtype=bool)
    repeated = (n > 1) | (np.bincount(group[flag & 1 > 0], minlength=len(first)) > 0) if len(core) else mixed
    known = np.where(mixed, OPEN, np.where(repeated, ALIKE, ALONE))
    out = np.empty(len(core), dtype=np.int64)
    out[order] = known[group]
    ends = np.cumsum([0] + [len(c) for c in cores])
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they meet or overlap."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > upto[:-1]])
    at = np.flatnonzero(fresh)
    return starts[at], upto[np.concatenate([at[1:] - 1, [len(upto) - 1]])]


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    cuts = zip([0, *ends.tolist()], [*starts.tolist(), len(raw)])
    return b"".join(raw[a:b] for a, b in cuts)


_SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()),
                      T.StructField("check", T.LongType()),
                      T.StructField("places", T.BinaryType()), T.StructField("cores", T.BinaryType()),
                      T.StructField("looks", T.BinaryType()), T.StructField("flags", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("check", T.LongType()), T.StructField("places", T.BinaryType()),
                        T.StructField("known", T.BinaryType())])
_CONTEXT = T.StructType([T.StructField("class", T.LongType()), T.StructField("first", T.IntegerType()),
                         T.StructField("last", T.IntegerType()), T.StructField("several", T.BooleanType()),
                         T.StructField("context", T.BinaryType())])


def _blocks(docs: DataFrame, id_col: str, text: str, block_bytes: int):
    """The rows of ``docs`` in blocks: a function over batches, and the input it needs."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("__text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, bytes]]:
        number, held, size = TaskContext.get().partitionId() << 20, [], 0

        def block() -> tuple:
            ids = pa.concat_arrays([one_chunk(t.column("id")) for t in held])
            offsets, raw = text_bytes(pa.concat_arrays([texts_of(t, "__text") for t in held]))
            held.clear()
            return number, ids, offsets.astype(np.int64), raw

        for table in steps(batches, "__text", block_bytes // 4):
            grown = table.column("__text").nbytes
            if held and size + grown > block_bytes:
                yield block()
                number, size = number + 1, 0
            held.append(table)
            size += grown
        if held:
            yield block()

    return source, build


def covered(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text: str = "text",
            block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, text (binary), starts and ends of the spans that occur elsewhere too.

    A span holds every byte covered by a string of ``length`` bytes that also starts at
    another place of this or another text; spans neither meet nor overlap.  The input is read twice
    and must give the same rows in the same tasks, as stored tables do; if it does not, this is found out.
    """
    return _covered(docs, length, id_col, text, block_bytes, bucket_bytes, ["text", "starts", "ends"])


def _covered(docs: DataFrame, length: int, id_col: str, text: str, block_bytes: int, bucket_bytes: int,
             columns: list[str]) -> DataFrame:
    if length < 1:
        raise ValueError("length must be 1 or more")
    source, build = _blocks(docs, id_col, text, block_bytes)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, math.ceil(size / bucket_bytes))
    answers = settle(_exchange_cores(source, build, buckets, length))
    found = settle(_apply_answers(source, build, answers, docs.schema[id_col].dataType, length),
                   **{"parquet.block.size": GROUP_BYTES})
    contexts = found.filter("class is not null").select(*_CONTEXT.names)
    repeated = refine(contexts, length)
    texts = found.filter("class is null").drop(*_CONTEXT.names)
    return _with_open(texts, repeated, length, columns).withColumnRenamed("id", id_col)


def _exchange_cores(source: DataFrame, build, buckets: int, length: int) -> DataFrame:
    """(block, places, known) of every block: what is known of its cores, in parts."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, offsets, raw in build(batches):
            shard = Shard(raw, offsets, length)
            home = (shard.cores % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            used, first = np.unique(home[order], return_index=True)
            picks = np.split(order, first[1:]) if len(used) else []
            flags = shard.several + 2 * shard.unlike
            for at in range(0, len(used), 256):
                part = picks[at:at + 256]
                yield rows(_SENT, [
                    used[at:at + 256].astype(np.int32), [number] * len(part), [shard.check] * len(part), [squeeze(p) for p in part],
                    [shard.cores[p].tobytes() for p in part], [shard.look[p].tobytes() for p in part],
                    [flags[p].astype(np.uint8).tobytes() for p in part]])
            del raw, shard, home, order, picks, flags  # not kept while the next block is built

    def receive(table: pa.Table) -> pa.Table:
        cores, looks = ([np.frombuffer(b, dtype=np.uint64) for b in table.column(c).to_pylist()] for c in ("cores", "looks"))
        flags = [np.frombuffer(b, dtype=np.uint8) for b in table.column("flags").to_pylist()]
        known = [squeeze(k) for k in judge_cores(cores, looks, flags)]
        give_back()
        return pa.Table.from_batches([rows(_ANSWER, [
            table.column("block"), table.column("check"), table.column("places"), known])])

    return (source.mapInArrow(trimmed(send), _SENT).repartition(buckets, "bucket").groupBy("bucket")
            .applyInArrow(receive, _ANSWER))


def _parts(source: DataFrame, build, id_type: T.DataType) -> DataFrame:
    """The blocks, each in rows of bounded size: what :func:`_whole` puts together again."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("check", T.LongType()),
                           T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("lengths", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("raw", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for number, ids, offsets, raw in build(batches):
            check, lengths, view = zlib.crc32(raw), np.diff(offsets), memoryview(raw)
            for part in range(max(math.ceil(len(raw) / PART_BYTES), math.ceil(len(ids) / PART_DOCS))):
                own = ids.slice(part * PART_DOCS, PART_DOCS)
                piece = view[part * PART_BYTES:(part + 1) * PART_BYTES]
                yield rows(schema, [
                    [number], [check], [part], pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                    [lengths[part * PART_DOCS:(part + 1) * PART_DOCS].tobytes()], [len(piece)],
                    [codec.compress(piece, asbytes=True)]])
            del raw, view, piece  # not kept while the next block is built

    return source.mapInArrow(trimmed(cut), schema)


def _whole(parts: pa.Table) -> tuple[int, pa.Array, np.ndarray, bytes]:
    """Number, ids, offsets and bytes of the block whose parts these are, in whatever order they came."""
    parts = parts.sort_by("part")
    lengths = np.frombuffer(b"".join(parts.column("lengths").to_pylist()), dtype=np.int64)
    raw = b"".join(pa.decompress(piece, n, codec="zstd", asbytes=True) if n else b"" for piece, n in
                   zip(parts.column("raw").to_pylist(), parts.column("n_bytes").to_pylist()))
    return parts.column("block")[0].as_py(), one_chunk(parts.column("ids")).flatten(), np.cumsum(np.append(0, lengths)), raw


def _apply_answers(source: DataFrame, build, answers: DataFrame, id_type: T.DataType, length: int) -> DataFrame:
    """Rows of two kinds: documents with what is known of them, and the contexts of open runs."""
    doc = T.StructType([T.StructField("id", id_type), T.StructField("place", T.LongType()),
                        T.StructField("text", T.BinaryType()), T.StructField("starts", T.ArrayType(T.LongType())),
                        T.StructField("ends", T.ArrayType(T.LongType())),
                        T.StructField("open", T.ArrayType(T.StructType([
                            T.StructField("class", T.LongType()), T.StructField("anchor", T.LongType())])))])
    schema = T.StructType([*doc, *_CONTEXT])
    listed = arrow_type(schema["open"].dataType)

    def apply(blocks: pa.Table, parts: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            raise RuntimeError("the input changed while it was read; store it first")
        number, ids, offsets, raw = _whole(blocks)
        shard = Shard(raw, offsets, length)
        known = np.full(len(shard.cores), -1)
        for at, what in zip(parts.column("places").to_pylist(), parts.column("known").to_pylist()):
            known[unsqueeze(at)] = unsqueeze(what)
        if (known < 0).any():
            raise RuntimeError("the input changed while it was read; store it first")
        out = list(_block_rows(shard, known, number, ids, schema, listed))
        del raw, shard
        give_back()
        return pa.Table.from_batches(out)

    return _parts(source, build, id_type).groupBy("block", "check").cogroup(
        answers.groupBy("block", "check")).applyInArrow(apply, schema)


def _block_rows(shard: Shard, known: np.ndarray, number: int, ids: pa.Array, schema: T.StructType,
                listed: pa.DataType) -> Iterator[pa.RecordBatch]:
    length, offsets = shard.length, shard.offsets
    state = known[shard.core_of]
    doc = np.searchsorted(offsets, shard.start, side="right") - 1
    # open runs: one class per distinct context of the block
    still = np.flatnonzero(state == OPEN)
    classes: dict[tuple, int] = {}
    of = np.zeros(len(still), dtype=np.int64)
    for i, (a, p, q) in enumerate(zip(*(x[still].tolist() for x in (shard.anchor, shard.start, shard.stop)))):
        of[i] = classes.setdefault((a - q, a - p, shard.raw[p:q + length]), len(classes))
    several = np.bincount(of, minlength=len(classes)) > 1
    n, m = len(offsets) - 1, len(classes)
    sure = np.flatnonzero(state == ALIKE)
    sure_cut, open_cut = (np.searchsorted(doc[x], np.arange(n + 1)) for x in (sure, still))
    for first in range(0, n, 500):
        docs = range(first, min(n, first + 500))
        starts, ends, held = [], [], []
        for d in docs:
            mine = sure[sure_cut[d]:sure_cut[d + 1]]
            s, e = _joined(shard.start[mine] - offsets[d], shard.stop[mine] + length - offsets[d])
            starts.append(s)
            ends.append(e)
            mine = slice(open_cut[d], open_cut[d + 1])
            held.append([{"class": (number << 23) + int(c), "anchor": int(a)} for c, a in
                         zip(of[mine].tolist(), (shard.anchor[still[mine]] - offsets[d]).tolist())])
        yield rows(schema, [
            ids.slice(first, len(starts)), [(number << 23) + d for d in docs],
            with_bytes(offsets[first:first + len(starts) + 1] - offsets[first],
                       shard.raw[offsets[first]:offsets[first + len(starts)]], pa.binary()), starts, ends, pa.array(held, listed),
            *[pa.nulls(len(starts), arrow_type(f.dataType)) for f in _CONTEXT]])
    keys = list(classes)
    for first in range(0, m, 2000):
        part = keys[first:first + 2000]
        yield rows(schema, [
            *[pa.nulls(len(part), arrow_type(f.dataType)) for f in schema.fields[:len(schema) - len(_CONTEXT)]],
            [(number << 23) + first + i for i in range(len(part))], [max(0, k[0]) for k in part], [k[1] for k in part],
            several[first:first + len(part)], [k[2] for k in part]])


_FOUND = T.StructType([T.StructField("class", T.LongType()), T.StructField("first", T.IntegerType()),
                       T.StructField("last", T.IntegerType())])


def refine(contexts: DataFrame, length: int = LENGTH, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(class, first, last): the places of each context whose strings occur more than once.

    A context has the strings with ``first`` to ``last`` bytes before the anchor.  Every round takes
    blocks [u, v] of places: contexts with the same common string stay together, those that are alike in all
    the block are repeated there, and of each kind one goes on to the two halves while others differ from it.
    Contexts with one core meet in one task and go through all rounds there, unless they are more than
    ``large_bucket``: then every round is a job, and no task holds them all.
    """
    core = F.substring("context", F.col("last") + 1, length - places(length) + 1)
    keyed = contexts.withColumn("core", F.xxhash64(core))
    large = keyed.groupBy("core").count().filter(F.col("count") > large_bucket).select("core", F.lit(True).alias("large"))
    keyed = attach(keyed, large, ["core"])
    small = (keyed.filter("large is null").select("core", *_CONTEXT.names).repartition("core")
             .sortWithinPartitions("core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("core", *_CONTEXT.names))):
                if own != bucket:
                    found += refined(held, length)
                    bucket, held = own, []
                held.append(tuple(row))
            yield rows(_FOUND, list(zip(*found)) or [[], [], []])
        yield rows(_FOUND, list(zip(*refined(held, length))) or [[], [], []])

    return small.mapInArrow(trimmed(run), _FOUND).unionByName(
        _refine_in_rounds(settle(keyed.filter("large").select(*_CONTEXT.names)), length))


def refined(contexts: list[tuple[int, int, int, bool, bytes]], length: int) -> list[tuple[int, int, int]]:
    """:func:`refine` for a few contexts (class, first, last, several, context)."""
    out, open_ = [], [(0, places(length) - 1, contexts)]
    while open_:
        u, v, held = open_.pop()
        buckets: dict[bytes, dict[tuple, list[tuple]]] = {}
        for row in held:
            _, first, last, _, context = row
            low, high = max(u, first), min(v, last)
            if low <= high:
                looks = buckets.setdefault(context[last - u:last - v + length], {})
                looks.setdefault((low, high, context[last - high:last - low + length]), []).append(row)
        for looks in buckets.values():
            further, single = [], False
            for (low, high, _), alike in looks.items():
                repeated = len(alike) > 1 or alike[0][3]
                if repeated:
                    out += [(row[0], low, high) for row in alike]
                single |= not repeated
                further.append((*alike[0][:3], repeated, alike[0][4]))
            if single and len(further) > 1 and v > u:
                middle = (u + v) // 2
                open_ += [(u, middle, further), (middle + 1, v, further)]
    return out


def _refine_in_rounds(contexts: DataFrame, length: int) -> DataFrame:
    """:func:`refine` with one job per round, for contexts whose cores many others have."""
    def bytes_from(before: Column, upto: Column) -> Column:
        return F.substring("context", F.col("last") - before + 1, upto + before)

    open_ = contexts.withColumns({"u": F.lit(0), "v": F.lit(places(length) - 1)})
    found: list[DataFrame] = []
    while True:
        low, high = F.greatest("u", "first"), F.least("v", "last")
        keyed = settle(open_.filter(low <= high).withColumns({
            "core": F.unhex(F.md5(bytes_from(F.col("u"), length - F.col("v")))),
            "look": F.unhex(F.md5(F.concat(F.concat_ws(",", low, high, F.lit("")).cast("binary"),
                                           bytes_from(high, length - low))))}))
        looks = settle(keyed.groupBy("u", "core", "look").agg(
            F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("n"), F.min("class").alias("chosen")))
        kinds = looks.groupBy("u", "core").agg(F.count(F.lit(1)).alias("kinds"),
                                               F.max((F.col("n") == 1).cast("int")).alias("single"))
        told = settle(looks.join(kinds, ["u", "core"]).filter("n > 1 or kinds > 1"))
        met = settle(keyed.join(told, ["u", "core", "look"]))
        found.append(met.filter("n > 1").select("class", low.alias("first"), high.alias("last")))
        further = met.filter("kinds > 1 and single = 1 and class = chosen and v > u")
        if further.isEmpty():
            break
        middle = F.floor((F.col("u") + F.col("v")) / 2).cast("int")
        halves = F.array(F.struct(F.col("u"), middle.alias("v")), F.struct((middle + 1).alias("u"), F.col("v")))
        open_ = further.select("class", "first", "last", (F.col("n") > 1).alias("several"), "context",
                               F.explode(halves).alias("half")).select("*", "half.u", "half.v").drop("half")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _with_open(docs: DataFrame, repeated: DataFrame, length: int, columns: list[str]) -> DataFrame:
    """Id and ``columns`` of documents with the spans of their open runs added; ``kept`` if that is asked for.

    One pass of Python does both, so a task has one worker, and a text goes there once and back if it is asked for.
    """
    done = docs.filter(F.size("open") == 0).select("id", "text", "starts", "ends")
    opened = docs.filter(F.size("open") > 0)
    of = repeated.groupBy("class").agg(F.collect_list(F.struct("first", "last")).alias("blocks"))  # at most 2 per place
    asked = opened.select("place", F.explode("open").alias("run")).select("place", "run.class", "run.anchor")
    more = asked.join(of, "class").groupBy("place").agg(F.flatten(F.collect_list(F.transform("blocks", lambda b: F.struct(
        (F.col("anchor") - b["last"]).alias("start"), (F.col("anchor") - b["first"] + length).alias("end"))))).alias("more"))
    known = T.StructType([*done.schema, T.StructField("kept", T.BinaryType())])
    schema = T.StructType([known[c] for c in ("id", *columns)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "text"):
            starts, ends, left = [], [], []
            for raw, s, e, extra in zip(*(table.column(c).to_pylist() for c in ("text", "starts", "ends", "more"))):
                s, e = np.array(s, dtype=np.int64), np.array(e, dtype=np.int64)
                if extra:
                    s, e = _joined(np.append(s, [x["start"] for x in extra]), np.append(e, [x["end"] for x in extra]))
                starts.append(s)
                ends.append(e)
                if "kept" in columns:
                    left.append(_kept(raw, s, e))
            made = {"id": table.column("id"), "text": table.column("text"), "starts": starts, "ends": ends, "kept": left}
            yield rows(schema, [made[c] for c in schema.names])

    both = opened.join(more, "place", "left").select("id", "text", "starts", "ends", "more")
    if "kept" in columns:
        return both.unionByName(done, allowMissingColumns=True).mapInArrow(trimmed(join), schema)
    return done.unionByName(both.mapInArrow(trimmed(join), schema))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text: str = "text",
                   with_text: bool = True) -> DataFrame:
    """``covered`` with ``kept``, the bytes outside of all spans; they need not be whole UTF-8 characters.

    Who does not need the text beside what is kept of it saves its way back without it.
    """
    return _covered(docs, length, id_col, text, BLOCK_BYTES, BUCKET_BYTES, ["text"] * with_text + ["starts", "ends", "kept"])


def op12_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that occur elsewhere too."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return remove_repeats(docs, with_text=False).select(
        "doc_id", (removed + F.octet_length("kept")).alias("n_bytes"), removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
