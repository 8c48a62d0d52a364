"""Exact duplicates by Grace hashing.

1. Every task folds the rows it reads, a slice of bounded text at a time, to one record
   per distinct text, so a text that a third of all rows share sends one record per
   slice.  The folded slices are written to the shared folder.
2. Records are dealt to buckets by leading bits of their digest.  Buckets whose
   distinct contents exceed the bound are cut again by further bits, until each fits;
   only sizes are looked at for this.  Then the records move once, into the shuffle's
   spill files.
3. A task reads its buckets one after another into an open-addressing table that
   compares complete contents; the digest only says where to look.

Texts are equal when they are identical after lower-casing A-Z only.  NULL text counts
as empty.  Of equal texts the row with the largest id stays; a NULL id is the smallest,
and among rows of equal id the last one of the last slice stays, so that exactly one
row of each group is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import one_chunk, rows, steps, text_bytes, texts_of, trimmed
from fillgauge.operators.joins import attach
from fillgauge.session import settle

#: Bytes of text that one slice of the first pass folds.
SLICE_BYTES = 8 * 1024 * 1024
#: Bytes of distinct content that a bucket's table may hold.
BUCKET_BYTES = 16 * 1024 * 1024
#: Bits by which a bucket that does not fit is cut further.
MORE_BITS = 4
#: Most tasks of the exchange; a task works on its buckets one after another.
MAX_TASKS = 20_000


class ContentTable:
    """Open addressing with linear probing; entries are compared by their complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []

    def place(self, content: bytes, digest: bytes) -> int:
        """Number of the entry with this content, which is added if it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        at = self._probe(content, digest)
        if self.slots[at] < 0:
            self.slots[at] = len(self.contents)
            self.contents.append(content)
            self.digests.append(digest)
        return self.slots[at]

    def _probe(self, content: bytes | None, digest: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "big") & mask
        while (held := self.slots[at]) >= 0:
            if content is not None and self.digests[held] == digest and self.contents[held] == content:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        for number, digest in enumerate(self.digests):
            self.slots[self._probe(None, digest)] = number


def _contents(table: pa.Table, text: str) -> Iterator[tuple[bytes, bytes]]:
    offsets, raw = text_bytes(texts_of(table, text))
    low = raw.lower()  # of bytes: A-Z only
    ends = offsets.tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        content = low[a:b]
        yield content, hashlib.sha256(content).digest()


class _Best:
    """The row that stays in each group: the largest id, then the last place."""

    def __init__(self) -> None:
        self.keys: list[tuple] = []

    def offer(self, group: int, key: tuple) -> bool:
        if group == len(self.keys):
            self.keys.append(key)
            return True
        if key > self.keys[group]:
            self.keys[group] = key
            return True
        return False


def fold(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored slices: every row's place and its record, and on records the row that stays in the slice."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("pos", T.IntegerType()),
        T.StructField("record", T.IntegerType()), T.StructField("id", kind),
        T.StructField("n", T.LongType()), T.StructField("best", T.IntegerType()),
        T.StructField("best_id", kind), T.StructField("hash", T.LongType()),
        T.StructField("bytes", T.LongType()), T.StructField("row", docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table in steps(batches, "text", SLICE_BYTES):
            contents, best, size = ContentTable(), _Best(), table.num_rows
            ids = table.column("id").to_pylist()
            group, first = [], []
            for i, (content, digest) in enumerate(_contents(table, "text")):
                g = contents.place(content, digest)
                if g == len(first):
                    first.append(i)
                group.append(g)
                best.offer(g, (ids[i] is not None, ids[i], i))
            counts = np.bincount(group, minlength=len(first)).tolist()
            stays = [key[2] for key in best.keys]
            at_first = dict(zip(first, range(len(first))))

            def on_records(values: list) -> list:
                return [values[at_first[i]] if i in at_first else None for i in range(size)]

            picks = pa.array(on_records(stays), pa.int64())
            yield rows(schema, [
                [number] * size, range(size), [first[g] for g in group], table.column("id"),
                on_records(counts), on_records(stays), one_chunk(table.column("id")).take(picks),
                on_records([int.from_bytes(d[:8], "big", signed=True) for d in contents.digests]),
                on_records([len(c) for c in contents.contents]), one_chunk(table.column("row")).take(picks)])
            number += 1

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct("*").alias("row"))
    return settle(narrow.mapInArrow(trimmed(run), schema))


def _buckets(records: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Records with ``bucket``, cut until the distinct contents of each bucket fit ``limit``; tasks to use."""
    distinct = settle(records.groupBy("hash").agg(F.max("bytes").alias("bytes")))
    total = distinct.agg(F.sum("bytes")).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, 2 * total / limit))))
    tasks = min(MAX_TASKS, 1 << bits)

    def leading(n: int) -> Column:
        """The first ``n`` bits, marked by a one in front so that all depths differ."""
        return F.shiftrightunsigned("hash", 64 - n) + F.lit(1 << n)

    records = records.withColumn("bucket", leading(bits))
    distinct = distinct.withColumn("bucket", leading(bits))
    while bits + MORE_BITS < 63:
        sizes = distinct.groupBy("bucket").agg(F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("n"))
        full = settle(sizes.filter((F.col("size") > limit) & (F.col("n") > 1))
                      .select("bucket", F.lit(True).alias("cut")))
        if full.isEmpty():
            break
        bits += MORE_BITS
        finer = F.when(F.col("cut"), leading(bits)).otherwise(F.col("bucket"))
        records = attach(records, full, ["bucket"], settled=True).withColumn("bucket", finer).drop("cut")
        distinct = settle(attach(distinct, full, ["bucket"], settled=True)
                          .withColumn("bucket", finer).drop("cut").filter("bucket is not null"))
    return records, tasks


class _Bucket:
    """Records of one bucket in a table of complete contents."""

    def __init__(self, with_rows: bool) -> None:
        self.table, self.best, self.with_rows = ContentTable(), _Best(), with_rows
        self.counts: list[int] = []
        self.members: list[tuple[int, int, int]] = []
        self.held: list[pa.Array] = []
        self.where: list[int] = []
        self.rows_held = 0

    def add(self, part: pa.Table, text: str) -> None:
        columns = [part.column(c).to_pylist() for c in ("slice", "pos", "n", "best", "best_id")]
        improved: dict[int, int] = {}
        # the text of the row itself: the record's own row may differ from it in case only
        texts = pa.table({"text": one_chunk(part.column("row")).field(text)})
        for i, ((content, digest), at, pos, n, best, best_id) in enumerate(
                zip(_contents(texts, "text"), *columns, strict=True)):
            g = self.table.place(content, digest)
            if g == len(self.counts):
                self.counts.append(0)
                self.where.append(-1)
            self.counts[g] += n
            if self.best.offer(g, (best_id is not None, best_id, at, best)):
                improved[g] = i
            if not self.with_rows:
                self.members.append((at, pos, g))
        if self.with_rows:
            self.held.append(one_chunk(part.column("row")).take(pa.array(list(improved.values()), pa.int64())))
            for k, g in enumerate(improved):
                self.where[g] = self.rows_held + k
            self.rows_held += len(improved)

    def groups(self, schema: T.StructType) -> pa.RecordBatch:
        group = [g for _, _, g in self.members]
        keys = self.best.keys
        return rows(schema, [
            [m[0] for m in self.members], [m[1] for m in self.members],
            [keys[g][1] for g in group], [keys[g][2] for g in group], [keys[g][3] for g in group],
            [self.counts[g] for g in group], [self.table.digests[g].hex() for g in group]])

    def survivors(self, schema: T.StructType) -> pa.RecordBatch:
        kept = pa.concat_arrays(self.held).take(pa.array(self.where, pa.int64()))
        return rows(schema, kept.flatten())


def _resolve(folded: DataFrame, text: str, schema: T.StructType, with_rows: bool,
             bucket_bytes: int) -> DataFrame:
    records, tasks = _buckets(folded.filter(F.col("n").isNotNull()), bucket_bytes)
    columns = ["bucket", "slice", "pos", "n", "best", "best_id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield state.survivors(schema) if with_rows else state.groups(schema)

        for batch in batches:
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if buckets[a] != now:
                    yield from done()
                    now, state = buckets[a], _Bucket(with_rows)
                state.add(pa.Table.from_batches([batch.slice(a, b - a)]), text)
        yield from done()

    return (records.select(columns).repartition(tasks, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(trimmed(run), schema))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    folded = fold(docs, id_col, text)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("record", T.IntegerType()),
        T.StructField("keep_id", kind), T.StructField("keep_slice", T.LongType()),
        T.StructField("keep_pos", T.IntegerType()), T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType())])
    groups = _resolve(folded, text, schema, False, bucket_bytes)
    members = folded.select("slice", "record", F.col("id").alias(id_col), "pos")
    return members.join(groups, ["slice", "record"]).select(
        id_col, "keep_id", "group_size",
        ((F.col("slice") == F.col("keep_slice")) & (F.col("pos") == F.col("keep_pos"))).alias("kept"),
        "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were."""
    return _resolve(fold(docs, id_col, text), text, docs.schema, True, bucket_bytes)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the group of equal texts it belongs to."""
    return exact_groups(spark.read.parquet(f"{folder}/documents.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents)
"""
