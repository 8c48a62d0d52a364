"""Best-fit decreasing packing of documents into windows of equal size.

Best fit decreasing needs of the pieces only how many there are of each length: all
pieces of one length are alike.  So the lengths are counted in Spark, the plan is
made from at most ``capacity`` counts, and every row then looks its place up.  The
plan is the one that placing piece by piece would give: the longest first, each into
the open window with the least room that still holds it, found in a segment tree
indexed by remaining capacity.  Windows with equal room are kept as runs, so neither
the time nor the size of the plan grows with the number of pieces.  A very long text is encoded whole, in
one task, and cut into full windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import rows, trimmed
from fillgauge.llm.bpe import token_runs
from fillgauge.llm.words import (Block, ascii_words, bucket_count, build_blocks, distinct_words, exchange_words,
                                 pack_lists, per_block)
from fillgauge.session import settle


#: Bytes of text per block of documents, and words that are encoded at a time.
BLOCK_BYTES = 8 * 1024 * 1024
AT_ONCE = 25_000


class OpenWindows:
    """Segment tree over remaining capacities; a leaf holds the runs of windows with that room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, count: int) -> None:
        node = room + self.width
        while node:
            self.open[node] += count
            node >>= 1

    def put(self, room: int, first: int, count: int) -> None:
        """Windows ``first .. first + count - 1`` have ``room`` left."""
        if count:
            self.runs[room].append((first, count))
            self._add(room, count)

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.runs[room].pop()
        self._add(room, -count)
        return first, count

    def tightest(self, need: int) -> int | None:
        """Least room of an open window that is at least ``need``."""
        node = need + self.width
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_plan(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first window, pieces per window, first offset), ordered.

    Pieces of a length are ranked from 0; the piece of rank r in a row's run goes to
    window ``first + (r - first rank) // per`` and starts
    ``(r - first rank) % per * length`` behind the first offset.
    """
    tree, plan, windows = OpenWindows(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a window of {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, opened = capacity, -(-left // (capacity // length))
                tree.put(room, windows, opened)
                windows += opened
            first, count = tree.take(room)
            per = room // length
            full = min(count, left // per)
            if full:
                plan.append((length, rank, first, per, capacity - room))
                tree.put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < count and 0 < left < per:
                plan.append((length, rank, first + full, left, capacity - room))
                tree.put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            tree.put(room, first + full, count - full)
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = 4096,
         order: Sequence[str] = ()) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0) and ``offset`` inside the sequence to every piece.

    Pieces with a NULL length or one below 1 need no room and get NULL for both; one
    above ``capacity`` is an error.  Repeated rows are pieces of their own.  Columns of
    the two names are replaced.  Pieces of one length are ranked per slice of the
    stored rows (the task that wrote them), in the order given, so a length that many
    pieces have is spread over all slices.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    stored = settle(pieces.select(
        *[F.col(c) for c in names], F.spark_partition_id().alias("__slice"),
        F.when(F.col(length) > 0, F.col(length).cast("long")).alias("__size")))
    counts = settle(stored.filter(F.col("__size").isNotNull())
                    .groupBy("__size", "__slice").agg(F.count(F.lit(1)).alias("__n")))
    totals = {r["__size"]: r["n"] for r in
              counts.groupBy("__size").agg(F.sum("__n").alias("n"))
              .filter(F.col("__size") <= capacity).collect()}
    largest = counts.agg(F.max("__size")).first()[0]
    if largest is not None and largest > capacity:
        raise ValueError(f"a piece of {largest} does not fit a window of {capacity}")
    plan = best_fit_plan(totals, capacity)
    starts = (plan[:, 0] << 44) + plan[:, 1]

    earlier = Window.partitionBy("__size").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__size", "__slice",
                           F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__size", "__slice").orderBy(*[F.col(c) for c in order] or [F.lit(0)])
    ranked = (stored.withColumn("__row", F.row_number().over(inside))
              .join(before.hint("merge"), ["__size", "__slice"], "left")  # grows with the slices
              .withColumn("__rank", F.col("__before") + F.col("__row") - 1))
    schema = T.StructType([pieces.schema[c] for c in names]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("__size").to_numpy(zero_copy_only=False)
            none = np.isnan(size.astype(float))
            size = np.where(none, 0, size).astype(np.int64)
            rank = np.where(none, 0, batch.column("__rank").to_numpy(zero_copy_only=False)).astype(np.int64)
            if len(plan):
                run = plan[np.maximum(np.searchsorted(starts, (size << 44) + rank, side="right") - 1, 0)]
                step, rest = np.divmod(rank - run[:, 1], run[:, 3])
                sequence, offset = run[:, 2] + step, run[:, 4] + rest * size
            else:
                sequence = offset = np.zeros(len(size), dtype=np.int64)
            yield rows(schema, [*[batch.column(c) for c in names],
                                pa.array(sequence, mask=none), pa.array(offset, mask=none)])

    return ranked.select(*names, "__size", "__rank").mapInArrow(trimmed(place), schema)


@lru_cache(maxsize=1)
def _tokenizer(raw: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw)


def _stem(word: str) -> tuple[str, str]:
    """A word as letters in lower case and the stops behind them, if it is made like that.

    The tokenizer lower-cases, and cuts between letters and stops, so both parts are
    encoded apart.  Only letters that are composed already are handled here.
    """
    letters = word.rstrip(".,")
    if letters.isalpha() and max(letters) < "\u0250":
        return letters.lower(), word[len(letters):]
    return word, ""


def token_pieces(docs: DataFrame, tokenizer_file: str, *, keys: Sequence[str] = ("doc_id",), text: str = "text",
                 end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """(keys, start, length, ids, doc_tokens): the ids of each text and ``end_id``, cut into full windows.

    ``ids`` are little-endian 32-bit numbers.  NULL text counts as empty: its document
    is ``end_id`` alone.  The last piece of a document may be shorter than a window.
    Repeated rows are documents of their own; other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())  # a vocabulary, not corpus data
    blocks = build_blocks(docs, keys, text, ascii_words, block_bytes=BLOCK_BYTES)

    def encoded(words: list[str]) -> list[list[int]]:
        parts = [_stem(w) for w in words]
        known = list(dict.fromkeys(p for pair in parts for p in pair if p))
        found = _tokenizer(raw.value).encode_batch_fast(known, add_special_tokens=False)
        ids = {p: e.ids for p, e in zip(known, found)} | {"": []}
        return [ids[a] + ids[b] if b else ids[a] for a, b in parts]

    def ids_of(arrays: list[pa.Array]) -> list[bytes]:
        words, places = distinct_words(arrays)
        kind = pa.list_(pa.int32())
        lists = pa.concat_arrays([pa.array([], kind)] + [
            pa.array(encoded(words.slice(a, AT_ONCE).to_pylist()), kind) for a in range(0, len(words), AT_ONCE)])
        return [pack_lists(lists.take(pa.array(p))) for p in places]

    schema = T.StructType([docs.schema[k] for k in keys] + [
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])

    def cut(block: Block) -> Iterator[pa.RecordBatch]:
        for first, _, ids, ends in token_runs(block):
            raw_ids, tail = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
            who, start, length, body, total = [], [], [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                n = b - a + 1
                own = raw_ids[4 * a:4 * b] + tail
                for s in range(0, n, capacity):
                    size = min(capacity, n - s)
                    who.append(first + i)
                    start.append(s)
                    length.append(size)
                    body.append(own[4 * s:4 * (s + size)])
                    total.append(n)
            yield rows(schema, [*[block.key(k).take(pa.array(who, pa.int64())) for k in keys],
                                start, length, body, total])

    # a word's parts are encoded in one bucket, whatever its case and stops are
    answers = exchange_words(blocks, bucket_count(docs, text), ids_of, mark=lambda w: w.rstrip(b".,").lower())
    return per_block(blocks, answers, schema, cut)


def windows(packed: DataFrame, *, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, used, ids): the filled windows, padded to ``capacity``, from packed pieces with ``ids``.

    A group here is one window, which ``capacity`` bounds.
    """
    joined = (packed.filter(F.col("sequence_id").isNotNull()).groupBy("sequence_id")
              .agg(F.sum("length").alias("used"),
                   F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (capacity - F.col("used")).cast("int")))
    body = F.aggregate("parts", F.unhex(F.lit("")), lambda held, part: F.concat(held, part["ids"]))
    return joined.select("sequence_id", "used", F.concat(body, pad).alias("ids"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096) -> DataFrame:
    """Where every piece of every document lies, with a checksum of its ids."""
    cut = token_pieces(docs, tokenizer_file, capacity=capacity)
    told = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(told, capacity=capacity, order=["doc_id", "start"])
