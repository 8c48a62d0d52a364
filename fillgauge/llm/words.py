"""Blocks of documents with word dictionaries, and one global exchange of distinct words.

Exploding every word of a corpus into a row and shuffling it twice moves several
times the corpus.  Here each task folds the words of a block of documents first: a
block keeps the words' positions as codes, and only its distinct words travel.

1. :func:`build_blocks` cuts the documents, where they lie, into blocks of bounded
   text and writes one row per block: the documents' keys, the code of every word in
   order, and the block's distinct words, all compressed.
2. :func:`exchange_words` sends the distinct words of all blocks to buckets by hash.
   A bucket sees each word once per block at most, works its value out once, and
   sends one value per (block, word) back.
3. :func:`per_block` brings each block together with the values of its words.

Hot words cost one entry per block, all in one bucket, and a bucket is one Python process's: the
largest task grows with the number of blocks.  The number of buckets follows the bytes of text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import (arrow_type, give_back, one_chunk, rows, squeeze, squeeze_ascending, squeeze_codes,
                                 squeeze_words, steps, texts_of, trimmed, unsqueeze, unsqueeze_ascending,
                                 unsqueeze_codes, unsqueeze_words)
from fillgauge.session import settle

#: Bytes of text per block.
BLOCK_BYTES = 16 * 1024 * 1024
#: Bytes of text that are cut into words at a time.
STEP_BYTES = 2 * 1024 * 1024
#: Words of a block that are put back in order at a time.
PORTION_WORDS = 250_000
#: Bytes of text per bucket of the exchange; a bucket takes the distinct words that so much text has, on average.
BUCKET_BYTES = 12 * 1024 * 1024

#: Cuts a string array into a list array of words.
Split = Callable[[pa.Array], pa.Array]


class Blocks:
    """Rows of blocks: a stored table, or made again by each job that reads them."""

    def __init__(self, source: DataFrame, build: Callable, schema: T.StructType, stored: bool):
        self._source, self._build, self._schema = source, build, schema
        self.table = settle(source.mapInArrow(trimmed(build), schema)) if stored else None

    def select(self, *columns: str) -> DataFrame:
        held = self._source.mapInArrow(trimmed(self._build), self._schema) if self.table is None else self.table
        return held.select(*columns)

    def map(self, columns: Sequence[str], work: Callable, schema: T.StructType) -> DataFrame:
        """``work`` over batches that have these columns; one Python process per task, stored or not."""
        if self.table is not None:
            return self.table.select(*columns).mapInArrow(trimmed(work), schema)
        build = self._build
        return self._source.mapInArrow(trimmed(lambda batches: work(build(batches))), schema)


def build_blocks(docs: DataFrame, keys: Sequence[str], text: str, split: Split, *, marked: str | None = None,
                 stored: bool = True, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """One row per block of documents; NULL text counts as empty.

    ``marked`` names a boolean key; the words of those documents are counted apart.  With
    ``stored=False`` the blocks are made again whenever they are read: this needs less
    disk, and an input that gives the same rows in the same tasks each time, as files
    do.  If it does not, :func:`per_block` finds out and fails.
    """
    keys = list(keys)
    inner = T.StructType([docs.schema[k] for k in keys])
    kinds = {"block": T.LongType(), "docs": T.ArrayType(inner), "counts": T.BinaryType(),
             "codes": T.BinaryType(), "words": T.BinaryType(), "n_words": T.LongType(), "check": T.LongType(),
             "marks": T.BinaryType(), "n_marked": T.LongType(), "n_marked_docs": T.LongType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    element = arrow_type(inner)

    def block_row(number: int, parts: list[tuple]) -> pa.RecordBatch:
        held = pa.concat_arrays([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        words, places = distinct_words([p[3] for p in parts])
        codes = np.concatenate([at[p[2]] for p, at in zip(parts, places)])
        blob = squeeze_words(words)
        if marked is None:
            marks, n_marked, n_docs = b"", 0, 0
        else:
            chosen = held.field(marked).to_numpy(zero_copy_only=False).astype(bool)
            found = np.bincount(codes[np.repeat(chosen, counts)], minlength=len(words))
            marks, n_marked, n_docs = squeeze(found), int(found.sum()), int(chosen.sum())
        listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        return rows(schema, [[number], listed, [squeeze(counts)], [squeeze_codes(codes)], [blob], [len(words)],
                             [zlib.crc32(blob)], [marks], [n_marked], [n_docs]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for table in steps(batches, "__text", STEP_BYTES):
            texts = texts_of(table, "__text")
            lists = split(texts)
            coded = one_chunk(lists.flatten().dictionary_encode())
            kept = [one_chunk(table.column(k)).cast(element.field(k).type) for k in keys]
            size += texts.nbytes
            parts.append((pa.StructArray.from_arrays(kept, fields=list(element)),
                          np.diff(lists.offsets.to_numpy()), coded.indices.to_numpy(), coded.dictionary))
            if size + STEP_BYTES > block_bytes:
                yield block_row(number, parts)
                number, parts, size = number + 1, [], 0
                give_back()
        if parts:
            yield block_row(number, parts)

    return Blocks(docs.select(*keys, F.col(text).alias("__text")), build, schema, stored)


def bucket_count(docs: DataFrame, text: str) -> int:
    """Buckets for the words of these texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(8, math.ceil(size / BUCKET_BYTES))


def exchange_words(blocks: Blocks, buckets: int, work: Callable[..., list[bytes]], *,
                   mark: Callable[[bytes], bytes] = lambda word: word, counted: bool = False) -> DataFrame:
    """(block, check, codes, value): what ``work`` says of the words of each block.

    ``work`` gets the words that one bucket received, an array per block, and
    answers with one blob per array; if ``counted``, it also gets the marked counts.
    Words with equal ``mark`` share a bucket.
    """
    sent = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("check", T.LongType()),
        T.StructField("bucket", T.IntegerType()), T.StructField("codes", T.BinaryType()),
        T.StructField("words", T.BinaryType()), T.StructField("marks", T.BinaryType())])
    answer = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("check", T.LongType()),
        T.StructField("codes", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, check, blob, marks in zip(*(batch.column(c).to_pylist()
                                                   for c in ("block", "check", "words", "marks"))):
                words = unsqueeze_words(blob)
                home = np.array([zlib.crc32(mark(w)) % buckets for w in words.cast(pa.binary()).to_pylist()],
                                dtype=np.int64)
                order = np.argsort(home, kind="stable")
                ends = np.searchsorted(home[order], np.arange(buckets + 1))
                used = [b for b in range(buckets) if ends[b] < ends[b + 1]]
                picks = [order[ends[b]:ends[b + 1]] for b in used]
                counts = unsqueeze(marks) if counted else None
                yield rows(sent, [[block] * len(used), [check] * len(used), used,
                                  [squeeze_ascending(p) for p in picks],
                                  [squeeze_words(words.take(pa.array(p))) for p in picks],
                                  [squeeze(counts[p]) if counted else b"" for p in picks]])

    def receive(table: pa.Table) -> pa.Table:
        arrays = [unsqueeze_words(w) for w in table.column("words").to_pylist()]
        if counted:
            values = work(arrays, [unsqueeze(m) for m in table.column("marks").to_pylist()])
        else:
            values = work(arrays)
        columns = [table.column(c) for c in ("block", "check", "codes")]
        return pa.Table.from_batches([rows(answer, [*columns, values])])

    return (blocks.map(["block", "check", "words", "marks"], send, sent)
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(receive, answer))


def distinct_words(arrays: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of several arrays, and for each array where its words are among them."""
    coded = one_chunk(pa.chunked_array(arrays).combine_chunks()).dictionary_encode()
    places = coded.indices.to_numpy()
    ends = np.cumsum([0] + [len(a) for a in arrays])
    return coded.dictionary, [places[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Block:
    """A block's documents, codes and what came back for its words."""

    def __init__(self, block: pa.Table, answers: pa.Table):
        row = block.slice(0, 1).to_batches()[0]
        self.docs: pa.StructArray = row.column("docs").flatten()
        self.counts = unsqueeze(row.column("counts")[0].as_py())
        self.codes = unsqueeze_codes(row.column("codes")[0].as_py())
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.places = [unsqueeze_ascending(c) for c in answers.column("codes").to_pylist()]
        self.values: list[bytes] = answers.column("value").to_pylist()

    def per_word(self) -> np.ndarray:
        """For each code the place of its word among the answers, one after another."""
        places = np.concatenate(self.places) if self.places else np.zeros(0, dtype=np.int64)
        inverse = np.empty(len(places), dtype=np.int64)
        inverse[places] = np.arange(len(places))
        return inverse

    def key(self, name: str) -> pa.Array:
        return self.docs.field(name)

    def portions(self, words: int = PORTION_WORDS) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about so many words, or of one document."""
        first, n = 0, len(self.counts)
        while first < n or not n:
            after = int(np.searchsorted(self.offsets, self.offsets[first] + words, side="right")) - 1
            last = min(n, max(first + 1, after))
            yield first, last
            if last >= n:
                return
            first = last


def per_block(blocks: Blocks, answers: DataFrame, schema: T.StructType,
              work: Callable[[Block], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply ``work`` to every block with its answers; it answers in batches."""
    def both(block: pa.Table, values: pa.Table) -> pa.Table:
        held = pc.sum(pc.binary_length(values.column("codes"))).as_py() if values.num_rows else 0
        if not block.num_rows or block.column("n_words")[0].as_py() and not held:
            raise RuntimeError("the input changed while it was read; store it first")
        return pa.Table.from_batches(list(work(Block(block, values))))

    slim = blocks.select("block", "check", "n_words", "docs", "counts", "codes")
    return slim.groupBy("block", "check").cogroup(answers.groupBy("block", "check")).applyInArrow(both, schema)


def pack_lists(lists: pa.ListArray) -> bytes:
    """Lists of small non-negative numbers, compressed."""
    ends = lists.offsets.to_numpy()
    counts = squeeze(np.diff(ends))
    return len(counts).to_bytes(8, "little") + counts + squeeze(lists.flatten().to_numpy())


def unpack_lists(blobs: list[bytes]) -> pa.ListArray:
    counts, values = [], []
    for blob in blobs:
        cut = int.from_bytes(blob[:8], "little")
        counts.append(unsqueeze(blob[8:8 + cut]))
        values.append(unsqueeze(blob[8 + cut:]))
    lengths = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def ascii_words(texts: pa.Array) -> pa.Array:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = before[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(pa.array(full)))
