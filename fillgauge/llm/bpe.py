"""Byte-level BPE: encode by one global exchange of distinct words, decode by the token table.

A text is cut before every space that starts a new match of the pattern, so a word
here holds whole matches of it and is encoded the same wherever it stands.  Words
and their positions stay in the block of their document; each distinct word crosses
the network once per block, is encoded once in the corpus, and its ids come back to
the positions (:mod:`fillgauge.llm.words`).

A very long text makes a block of its own.  NULL text counts as empty and has no ids.  Repeated rows are encoded one by one.
Other columns than keys and text are not read, whatever their names are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import one_chunk, rows, trimmed, with_bytes
from fillgauge.llm.words import (Block, bucket_count, build_blocks, distinct_words, exchange_words, pack_lists,
                                 per_block, unpack_lists)

#: White space of the pattern's ``\s`` (fixed values: the Unicode property White_Space).
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


DECODED = [T.StructField("decoded", T.BinaryType()), T.StructField("ids_le", T.BinaryType())]
#: Words that are Python objects at a time.
AT_ONCE = 50_000


class Ranks:
    """A rank file and its split pattern, as tasks need them."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.raw = spark.sparkContext.broadcast(f.read())  # a vocabulary, not corpus data
        self.pattern = pattern

    def encoder(self):
        return _encoder(self.raw.value, self.pattern)

    def token_bytes(self) -> pa.Array:
        return _token_bytes(self.raw.value)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """token -> id of a rank file: base64 text and number on each line."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(raw), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> pa.Array:
    """Bytes by id, and an empty entry behind the last."""
    ranks = read_ranks(raw)
    table = [b""] * (max(ranks.values(), default=-1) + 2)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def match_words(pattern: str):
    """Split for the exchange: words that hold whole matches of ``pattern``.

    A match can begin at a space, and then always does unless white space stands on
    both sides of it (or before it and the text ends): only inside longer runs of white
    space does the pattern look across a space.  Texts with such runs are cut by the
    pattern itself.
    """
    tangled = f"[{WHITE}] (?:[{WHITE}]|$)"
    compiled = regex.compile(pattern)

    def split(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        flat = one_chunk(lists.flatten())
        first = np.zeros(len(flat), dtype=bool)
        first[lists.offsets.to_numpy()[:-1]] = True
        spaced = pc.binary_join_element_wise(pa.scalar(""), flat, pa.scalar(" "))
        lists = pa.ListArray.from_arrays(lists.offsets, pc.if_else(pa.array(first), flat, spaced))
        odd = np.flatnonzero(pc.match_substring_regex(texts, tangled).to_numpy(zero_copy_only=False))
        if not len(odd):
            return lists
        exact = [[m.group() for m in compiled.finditer(t)] for t in texts.take(pa.array(odd)).to_pylist()]
        place = np.arange(len(lists))
        place[odd] = len(lists) + np.arange(len(odd))
        return pa.concat_arrays([lists, pa.array(exact, lists.type)]).take(pa.array(place))

    return split


def encode(docs: DataFrame, ranks: Ranks, *, keys: Sequence[str] = ("doc_id",), text: str = "text",
           decoded: bool = False) -> DataFrame:
    """(keys, token_ids): the ids of every whole text, each match of the pattern encoded apart.

    With ``decoded`` also what :func:`decode` adds, in the same pass.
    """
    blocks = build_blocks(docs, keys, text, match_words(ranks.pattern), stored=False)

    def ids_of(arrays: list[pa.Array]) -> list[bytes]:
        words, places = distinct_words(arrays)
        encode_word = ranks.encoder().encode_ordinary
        kind = pa.list_(pa.int32())
        lists = pa.concat_arrays([pa.array([], kind)] + [
            pa.array([encode_word(w) for w in words.slice(a, AT_ONCE).to_pylist()], kind)
            for a in range(0, len(words), AT_ONCE)])
        return [pack_lists(lists.take(pa.array(p))) for p in places]

    schema = T.StructType([docs.schema[k] for k in keys]
                          + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] + DECODED * decoded)

    def join_back(block: Block) -> Iterator[pa.RecordBatch]:
        for first, last, ids, ends in token_runs(block):
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            more = _decoded(lists, ranks.token_bytes()) if decoded else []
            yield rows(schema, [*[block.key(k).slice(first, last - first) for k in keys], lists, *more])

    return per_block(blocks, exchange_words(blocks, bucket_count(docs, text), ids_of), schema, join_back)


def token_runs(block: Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For portions of a block's documents: their ids in order, and where each document's begin and end."""
    of_word = unpack_lists(block.values).take(pa.array(block.per_word()))
    for first, last in block.portions():
        at, to = block.offsets[first], block.offsets[last]
        in_order = of_word.take(pa.array(block.codes[at:to]))
        before = in_order.offsets.to_numpy()
        yield first, last, in_order.flatten().to_numpy(), before[block.offsets[first:last + 1] - at]


def _decoded(lists: pa.ListArray, table: pa.Array) -> list[pa.Array]:
    """The bytes of each list of ids by the token table, and the ids as little-endian numbers."""
    missing = pa.array(pc.is_null(lists).to_numpy(zero_copy_only=False))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    known = np.where((flat >= 0) & (flat < len(table) - 1), flat, len(table) - 1)
    pieces = table.take(pa.array(known))
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(pieces) + 1)
    raw = data.to_pybytes() if data is not None else b""
    found = with_bytes(at[ends], raw, pa.binary()), with_bytes(ends * 4, flat.astype("<u4").tobytes(), pa.binary())
    return [pc.if_else(missing, None, c) for c in found]


def decode(encoded: DataFrame, ranks: Ranks, *, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (the bytes of the ids) and ``ids_le`` (the ids as little-endian 32-bit numbers).

    The token table has a fixed size and lies with every task.  Ids that it lacks add
    no bytes; NULL ids give NULL.  Columns of these two names are replaced.
    """
    keep = [c for c in encoded.columns if c not in ("decoded", "ids_le")]
    schema = T.StructType([encoded.schema[c] for c in keep] + DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.token_bytes()
        for batch in batches:
            yield rows(schema, [*[batch.column(c) for c in keep], *_decoded(batch.column(ids), table)])

    return encoded.select(*keep).mapInArrow(trimmed(run), schema)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    ranks = Ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return encode(docs, ranks, decoded=True).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
