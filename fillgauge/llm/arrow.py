"""Small Arrow and numpy helpers that run inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one step inside a task works on at a time.
STEP_BYTES = 2 * 1024 * 1024


def give_back() -> None:
    """Hand memory that is free inside this process back to the machine; tasks of later stages share it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc() -> ctypes.CDLL | None:
    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.malloc_trim  # noqa: B018 - only glibc has it
    except (OSError, AttributeError):
        return None
    return lib


_LIBC = _libc()


def trimmed(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``work`` of a task, which gives its memory back when it ends; Python workers outlive their tasks."""
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args)
        finally:
            give_back()

    return run


def one_chunk(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def texts_of(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A text column with NULL as the empty text, starting at offset 0."""
    column = one_chunk(batch.column(name)).cast(pa.string())
    return pa.concat_arrays([pc.fill_null(column, "")])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets and the bytes of a string array made by :func:`texts_of`."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset:]
    raw = data.to_pybytes() if data is not None else b""
    return ends - ends[0], raw[ends[0]:ends[-1]]


def with_bytes(offsets: np.ndarray, raw: bytes, kind: pa.DataType | None = None) -> pa.Array:
    """A string array over ``raw``, cut at ``offsets``."""
    kind = pa.string() if kind is None else kind
    return pa.Array.from_buffers(kind, len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(raw)])


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.Table]:
    """Regroup rows so that each table holds about ``limit`` bytes of text, and one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches([b for b in held if b.num_rows])
                held, size, start = [], 0, i
            size += n + 16
        held.append(batch.slice(start))
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return to_arrow_schema(T.StructType([T.StructField("x", kind)])).field(0).type


def rows(schema: T.StructType, columns: Sequence) -> pa.RecordBatch:
    """A batch with the types of ``schema``."""
    arrays = []
    for field, column in zip(schema, columns, strict=True):
        kind = arrow_type(field.dataType)
        if isinstance(column, (pa.Array, pa.ChunkedArray)):
            column = one_chunk(column)
            arrays.append(column if column.type == kind else column.cast(kind))
        else:
            arrays.append(pa.array(column, type=kind))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _zstd(raw: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32, compressed plane by plane."""
    planes = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T.copy()
    return len(numbers).to_bytes(8, "little") + _zstd(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(blob[8:], 4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return planes.reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def squeeze_codes(codes: np.ndarray) -> bytes:
    """Codes numbered by first appearance; a first appearance itself costs almost nothing."""
    seen = np.maximum.accumulate(codes) if len(codes) else codes
    fresh = np.concatenate([[True], seen[1:] > seen[:-1]])[:len(codes)]
    return squeeze(np.where(fresh, 0, codes + 1))


def unsqueeze_codes(blob: bytes) -> np.ndarray:
    stored = unsqueeze(blob)
    fresh = stored == 0
    return np.where(fresh, np.cumsum(fresh) - 1, stored - 1)


def squeeze_ascending(numbers: np.ndarray) -> bytes:
    return squeeze(np.diff(numbers, prepend=0))


def unsqueeze_ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob))


def squeeze_words(words: pa.Array) -> bytes:
    """A string or binary array, compressed."""
    offsets, raw = text_bytes(words)
    lengths = squeeze(np.diff(offsets))
    return (len(lengths).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + lengths
            + _zstd(raw, 9))


def unsqueeze_words(blob: bytes, kind: pa.DataType | None = None) -> pa.Array:
    cut, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    lengths = unsqueeze(blob[16:16 + cut])
    raw = pa.decompress(blob[16 + cut:], size, codec="zstd", asbytes=True) if size else b""
    return with_bytes(np.concatenate([[0], np.cumsum(lengths)]), raw, kind)
