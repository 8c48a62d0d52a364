"""Language of documents by hyperdimensional profiles.

Every letter has a random vector of signs.  A group of three letters is bound into one
vector: the first letter's rotated twice, the second's once, multiplied by the third's.
The profile of a text is the sum of the vectors of all its groups; the prototype of a
language is the sum over its training texts.  A text has the language whose prototype
makes the largest cosine with its profile.

Repeated rows are answered one by one, and each teaches.  A very long text is read whole, in one
step of one task; the step holds some 50 bytes per byte of it.

Signs come from the code point and a seed, so every task makes the same vectors.
Prototypes are sums of whole numbers, added up over the partitions, so they do not
depend on how rows are spread.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import rows, steps, text_bytes, texts_of, trimmed

#: Length of the vectors.
DIMENSIONS = 512
#: Bytes of text whose groups are counted at a time.
STEP_BYTES = 512 * 1024
#: Most languages: their prototypes lie with every task.
MAX_LANGUAGES = 10_000
#: Share of the labelled texts that may score less than what counts as like a language.
REJECTED_SHARE = 0.002
#: What counts lies at least so many standard deviations above the cosine of unrelated vectors.
NOISE_WIDTHS = 3.0
#: Cells of scores from 0 to 1 that are counted to find that share.
SCORE_CELLS = 10_000
#: Answer for texts without a letter.
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


@lru_cache(maxsize=100_000)
def _signs(code_point: int, seed: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng([seed, code_point]).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)


class Groups:
    """Groups of three letters of several texts: the vectors of the distinct ones, and where they occur.

    Texts are lower-cased; every stretch of other characters, and each end of the text,
    is one gap.  The middle of a group is a letter, its sides may be gaps.
    """

    def __init__(self, texts: pa.Array, seed: int, dimensions: int):
        lowered = pa.concat_arrays([pc.utf8_lower(texts)])
        points = np.frombuffer(text_bytes(lowered)[1].decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lengths = pc.utf8_length(lowered).to_numpy()
        doc = np.repeat(np.arange(len(texts)), lengths + 2)
        padded = np.zeros(len(points) + 2 * len(texts), dtype=np.int64)
        padded[np.arange(len(points)) + 2 * np.repeat(np.arange(len(texts)), lengths) + 1] = (
            np.where(_letters()[points], points, 0))
        kept = padded != 0
        kept |= np.concatenate([[True], padded[:-1] != 0]) | np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)]
        padded, doc = padded[kept], doc[kept]

        present = np.flatnonzero(np.bincount(padded)) if len(padded) else np.zeros(0, dtype=np.int64)
        place = np.zeros(int(present[-1]) + 1 if len(present) else 1, dtype=np.int64)
        place[present] = np.arange(len(present))
        small, base = place[padded], max(1, len(present))
        middle = np.flatnonzero((padded[1:-1] != 0)) + 1
        group = (small[middle - 1] * base + small[middle]) * base + small[middle + 1]
        self.doc = doc[middle]
        if base ** 3 <= 1 << 20:
            distinct = np.flatnonzero(np.bincount(group)) if len(group) else group
            index = np.zeros(base ** 3, dtype=np.int32)
            index[distinct] = np.arange(len(distinct))
            self.group = index[group]
        else:
            distinct, self.group = np.unique(group, return_inverse=True)
        signs = np.stack([_signs(int(c), seed, dimensions) for c in present]) if len(present) else (
            np.zeros((0, dimensions), dtype=np.int8))
        first, second, third = distinct // base ** 2, distinct // base % base, distinct % base
        self.vectors = np.roll(signs, 2, axis=1)[first] * np.roll(signs, 1, axis=1)[second] * signs[third]
        self.ends = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def profiles(self) -> Iterator[np.ndarray | None]:
        """The profile of each text in turn; None without letters."""
        vectors = self.vectors.astype(np.float32)
        for a, b in zip(self.ends[:-1], self.ends[1:]):
            if a == b:
                yield None
                continue
            counts = np.bincount(self.group[a:b])
            used = np.flatnonzero(counts)
            yield counts[used].astype(np.float32) @ vectors[used]

    def summed(self, part: np.ndarray, parts: int) -> np.ndarray:
        """Sum of the profiles of the texts of each part; part -1 is left out."""
        of = part[self.doc]
        used = of >= 0
        width = max(1, len(self.vectors))
        counts = np.bincount(of[used] * width + self.group[used], minlength=parts * width).reshape(parts, width)
        return counts[:, :len(self.vectors)] @ self.vectors.astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    prototypes: np.ndarray
    seed: int

    def unit_prototypes(self) -> np.ndarray:
        length = np.linalg.norm(self.prototypes, axis=1, keepdims=True)
        return (self.prototypes / np.where(length > 0, length, 1)).astype(np.float32)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", seed: int = 17,
        dimensions: int = DIMENSIONS) -> LanguageModel:
    """Prototypes of all languages that occur, from every row with a text and a language."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("profile", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for table in steps(batches, "text", STEP_BYTES):
            coded = table.column("lang").combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            names = coded.dictionary.to_pylist()
            found = Groups(texts_of(table, "text"), seed, dimensions).summed(
                coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names))
            for name, profile in zip(names, found):
                sums[name] = sums.get(name, 0) + profile
        yield rows(schema, [list(sums), [p.tolist() for p in sums.values()]])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    summed = (labelled.mapInArrow(trimmed(run), schema).select("lang", F.posexplode("profile").alias("at", "value"))
              .groupBy("lang", "at").agg(F.sum("value").alias("value"))
              .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("profile"))
              .select("lang", "profile.value").orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(summed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    prototypes = np.array([r["value"] for r in summed], dtype=float).reshape(len(summed), dimensions)
    return LanguageModel([r["lang"] for r in summed], prototypes, seed)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``score`` is the cosine with the prototype of the language, 0 if it is negative.  A text
    that is NULL or has no letter is ``und`` with score 0; so is every text if nothing
    was learned.  Of equally near languages the first by name is taken.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    prototypes, languages, seed = model.unit_prototypes(), model.languages, model.seed
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, text, STEP_BYTES):
            predicted, score = [], []
            for profile in Groups(texts_of(table, text), seed, dimensions).profiles():
                if profile is None or not languages:
                    predicted.append(UNKNOWN)
                    score.append(0.0)
                    continue
                near = prototypes @ profile / max(float(np.linalg.norm(profile)), 1e-30)
                best = int(np.argmax(near))
                predicted.append(languages[best])
                score.append(min(1.0, max(0.0, float(near[best]))))
            yield rows(schema, [*[table.column(c) for c in keep], predicted, score])

    return docs.select(*keep).mapInArrow(trimmed(run), schema)


def least_score(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang: str = "lang",
                share: float = REJECTED_SHARE) -> float:
    """The score from which a text is like a learned language.

    ``share`` of all labelled texts that are given their own language score less; but it is never
    within the reach of unrelated vectors, whose cosines have a deviation of 1/sqrt(dimensions).
    Without a column ``lang`` that is all that is known.
    """
    noise = NOISE_WIDTHS / math.sqrt(model.prototypes.shape[1])
    if lang not in docs.columns:
        return noise
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("own")).dropna()
    cell = F.floor(F.col("score") * SCORE_CELLS).cast("int").alias("cell")
    counts = dict(identify(labelled, model).filter("lang_pred = own").groupBy(cell).count().collect())  # SCORE_CELLS at most
    low, seen, total = 0, 0, sum(counts.values())
    for c in sorted(counts):
        seen += counts[c]
        low = c
        if seen > share * total:
            break
    return max(noise, low / SCORE_CELLS)


def keep_known(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang: str = "lang",
               least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known with ``least`` score or more, columns as they were.

    ``least`` is :func:`least_score` unless given.  Rejected are texts without a letter, NULL ones among them,
    and texts like no language that was learned, as those in other scripts or of random
    letters.  Equal texts share their fate.  If nothing was learned nothing is known, and every row goes.
    """
    least = least_score(docs, model, text=text, lang=lang) if least is None else least
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return identify(held, model).filter(known).select("row.*")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of training; a NULL id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
