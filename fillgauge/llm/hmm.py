"""Scores of texts under a hidden Markov language model.

Tokens are words in lower case (A-Z only) and one end per text.  A token belongs to a
class: frequent tokens by a hash of the whole token, others by a hash of their last
letters.  The model moves between hidden states, each state emits a class, and a class
emits a token in proportion to its count.  The probability of a text is the sum over all
ways through the states, by the forward recursion with scaling, and is exact; over all
texts of a length the probabilities of known and unknown tokens add up to one.

1. Every task folds a block of documents to word codes; each block sends its distinct
   words with their training counts through one exchange, which adds the counts up
   over all blocks and sends the sums back (:mod:`fillgauge.llm.words`).  So the
   vocabulary lies spread over the cluster, whatever its size.
2. With the counts, each block is rewritten as sequences of classes.
3. Every round of Baum-Welch reads all training texts in blocks, runs forward and
   backward over many texts at a time, and adds the expected counts up over the
   partitions.  What meets in one place is the model itself: states x (states + classes)
   numbers.

A very long text lies in one task, as the numbers of its classes; forward values are held for a
bounded stretch of it, and computed again on the way back.
NULL text counts as empty and has the end alone.  Repeated rows are scored one by one and
each is counted in training.  Other columns than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import rows, squeeze, text_bytes, trimmed, unsqueeze, with_bytes
from fillgauge.llm.words import (Block, ascii_words, bucket_count, build_blocks, distinct_words, exchange_words,
                                 per_block)
from fillgauge.session import settle

#: Hidden states.
STATES = 8
#: Classes of frequent tokens, and of others by their last letters.
FREQUENT_CLASSES = 1024
ENDING_CLASSES = 1024
#: A token is frequent from this share of all training tokens on.
FREQUENT_SHARE = 1 / 8192
#: Bytes that make up an ending.
ENDING = 3
#: Baum-Welch ends when a round raises the logarithm of the likelihood by less than this share, or after so many rounds.
TOLERANCE = 2e-3
ROUNDS = 20
#: Tokens whose forward and backward values one step inside a task holds.
BATCH_TOKENS = 1_000_000
#: Tokens whose forward values are held at a time; longer texts are run forward twice.
STRETCH_TOKENS = 2_000_000
#: Class of the end of a text.
END_CLASS = FREQUENT_CLASSES + ENDING_CLASSES
CLASSES = END_CLASS + 1


def lower_words(texts: pa.Array) -> pa.Array:
    """Words of each text, A-Z lower-cased."""
    offsets, raw = text_bytes(texts)
    return ascii_words(with_bytes(offsets, raw.lower()))


def class_of(word: bytes, frequent: bool) -> int:
    if frequent:
        return zlib.crc32(word) % FREQUENT_CLASSES
    return FREQUENT_CLASSES + zlib.crc32(word[-ENDING:]) % ENDING_CLASSES


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    #: rounds of Baum-Welch it took
    rounds: int = 0

    @classmethod
    def begin(cls, class_counts: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        """Emissions near the class shares, disturbed so that the states differ; states that tend to stay."""
        noise = np.random.default_rng(seed).uniform(0.5, 1.5, (states, len(class_counts)))
        emit = (class_counts + 0.5) * noise
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


class Batch:
    """Sequences of classes, longest first, so that at each step the running ones come first."""

    def __init__(self, classes: np.ndarray, ends: np.ndarray):
        lengths = np.diff(ends)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.first = ends[:-1][self.order]
        self.classes = classes
        #: how many sequences have a token at each step
        self.running = np.searchsorted(-self.lengths, -np.arange(self.lengths[0] if len(lengths) else 0), side="left")

    def at(self, step: int) -> np.ndarray:
        return self.classes[self.first[:self.running[step]] + step]


def log10_forward(batch: Batch, model: Model) -> np.ndarray:
    """log10 probability of each class sequence, in the order the sequences came."""
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(batch.order))
    state = np.repeat(model.start[None, :], len(batch.order), axis=0)
    for step, n in enumerate(batch.running.tolist()):
        state = (state[:n] if step == 0 else state[:n] @ model.move) * emit[batch.at(step)]
        scale = state.sum(1)
        state /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty_like(total)
    out[batch.order] = total
    return out


def expected_counts(batch: Batch, model: Model) -> np.ndarray:
    """Expected starts, moves and emissions of the sequences, as one matrix: states x (1 + states + classes)."""
    return _expect(batch, model)[0]


def _expect(batch: Batch, model: Model) -> tuple[np.ndarray, float]:
    """The expected counts, and the natural logarithm of the sequences' probability.

    Forward values are held for one stretch of steps at a time.  A first pass keeps the states
    between stretches only; going back, each stretch is run forward again and then backward.
    Emissions are counted once per stretch.
    """
    states, classes = model.emit.shape
    emit = np.ascontiguousarray(model.emit.T)
    sums, likelihood = np.zeros((states, 1 + states + classes)), 0.0
    stretches = _stretches(batch.running)
    state, begins = np.repeat(model.start[None, :], len(batch.order), axis=0), []
    for first, last in stretches[:-1]:
        begins.append(state)
        for step in range(first, last):
            n = batch.running[step]
            state = (state[:n] if step == 0 else state[:n] @ model.move) * emit[batch.at(step)]
            state = state / state.sum(1)[:, None]
    begins.append(state)
    later = None
    for (first, last), state in zip(reversed(stretches), reversed(begins)):
        ends = np.concatenate([[0], np.cumsum(batch.running[first:last])])
        held = np.empty((ends[-1], states), dtype=np.float32)
        seen, scales = np.empty(ends[-1], dtype=np.int64), np.empty(ends[-1])
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            seen[a:b] = batch.at(first + i)
            state = (state[:b - a] if first + i == 0 else state[:b - a] @ model.move) * emit[seen[a:b]]
            scale = state.sum(1)
            state = state / scale[:, None]
            held[a:b], scales[a:b] = state, scale
        likelihood += float(np.log(scales).sum())
        for i in range(last - first - 1, -1, -1):
            a, b = ends[i], ends[i + 1]
            back = np.ones((b - a, states))
            if later is not None:
                m = len(later)
                back[:m] = later @ model.move.T
                sums[:, 1:1 + states] += model.move * (held[a:a + m].T.astype(float) @ later)
            own = held[a:b] * back
            own /= own.sum(1, keepdims=True)
            held[a:b] = own
            if first + i == 0:
                sums[:, 0] = own.sum(0)
            later = back * emit[seen[a:b]] / scales[a:b, None]
        for k in range(states):
            sums[k, 1 + states:] += np.bincount(seen, weights=held[:, k], minlength=classes)
    return sums, likelihood


def _stretches(running: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of steps with at most ``STRETCH_TOKENS`` tokens, or of one step."""
    ends = np.concatenate([[0], np.cumsum(running)])
    out, first = [], 0
    while first < len(running):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STRETCH_TOKENS, side="right")) - 1)
        out.append((first, last))
        first = last
    return out


def improved(sums: np.ndarray) -> Model:
    """The model of the expected counts, with a little added everywhere so that nothing is impossible."""
    states = len(sums)
    start = sums[:, 0] + 1e-3
    move = sums[:, 1:1 + states] + 1e-3
    emit = sums[:, 1 + states:] + 1e-2
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


_SEQUENCES = ("n_tokens", "classes", "n_known", "base", "inside", "train")


@dataclass
class Corpus:
    """Blocks of class sequences, and what the training tokens add up to."""

    blocks: DataFrame
    tokens: int
    distinct: int
    class_tokens: np.ndarray


def _counts_of(arrays: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    words, places = distinct_words(arrays)
    total = np.zeros(len(words), dtype=np.int64)
    for at, n in zip(places, counts):
        np.add.at(total, at, n)
    return words, total, places


def prepare(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text: str = "text") -> Corpus:
    """Count all training tokens and rewrite every text as a sequence of classes."""
    flagged = docs.select(id_col, text, F.coalesce(train, F.lit(False)).alias("__train"))
    blocks = build_blocks(flagged, [id_col, "__train"], text, lower_words, marked="__train")
    ends = blocks.select("n_marked", "n_marked_docs").agg(F.sum("n_marked"), F.sum("n_marked_docs")).first()
    tokens, documents = int((ends[0] or 0) + (ends[1] or 0)), int(ends[1] or 0)
    frequent = max(1.0, tokens * FREQUENT_SHARE)

    def sums(arrays: list[pa.Array], counts: list[np.ndarray]) -> list[bytes]:
        words, total, places = _counts_of(arrays, counts)
        kinds = np.array([class_of(w, n >= frequent) for w, n in
                          zip(words.cast(pa.binary()).to_pylist(), total.tolist())], dtype=np.int64)
        held = np.bincount(kinds, weights=total, minlength=CLASSES).astype(np.int64)
        distinct = np.bincount(kinds, weights=total > 0, minlength=CLASSES).astype(np.int64)
        # what the bucket holds as a whole goes with its first answer
        whole = [_pair(squeeze(held), squeeze(distinct))] + [b""] * (len(places) - 1)
        return [_pair(squeeze(total[p]), squeeze(kinds[p]), extra) for p, extra in zip(places, whole)]

    answers = settle(exchange_words(blocks, bucket_count(docs, text), sums, counted=True))
    class_tokens, class_distinct = _class_totals(answers)
    class_tokens[END_CLASS], class_distinct[END_CLASS] = documents, min(1, documents)
    distinct = int(class_distinct.sum())
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
                           *[T.StructField(n, T.BinaryType()) for n in _SEQUENCES]])

    def rewrite(block: Block) -> Iterator[pa.RecordBatch]:
        places = block.per_word()
        parts = [_unpair(v) for v in block.values]
        count = np.concatenate([p[0] for p in parts] or [places])[places]
        kind = np.concatenate([p[1] for p in parts] or [places])[places]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))
        inside = np.log10((count + 0.5) / (class_tokens[kind] + 0.5 * (class_distinct[kind] + 1)))
        n = len(block.counts)
        last = block.offsets[1:] + np.arange(n)  # where the ends come, one behind each text
        classes = np.full(len(block.codes) + n, END_CLASS)
        words = np.ones(len(classes), dtype=bool)
        words[last] = False
        classes[words] = kind[block.codes]
        end = [math.log10((documents + 0.5) / (total + 0.5 * (kinds + 1)))
               for total, kinds in ((tokens, distinct), (documents, class_distinct[END_CLASS]))]

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.array([math.fsum(values[a:b].tolist()) for a, b in zip(block.offsets[:-1], block.offsets[1:])])

        known = np.diff(np.concatenate([[0], np.cumsum(count[block.codes] > 0)])[block.offsets]) + (documents > 0)
        numbers = [per_text(values[block.codes]) + e for values, e in zip((base, inside), end)]
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), block.key(id_col))
        yield rows(schema, [
            ids, [squeeze(block.counts + 1)], [squeeze(classes)], [squeeze(known)],
            [numbers[0].tobytes()], [numbers[1].tobytes()],
            [squeeze(block.key("__train").to_numpy(zero_copy_only=False).astype(np.int64))]])

    return Corpus(settle(per_block(blocks, answers, schema, rewrite)), tokens, distinct, class_tokens)


def _pair(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 8], "little")
        out.append(blob[at + 8:at + 8 + size])
        at += 8 + size
    return out


def _unpair(blob: bytes) -> list[np.ndarray]:
    return [unsqueeze(b) for b in _split(blob)[:2]]


def _summed(frame: DataFrame, run: Callable, size: int) -> np.ndarray:
    """Sum of the arrays of ``size`` numbers that ``run`` yields, one per task; added up in Spark."""
    schema = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))])
    spread = frame.mapInArrow(trimmed(run), schema).select(F.posexplode("values").alias("at", "value"))
    total = np.zeros(size)
    for r in spread.groupBy("at").agg(F.sum("value").alias("value")).filter("value != 0").collect():
        total[r["at"]] = r["value"]  # a model's size, whatever the corpus
    return total


def _listed(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([array.ravel().tolist()], pa.list_(pa.float64()))], names=["values"])


def _class_totals(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training tokens of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CLASSES))
        for batch in batches:
            for value in batch.column("value").to_pylist():
                whole = _split(value)[2]
                if whole:
                    total += [unsqueeze(b) for b in _split(whole)]
        yield _listed(total)

    total = _summed(answers.select("value"), run, 2 * CLASSES).reshape(2, CLASSES)
    return total[0], total[1]


def _training(batch: pa.RecordBatch) -> Iterator[Batch]:
    """The training sequences of each block."""
    for lengths, classes, train in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "classes", "train"))):
        lengths, classes, chosen = unsqueeze(lengths), unsqueeze(classes), unsqueeze(train).astype(bool)
        own = classes[np.repeat(chosen, lengths)]
        for sequences, _ in _portions(own, lengths[chosen]):
            yield sequences


def _portions(classes: np.ndarray, lengths: np.ndarray, tokens: int | None = None) -> Iterator[tuple[Batch, np.ndarray]]:
    """Batches of at most ``tokens`` tokens, or of one longer sequence, and which sequences they hold.

    Long sequences come together, so that few batches take many steps.
    """
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    ends = np.concatenate([[0], np.cumsum(lengths[order])])
    at = 0
    while at < len(order):
        limit = ends[at] + (tokens or BATCH_TOKENS)
        last = max(at + 1, int(np.searchsorted(ends, limit, side="right")) - 1)
        own = order[at:last]
        cuts = ends[at:last + 1] - ends[at]
        yield Batch(classes[np.repeat(first[own] - cuts[:-1], lengths[own]) + np.arange(cuts[-1])], cuts), own
        at = last


def train(corpus: Corpus, *, states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Model:
    """Baum-Welch over all training texts, until it changes little; see ``TOLERANCE``."""
    model, size = Model.begin(corpus.class_tokens, states), states * (1 + states + CLASSES)
    before = -math.inf
    for number in range(1, rounds + 1):
        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros((states, 1 + states + CLASSES)), 0.0
            for batch in batches:
                for sequences in _training(batch):
                    sums, value = _expect(sequences, model)
                    total += sums
                    likelihood += value
            yield _listed(np.append(total.ravel(), likelihood))

        found = _summed(corpus.blocks.select("n_tokens", "classes", "train"), run, size + 1)
        model, likelihood = improved(found[:size].reshape(states, -1)), float(found[size])
        model.rounds = number
        if likelihood - before < tolerance * abs(likelihood):
            break
        before = likelihood
    return model


def score(corpus: Corpus, model: Model, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, rounds) of every text."""
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("train", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("rounds", T.IntegerType())])
    tokens = corpus.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("n_tokens", "classes", "n_known", "base", "inside", "train")
            for i, blobs in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                lengths, classes, known = (unsqueeze(b) for b in blobs[:3])
                base, inside = (np.frombuffer(b) for b in blobs[3:5])
                total = inside.copy()
                for sequences, own in _portions(classes, lengths):
                    total[own] += log10_forward(sequences, model)
                yield rows(schema, [batch.column("ids")[i].values, unsqueeze(blobs[5]).astype(bool), lengths, known,
                                    [tokens] * len(lengths), base, total, [model.rounds] * len(lengths)])

    return corpus.blocks.mapInArrow(trimmed(run), schema)


def score_texts(docs: DataFrame, train_rows: Column, *, id_col: str = "doc_id", text: str = "text",
                states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows that ``train_rows`` picks and score all; see :func:`score`."""
    corpus = prepare(docs, train_rows, id_col=id_col, text=text)
    return score(corpus, train(corpus, states=states, rounds=rounds), docs.schema[id_col].dataType, id_col)


def op10_hmm(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document, learned from four fifths of them; a NULL id is learned from."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score_texts(docs, ~held_out).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "rounds")
