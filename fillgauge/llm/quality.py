"""Quality of documents by weakly supervised rules.

Each rule looks at one property of a text and votes good, bad or abstains.  How often a
rule is right is not known; expectation-maximisation estimates it, for good and for bad
documents apart, from how the rules agree with one another over all documents.  A
document is then judged by its posterior probability of being good, so one wrong rule
does not throw it away.  The corpus enters the estimation as counts of vote patterns,
of which there are at most 3 ** rules, whatever its size.  A very long text is measured whole, in one
step of one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import one_chunk, rows, steps, text_bytes, texts_of, trimmed
from fillgauge.llm.words import ascii_words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words in a window, for repetition inside a text.
WINDOW = 8
#: Properties of a text, in the order of the columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper_words", "n_stops", "n_plain_words", "n_same_words")


def _per_doc(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ends."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[ends])


def repeated_words(codes: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document the words inside windows that occur there twice or more."""
    n = len(codes)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(doc[:max(0, n - window + 1)] == doc[window - 1:])
    if len(starts):
        mixed = doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(window):
            mixed = (mixed ^ codes[starts + j].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        order = np.argsort(mixed, kind="stable")
        twin = mixed[order][1:] == mixed[order][:-1]
        near = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        # equal hashes are looked at word by word
        first = starts[order[near]]
        if len(first):
            full = np.stack([doc[first], *[codes[first + j] for j in range(window)]], axis=1)
            _, group, count = np.unique(full, axis=0, return_inverse=True, return_counts=True)
            first = first[count[group.ravel()] > 1]
            np.add.at(covered, first, 1)
            np.add.at(covered, first + window, -1)
    return _per_doc(np.cumsum(covered[:n]) > 0, ends)


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The :data:`MEASURES` of each text."""
    offsets, raw = text_bytes(texts)
    marks = np.zeros(256, dtype=bool)
    marks[list(SYMBOLS)] = True
    n_symbols = _per_doc(marks[np.frombuffer(raw, dtype=np.uint8)], offsets)

    lists = ascii_words(texts)
    ends = lists.offsets.to_numpy()
    words = one_chunk(lists.flatten())
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    letters = pc.utf8_length(coded.dictionary).to_numpy()
    upper = pc.and_(pc.utf8_is_upper(coded.dictionary), pc.greater(pc.utf8_length(coded.dictionary), 1))
    stops = pc.match_substring_regex(coded.dictionary, "[.!?]$")
    plain = pc.match_substring_regex(coded.dictionary, r"^['\"(]?\pL[\pL'’-]*[.,;:!?)'\"]*$")
    upper, stops, plain = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (upper, stops, plain)]
    same = np.zeros(len(codes), dtype=bool)
    same[1:] = codes[1:] == codes[:-1]
    same[ends[:-1][ends[:-1] < len(codes)]] = False  # a document's first word has no word before it

    lined = pc.split_pattern(texts, "\n")
    lines = one_chunk(lined.flatten())
    line_doc = np.repeat(np.arange(len(texts)), np.diff(lined.offsets.to_numpy()))
    worded = np.flatnonzero(pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False))
    line_codes = lines.take(pa.array(worded)).dictionary_encode().indices.to_numpy().astype(np.int64)
    line_doc = line_doc[worded]
    n_lines = np.bincount(line_doc, minlength=len(texts))
    distinct = np.unique(line_doc * (len(lines) + 1) + line_codes)
    n_distinct = np.bincount(distinct // (len(lines) + 1), minlength=len(texts))

    return [np.diff(ends), _per_doc(letters[codes], ends), n_symbols, n_lines - n_distinct,
            repeated_words(codes, ends), n_lines, _per_doc(upper[codes], ends),
            _per_doc(stops[codes], ends), _per_doc(plain[codes], ends), _per_doc(same, ends)]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the :data:`MEASURES` of every whole text (NULL: of the empty text).

    Columns of these names are replaced, except that the text column cannot have one.
    """
    keep = [c for c in docs.columns if c not in MEASURES]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, text):
            yield rows(schema, [*[table.column(c) for c in keep], *measure(texts_of(table, text))])

    return docs.select(*keep).mapInArrow(trimmed(run), schema)


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(2)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, 2 bad, 0 abstains."""
    return {
        "symbols": _vote(_share("n_symbols") < 0.02, _share("n_symbols") > 0.1),
        "capitals": _vote(_share("n_upper_words") < 0.1, _share("n_upper_words") > 0.5),
        "sentences": _vote(_share("n_stops").between(0.04, 0.25),
                           (_share("n_stops") > 0.5) | (_share("n_stops") < 0.01) & (F.col("n_words") >= 50)),
        "plain_words": _vote(_share("n_plain_words") > 0.85, _share("n_plain_words") < 0.7),
        "stutter": _vote(_share("n_same_words") < 0.05, _share("n_same_words") > 0.2),
        "lines": _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 3),
                       (_share("n_dup_lines", "n_lines") > 0.4) & (F.col("n_lines") >= 5)),
        "passages": _vote(_share("n_repeat_words") < 0.1, _share("n_repeat_words") > 0.3),
        "word_length": _vote(_share("word_chars").between(3.5, 6.5),
                             (_share("word_chars") < 3) | (_share("word_chars") > 7.5)),
        "length": _vote(F.col("n_words") >= 50, F.col("n_words") < 10),
    }


@dataclass
class VoteModel:
    """Prior of a good document, and how often each rule is right on good and on bad ones."""

    prior: float
    right_if_good: list[float]
    right_if_bad: list[float]

    def posterior(self) -> Column:
        """Probability that a document is good, from its measures."""
        score = F.lit(math.log(self.prior) - math.log1p(-self.prior))
        for vote, good, bad in zip(rules().values(), self.right_if_good, self.right_if_bad):
            score = score + (F.when(vote == 1, F.lit(math.log(good) - math.log1p(-bad)))
                             .when(vote == 2, F.lit(math.log1p(-good) - math.log(bad))).otherwise(F.lit(0.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over vote patterns (rows of 0, 1, 2) and how often each occurs.

    A document may be bad in one way only, so on bad ones most rules may be wrong.  So the
    estimation starts from rules that are nearly always right on good documents and two
    times in five on bad ones, and each accuracy is pulled a little to that start, as if ten more
    documents had been seen.  On good documents a rule is taken to be right nine times
    in ten at least, and it says bad more often on bad ones; so the two classes cannot
    change places.  Without documents the start is returned.
    """
    said_good, said_bad = votes == 1, votes == 2
    prior, good, bad = 0.5, np.full(votes.shape[1], 0.98), np.full(votes.shape[1], 0.4)
    for _ in range(rounds if len(votes) else 0):
        score = (np.log(prior) - np.log1p(-prior)
                 + (said_good * (np.log(good) - np.log1p(-bad)) + said_bad * (np.log1p(-good) - np.log(bad))).sum(1))
        weight = counts / (1 + np.exp(-score))
        other = counts - weight
        before = np.concatenate([[prior], good, bad])
        prior = (weight.sum() + 5) / (counts.sum() + 10)
        good = (9.8 + weight @ said_good) / (10 + weight @ (said_good | said_bad))
        bad = (4 + other @ said_bad) / (10 + other @ (said_good | said_bad))
        good = np.clip(good, 0.9, 1 - 1e-4)
        bad = np.clip(bad, 2 * (1 - good), 1 - 1e-4)
        if np.abs(np.concatenate([[prior], good, bad]) - before).max() < tolerance:
            break
    return VoteModel(float(prior), good.tolist(), bad.tolist())


def fit(docs: DataFrame, text: str = "text") -> VoteModel:
    """Accuracies of the rules over all documents."""
    names = list(rules())
    patterns = (measured(docs.select(F.col(text).alias("text"))).select(*[v.alias(n) for n, v in rules().items()])
                .groupBy(*names).agg(F.count(F.lit(1)).alias("count")).collect())  # at most 3 ** rules
    votes = np.array([[r[n] for n in names] for r in patterns], dtype=np.int64).reshape(-1, len(names))
    order = np.lexsort(votes.T) if len(votes) else np.zeros(0, dtype=np.int64)
    counts = np.array([r["count"] for r in patterns], dtype=float)
    return estimate(votes[order], counts[order])


def judge(docs: DataFrame, model: VoteModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``posterior`` and ``kept``; columns of these names are replaced.

    ``base_failed``: under 20 words, or over 30 % of them inside repeated windows.  A
    document is kept if it has not failed that and is at least as likely good as bad.
    Rows count one by one, repeated ones too.
    """
    model = fit(docs, text) if model is None else model
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (measured(docs, text).withColumn("base_failed", failed).withColumn("posterior", model.posterior())
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))


def keep_good(docs: DataFrame, model: VoteModel | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, columns as they were."""
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return judge(held, fit(docs, text) if model is None else model).filter("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's measures and whether it is kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "posterior")
