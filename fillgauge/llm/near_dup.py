"""Near duplicates by Order MinHash, verified by banded alignment.

Words are lower-cased (A-Z) runs between ASCII white space and punctuation; a shingle is
five words in a row.  Two texts are near duplicates if their shingles, aligned in text
order, agree in at least 0.8 of all: matched / (both - matched).

1. *Sketches.*  A shingle is labelled with how often it occurred before in its text.
   For each of several orders, the few smallest labelled shingles are taken and kept in
   the order of the text; together they are one sketch.  Texts that agree in a sketch
   share these shingles in the same order, so sketches follow edit similarity.
2. *Copies.*  Texts with equal words are one class from the start; one of them goes on.
3. *Candidates.*  In every bucket of equal sketches, each text is compared with the most
   central one, that which has most company in all its buckets: the original, if copies
   were made from one.  That is one pair per member, however large the bucket.
4. *Alignment.*  Candidates are aligned inside the band that the threshold allows.
   Links are joined to classes by spreading the smallest number along them.
5. *The rest.*  Where a bucket still holds several classes, one member of each goes on, for
   a large class the one in its middle.  With few classes each pair is compared.  With
   many, each is compared with the most central one, and they are dealt out anew by
   pairs of sketches and compared in the same way there.
6. *All that is left.*  All members of buckets that then still hold several classes are
   dealt out by their rarest shingles.  Similar texts agree in four fifths of their
   shingles at least, so in one of the first fifth, in any order that is the same for all.
   Texts of different classes that share such a shingle are compared; no pair that
   shares a sketch is left out.

Texts shorter than five words have one shingle.  NULL and empty texts have none, and are
classes of their own, each row apart.  A repeated row is a copy.  Ids may be NULL or
repeated: rows are told apart by their place.  A very long text is one row of a task: its shingles
lie there as 8 bytes each, and the bits that align two texts are as long as the longer one, so
two texts of n shingles cost n * n / 64 steps of a word whatever the band.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import one_chunk, rows, steps, text_bytes, texts_of, trimmed, with_bytes
from fillgauge.llm.words import ascii_words
from fillgauge.operators.joins import attach
from fillgauge.session import settle

#: Words in a shingle, and the least similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Orders, and labelled shingles per sketch.
SKETCHES, LENGTH = 16, 3
#: Up to this many classes in a bucket, one of each is compared with one of each other.
FEW_CLASSES = 24

#: Holders of a shingle that a task compares with all its holders.
SLICE_ROWS = 512
#: Classes of this size and more have a middle, found by comparison with so many members.
LARGE_CLASS, PROBES = 8, 6

_PUNCTUATION = string.punctuation.encode()
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + _PUNCTUATION,
                         string.ascii_lowercase.encode() + b" " * len(_PUNCTUATION))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit number per word, and where each text's words end."""
    offsets, raw = text_bytes(texts)
    lists = ascii_words(with_bytes(offsets, raw.translate(_PLAIN)))
    coded = one_chunk(lists.flatten()).dictionary_encode()
    numbers = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little")
                        for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint32)
    return numbers[coded.indices.to_numpy()], lists.offsets.to_numpy().astype(np.int64)


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and where they end; a shorter text is one shingle."""
    counts = np.diff(ends)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    shingle_ends = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(shingle_ends[-1]) + np.repeat(ends[:-1] - shingle_ends[:-1], n)
    stop = np.repeat(ends[1:], n)
    mixed = np.zeros(len(start), dtype=np.uint64)
    wide = np.concatenate([words.astype(np.uint64) + np.uint64(1), np.zeros(SHINGLE, dtype=np.uint64)])
    for j in range(SHINGLE):
        mixed = _mix(mixed + np.where(start + j < stop, wide[np.minimum(start + j, len(words))], np.uint64(0)), j + 1)
    return mixed, shingle_ends


def _labelled(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often each occurred before in its text."""
    if not len(hashes):
        return hashes
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    place = np.arange(len(hashes))
    run_start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
    before = np.empty(len(hashes), dtype=np.uint64)
    before[order] = (place - run_start).astype(np.uint64)
    return np.where(before > 0, _mix(hashes + before * np.uint64(0x9E3779B97F4A7C15), 77), hashes)


def sketches(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of :data:`SKETCHES` keys for every text; texts without shingles have zeros."""
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(n)), n)
    labelled = _labelled(hashes, doc)
    keys = np.zeros((len(n), SKETCHES), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return keys
    starts = ends[:-1][full]
    lengths = n[full]
    for j in range(SKETCHES):
        order = _mix(labelled, 0xA5A5 + 7919 * j)
        taken, places = [], []
        for _ in range(LENGTH):
            least = np.minimum.reduceat(order, starts)
            at = np.flatnonzero(order == np.repeat(least, lengths))
            # equal numbers within a text: the first place counts
            first = at[np.searchsorted(at, starts)]
            done = least == _TOP  # fewer shingles than the sketch takes
            taken.append(np.where(done, np.uint64(0), labelled[first]))
            places.append(np.where(done, np.int64(1) << 60, first))
            order[first] = _TOP
        in_text = np.argsort(np.stack(places), axis=0, kind="stable")
        chosen = np.take_along_axis(np.stack(taken), in_text, axis=0)
        key = np.full(len(full), j + 1, dtype=np.uint64)
        for k in range(LENGTH):
            key = _mix(key ^ chosen[k], 0x51ED + k)
        keys[full, j] = key
    return keys


def _matched(a: np.ndarray, b: np.ndarray, band: int, need: int) -> int:
    """Length of the longest alignment with no match further than ``band`` from the diagonal.

    Found bit-parallel, a row of the table at a time; 0 as soon as ``need`` is out of reach.
    """
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    rest = short - head
    unlike = np.flatnonzero(a[len(a) - rest:][::-1] != b[len(b) - rest:][::-1])
    tail = int(unlike[0]) if len(unlike) else rest
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    full = (1 << len(b)) - 1
    open_ = full
    left = head + tail + len(a)
    for i, x in enumerate(a.tolist()):
        match = 0
        for j in where.get(x, ()):
            if abs(i - j) <= band:
                match |= 1 << j
        if not match:
            left -= 1
            if left < need:
                return 0
            continue
        hit = open_ & match
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return head + tail + len(b) - open_.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sequences of shingles, aligned inside the band that ``least`` allows, agree enough.

    With ``m`` matches needed, a match further than ``len(a) + len(b) - 2 m`` from the
    diagonal cannot be part of a good enough alignment.
    """
    both = len(a) + len(b)
    need = math.ceil(least / (1 + least) * both - 1e-9)
    if min(len(a), len(b)) < need or not both:
        return False
    return _matched(a, b, both - 2 * need, need) >= need


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sequences of shingles by their whole alignment."""
    found = _matched(a, b, len(a) + len(b), 0)
    return found / max(1, len(a) + len(b) - found)


def sketch_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Stored: every row's place, id, digest of its words, number of shingles, sketch keys and words."""
    schema = T.StructType([
        T.StructField("place", T.LongType()), T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "text"):
            words, ends = word_numbers(texts_of(table, "text"))
            hashes, shingle_ends = shingles(words, ends)
            keys = sketches(hashes, shingle_ends).astype(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(keys) + 1) * SKETCHES, pa.int32()), pa.array(keys.ravel()))
            raw = words.astype("<u4").tobytes()
            bodies = [raw[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield rows(schema, [
                table.column("place"), table.column("id"),
                [hashlib.blake2b(b, digest_size=16).digest() if b else None for b in bodies],
                np.diff(shingle_ends), lists, bodies])

    return settle(docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"),
                              F.col(text).alias("text")).mapInArrow(trimmed(run), schema))


def _aligned(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (a, b) of places with the words of both texts."""
    of_a = bodies.select(F.col("place").alias("a"), F.col("body").alias("body_a"))
    of_b = bodies.select(F.col("place").alias("b"), F.col("body").alias("body_b"))
    # b is as good as distinct; a may be the centre of very many, which the join on it may split
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "body_a", "body_b")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
    for batch in batches:
        held: dict[int, np.ndarray] = {}

        def both(batch: pa.RecordBatch = batch, held: dict = held) -> Iterator[tuple]:
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "body_a", "body_b"))):
                if a not in held:
                    held.clear()
                    held[a] = _sequence(x)
                yield held[a], _sequence(y)

        yield batch, both()


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs whose texts are similar; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sequences in _sequences(batches):
            found = pa.array([similar(x, y) for x, y in sequences], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(found) for c in ("a", "b")], names=["a", "b"])

    return settle(_aligned(pairs, bodies).mapInArrow(trimmed(run), "a long, b long"))


def _middles(members: DataFrame, labels: DataFrame, bodies: DataFrame) -> DataFrame:
    """(label, m): of each large class the member in its middle; stored.

    Members near an original have the same company as it has.  All members with the most
    company are compared with a few others of the class; the one that agrees best with
    them is the middle.
    """
    known = labels.join(members.select("place", "n", "company").distinct(), "place")
    salted = [F.max(F.struct(F.xxhash64("place", F.lit(i)), "place")).alias(f"p{i}") for i in range(PROBES)]
    probes = (known.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.max("company").alias("most"), *salted)
              .filter(F.col("size") >= LARGE_CLASS)
              .select("label", "most", F.array_distinct(F.array(*[f"p{i}.place" for i in range(PROBES)])).alias("p")))
    tied = settle(known.join(probes, "label").filter(F.col("company") == F.col("most"))
                  .select("label", "place", "n", "company", F.explode("p").alias("probe")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sequences in _sequences(batches):
            share = pa.array([agreement(x, y) for x, y in sequences], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), share], names=["a", "b", "share"])

    pairs = tied.select(F.col("probe").alias("a"), F.col("place").alias("b")).distinct()
    shares = (_aligned(pairs, bodies).mapInArrow(trimmed(run), "a long, b long, share double")
              .groupBy(F.col("b").alias("place")).agg(F.round(F.sum("share"), 9).alias("share")))
    return settle(tied.select("label", "place", "n", "company").distinct().join(shares, "place").groupBy("label")
                  .agg(F.max(F.struct("share", -F.col("place"), "company", "place", "n")).alias("m"))
                  .select("label", "m"))


def _sequence(body: bytes) -> np.ndarray:
    words = np.frombuffer(body, dtype="<u4")
    return shingles(words, np.array([0, len(words)]))[0]


def classes(links: DataFrame) -> DataFrame:
    """(place, label) of every linked place: the smallest place it is joined to by links; stored.

    Each round takes the smallest label around, then that label's own; both at once follow
    long chains in few rounds.  Labels only fall, so they stand still when their sum does.
    """
    ways = settle(links.select(F.col("a").alias("place"), F.col("b").alias("other"))
                  .union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = settle(ways.groupBy("place").agg(F.least(F.min("other"), F.first("place")).alias("label")))
    before = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        around = (ways.join(labels.withColumnRenamed("place", "other"), "other").select("place", "label")
                  .union(labels).groupBy("place").agg(F.min("label").alias("label")))
        around = settle(around)
        further = around.select(F.col("place").alias("label"), F.col("label").alias("next"))
        labels = settle(around.join(further, "label", "left")
                        .select("place", F.coalesce("next", "label").alias("label")))


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _sized(x: Column, y: Column) -> Column:
    """Whether texts of so many shingles can be similar."""
    return F.least(x, y) >= F.lit(SIMILARITY) * F.greatest(x, y)


def _central_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with its most central one."""
    centre = members.groupBy("bucket").agg(F.max(F.struct("company", "place", "n")).alias("centre"))
    return (members.join(centre, "bucket").filter(F.col("place") != F.col("centre.place"))
            .filter(_sized(F.col("n"), F.col("centre.n")))
            .select(F.col("centre.place").alias("a"), F.col("place").alias("b")).distinct())


def _shared(members: DataFrame) -> DataFrame:
    """Members of buckets with company, and how large the bucket is."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(sizes, "bucket")


def _spokesmen(members: DataFrame, labels: DataFrame, middles: DataFrame) -> DataFrame:
    """Who stands for each class in each bucket that has several classes; ``size`` counts these.

    It is the middle of the class, or its most central member in the bucket if the class is small.
    """
    labelled = members.select("bucket", "place", "n", "company").join(labels, "place", "left")
    chosen = (labelled.groupBy("bucket", F.coalesce("label", "place").alias("label"))
              .agg(F.max(F.struct("company", "place", "n")).alias("own")))
    several = _shared(chosen).join(middles, "label", "left")
    return several.select("bucket", "label", "size",
                          *[F.coalesce(f"m.{c}", f"own.{c}").alias(c) for c in ("company", "place", "n")])


def _class_pairs(chosen: DataFrame) -> DataFrame:
    """Each pair of the few spokesmen of a bucket."""
    few = chosen.filter(F.col("size") <= FEW_CLASSES)
    x, y = few.alias("x"), few.alias("y")
    return (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.place") < F.col("y.place")))
            .filter(_sized(F.col("x.n"), F.col("y.n")))
            .select(F.col("x.place").alias("a"), F.col("y.place").alias("b")).distinct())


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, n, label) of the members of buckets that hold several classes; stored."""
    labelled = members.select("bucket", "place", "n").join(labels, "place", "left").withColumn(
        "label", F.coalesce("label", "place"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return settle(attach(labelled, several.filter("low < high").select("bucket"), ["bucket"], how="inner")
                  .select("place", "n", "label").distinct())


def _tokens(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """(token, place, n, label): every labelled shingle of ``members``; stored."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("place", T.LongType()),
                           T.StructField("n", T.IntegerType()), T.StructField("label", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, n, label, body in zip(*(batch.column(c).to_pylist() for c in ("place", "n", "label", "body"))):
                hashes = _sequence(body)
                tokens = _labelled(hashes, np.zeros(len(hashes), dtype=np.int64)).astype(np.int64)
                yield rows(schema, [tokens, np.full(n, place), np.full(n, n, dtype=np.int32), np.full(n, label)])

    return settle(bodies.join(members, "place").select("place", "n", "label", "body").mapInArrow(trimmed(run), schema))


def _rare_pairs(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b): each pair of ``members`` of different classes that can be similar.

    Shingles are put in one order, those that one class alone holds before all others, then
    by the number of their holders.  Of ``n`` shingles ``SIMILARITY * n`` have to agree, so
    similar texts share one of the first ``n - SIMILARITY * n + 1``.  Behind the first that
    two texts share there must be enough in both to reach what their lengths need.
    """
    tokens = _tokens(members, bodies)
    held = (tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("label").alias("low"),
                                        F.max("label").alias("high"))
            .filter("low < high").select("token", "holders"))
    shared = attach(tokens, settle(held), ["token"], how="inner", settled=True)
    text = Window.partitionBy("place")  # a group here is one text
    first = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - F.lit(1e-9)) + 1
    alone = F.col("n") - F.count(F.lit(1)).over(text)
    rare = settle(shared.withColumn("rank", F.row_number().over(text.orderBy("holders", "token")))
                  .withColumn("alone", alone).filter(F.col("rank") <= first - F.col("alone"))
                  .select("token", "place", "n", "label", (F.col("n") - F.col("alone") - F.col("rank") + 1).alias("behind"),
                          F.ceil(F.col("holders") / SLICE_ROWS).cast("int").alias("of")))
    x = rare.withColumn("slice", F.pmod(F.xxhash64("place"), F.col("of")).cast("int")).alias("x")
    y = rare.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).alias("y")
    need = F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-9))
    return (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.slice") == F.col("y.slice"))
                   & (F.col("x.place") < F.col("y.place")) & (F.col("x.label") != F.col("y.label"))
                   & (F.least("x.behind", "y.behind") >= need))
            .select(F.col("x.place").alias("a"), F.col("y.place").alias("b")).distinct())


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, id, class, class_id, class_size): every row of ``docs`` with its class.

    ``place`` tells rows apart, ``class`` is the smallest place in the class, ``class_id``
    the smallest id in it that is not NULL.
    """
    held = sketch_rows(docs, id_col, text)
    copies = settle(held.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("place").alias("place")))
    firsts = settle(held.select("place", "n", "keys").join(copies.select("place"), "place", "left_semi")
                    .select("place", "n", F.explode("keys").alias("bucket")))
    shared = _shared(firsts)
    company = shared.groupBy("place").agg(F.sum("size").alias("company"))
    members = settle(shared.join(company, "place"))
    bodies = settle(attach(held.select("place", "body"), members.select("place").distinct(), ["place"], how="inner"))

    tried = settle(_central_pairs(members))
    links = _verified(tried, bodies)
    labels = classes(links)

    middles = _middles(members, labels, bodies)
    chosen = settle(_spokesmen(members, labels, middles))
    many = chosen.filter(F.col("size") > FEW_CLASSES)
    x, y = many.alias("x"), many.select("label", "bucket").alias("y")
    dealt = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.bucket") < F.col("y.bucket"))).select(
        F.xxhash64("x.bucket", "y.bucket").alias("bucket"), "x.place", "x.n", "x.company")
    anew = settle(_spokesmen(dealt, labels, middles))
    more = _class_pairs(chosen).union(_class_pairs(anew))
    for dealing in (chosen, anew):
        more = more.union(_central_pairs(dealing.filter(F.col("size") > FEW_CLASSES))
                          .select(*_pair(F.col("a"), F.col("b"))))
    known = tried.select(*_pair(F.col("a"), F.col("b")))
    more = settle(more.distinct().join(known, ["a", "b"], "left_anti"))
    links = links.union(_verified(more, bodies))
    labels = classes(links)

    left = _rare_pairs(_unresolved(members, labels), bodies)
    links = links.union(_verified(left.join(known.union(more), ["a", "b"], "left_anti"), bodies))
    labels = classes(links)

    of_copy = (copies.join(labels, "place", "left")
               .select("digest", F.coalesce("label", "place").alias("class")))
    found = settle(held.select("place", "id", "digest").join(of_copy, "digest", "left")
                   .select("place", "id", F.coalesce("class", "place").alias("class")))
    sizes = found.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min("id").alias("class_id"))
    return found.join(sizes, "class").select("place", "id", "class", "class_id", "class_size")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns as they were.

    The row with the smallest id stays, NULL being the largest, and of equal ids the first.
    ``docs`` is read twice and must be a stored table, as its rows are told apart by place.
    """
    found = near_classes(docs, id_col=id_col, text=text).filter(F.col("class_size") > 1)
    stays = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "place")).alias("first"))
    goes = found.join(stays, "class").filter(F.col("place") != F.col("first.place")).select("place")
    column = "__place"
    while column in docs.columns:
        column += "_"
    goes = settle(goes.withColumnRenamed("place", column))
    return (docs.withColumn(column, F.monotonically_increasing_id()).join(goes, column, "left_anti").drop(column))


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the number of its class of near duplicates, its size and the smallest doc_id in it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_classes(docs).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "class_size",
                                     F.col("class_id").alias("least_doc_id"))
