"""Ranked search for items in a corpus, each class of equal bags scored once.

To an item a document is only a bag: how often it holds each term of the items, and one
number that stands for its length.  Documents with the same bag have the same score for
every item, so a bag is scored once and its members follow.

1. Every document is restricted to the terms of the items where it lies; N, L and each
   term's document frequency are sums over these bags.
2. Bags are dealt by a hash of their numbers and grouped by the numbers themselves, so a
   collision of hashes joins nothing.  Of each bag's members the ``top`` least ids are kept,
   which is all that ``top`` results can show; tasks keep no more than those before anything
   is shuffled, and bags of very many documents are spread over slices first.
3. Each task scores its bags against all items and keeps the best bags of every batch for
   each item; the rest is a ranking of those few, by score and then by ascending id.

Items are searched in blocks of bounded text, one pass per block, so that an item block's
terms fit every task, however many items there are.  A single item is never cut: one
longer than the bound makes a block of its own.

Terms are the stretches of ASCII letters and digits and of all characters beyond ASCII;
only A-Z are lower-cased.  A NULL or empty text has no terms: it adds nothing to N and L and is
never found; an item without terms finds nothing.  Repeated rows are documents of their
own that share an id, and repeated items are answered one by one.  NULL ids come after all others among
equal scores.  Very long texts are read whole, a few MB of text at a time, or one text.  No
documents or no items give no rows.  Other columns than ids and texts are not read, whatever
they are called.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.llm.arrow import one_chunk, rows, steps, text_bytes, texts_of, with_bytes
from fillgauge.llm.words import ascii_words
from fillgauge.operators.joins import hot_key_hashes
from fillgauge.session import settle

#: Results per item.
TOP = 10
#: Bytes of item text whose terms one pass over the documents looks for.
ITEM_BYTES = 4 * 1024 * 1024
#: Bags times items that are scored at a time.
SCORE_CELLS = 2_000_000
#: Slices of a bag that very many documents share.
SLICES = 32
#: Results of a batch are ranked over so many slices of an item first.
RANK_SLICES = 16

#: What separates terms becomes a space, A-Z become a-z, all other bytes stay.
_TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b) in string.ascii_letters + string.digits else 0x20 for b in range(256)
).lower()


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, in order."""
    offsets, raw = text_bytes(texts)
    return ascii_words(with_bytes(offsets, raw.translate(_TERM_BYTES)))


class Items:
    """The terms of a block of items: each term's items and how often they hold it."""

    def __init__(self, texts: list[str]):
        lists = terms_of(pa.array(texts, pa.string()))
        coded = one_chunk(lists.flatten()).dictionary_encode()
        self.n = len(texts)
        self.terms: pa.Array = coded.dictionary
        item = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
        pairs, self.times = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, self.n) + item,
                                      return_counts=True)
        self.items = pairs % max(1, self.n)
        #: where each term's items begin
        self.ends = np.searchsorted(pairs // max(1, self.n), np.arange(len(self.terms) + 1))


_BAG = T.StructType([T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                     T.StructField("tfs", T.ArrayType(T.LongType()))])


def bags(docs: DataFrame, terms: pa.Array, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, tfs): all terms of a document counted, and the given ones by their places, ascending."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *_BAG])
    wanted = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "text"):
            lists = terms_of(texts_of(table, "text"))
            ends = lists.offsets.to_numpy()
            coded = one_chunk(lists.flatten()).dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, wanted), -1).to_numpy().astype(np.int64)
            place = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, dtype=np.int64)
            held = place >= 0
            doc = np.repeat(np.arange(len(lists)), np.diff(ends))[held]
            cells, tfs = np.unique(doc * max(1, len(wanted)) + place[held], return_counts=True)
            cuts = pa.array(np.searchsorted(cells // max(1, len(wanted)), np.arange(len(lists) + 1)).astype(np.int32))
            yield rows(schema, [
                table.column("id"), np.diff(ends).astype(np.int64),
                pa.ListArray.from_arrays(cuts, pa.array((cells % max(1, len(wanted))).astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(tfs.astype(np.int64)))])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def bag_classes(held: DataFrame, total_docs: int, total_terms: int, top: int = TOP) -> DataFrame:
    """(m, terms, tfs, members): each distinct bag with its ``top`` least ids, ascending, NULL last."""
    m = F.expr(f"100L - 75L + (75L * n * {total_docs}L) div {max(1, total_terms)}L")
    keyed = (held.filter(F.size("terms") > 0).withColumn("m", m)
             .withColumn("bag", F.xxhash64("m", "terms", "tfs")))
    same = ["bag", "m", "terms", "tfs"]

    def least(frame: DataFrame, *also: str) -> DataFrame:
        order = Window.partitionBy(*same, *also).orderBy(F.col("id").asc_nulls_last())
        return frame.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).drop("place")

    hot = hot_key_hashes(keyed, ["bag"])
    if hot:
        is_hot = F.xxhash64("bag").isin(hot)
        sliced = keyed.filter(is_hot).withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
        keyed = keyed.filter(~is_hot).unionByName(least(sliced, "slice").drop("slice"))
    few = least(keyed).groupBy(*same).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("members"))
    return few.select("bag", "m", "terms", "tfs", F.col("members.id").alias("members"))


def weights(held: DataFrame, n_terms: int, total_docs: int) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) of each term; the terms are those of one block of items."""
    df = np.zeros(n_terms, dtype=np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    return np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * d + 1))) for d in df.tolist()],
                    dtype=np.int64)


def best_bags(classes: DataFrame, items: Items, weight: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, score, members) of the best bags of each batch for each item; at least the best ``top`` overall."""
    kind = classes.schema["members"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()),
                           T.StructField("members", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, max(1, SCORE_CELLS // max(1, items.n))):
            lists = batch.column("terms")
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy()
            bag = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            m = batch.column("m").to_numpy()[bag]
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            wide = items.ends[term + 1] - items.ends[term]
            # every term of a bag meets the items that hold it
            which = np.repeat(items.ends[term] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide)
            which = which + np.arange(len(which))
            scores = np.zeros((items.n, len(lists)), dtype=np.int64)
            np.add.at(scores.ravel(), items.items[which] * len(lists) + np.repeat(bag, wide),
                      np.repeat(value, wide) * items.times[which])
            yield from _best(scores, batch.column("members"), top, schema)

    return classes.select("m", "terms", "tfs", "members").mapInArrow(run, schema)


def _portions(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, ``n`` or a few less than 2n at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for whole in batches:
        for at in range(0, whole.num_rows, n):
            held.append(whole.slice(at, n))
            if sum(b.num_rows for b in held) >= n:
                yield joined()
                held = []
    if held:
        yield joined()


def _best(scores: np.ndarray, members: pa.Array, top: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The ``top`` first bags of each item by score and least id, those of score 0 left out."""
    first = members.flatten().take(pa.array(members.offsets.to_numpy()[:-1] - members.offsets.to_numpy()[0]))
    order = np.empty(len(members), dtype=np.int64)
    order[pc.sort_indices(first, null_placement="at_end").to_numpy()] = np.arange(len(members))
    item, bag = [], []
    cut = np.partition(scores, -top, axis=1)[:, -top] if scores.shape[1] > top else np.zeros(len(scores))
    for i, least in enumerate(np.maximum(cut, 1)):
        found = np.flatnonzero(scores[i] >= least)
        found = found[np.lexsort((order[found], -scores[i][found]))[:top]]
        item.append(np.full(len(found), i))
        bag.append(found)
    item, bag = np.concatenate(item or [order[:0]]), np.concatenate(bag or [order[:0]])
    yield rows(schema, [item.astype(np.int32), scores[item, bag], members.take(pa.array(bag))])


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text",
           item_col: str = "item_id", item_text: str = "text", top: int = TOP,
           item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item id, rank, id, score): the ``top`` documents of each item, best first.

    Equal scores go by ascending id.  Items are taken in the blocks of the module's docstring.
    """
    spark = docs.sparkSession
    asked = settle(items.select(F.col(item_col).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
                   .withColumn("item", F.xxhash64(F.monotonically_increasing_id())))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / item_bytes))
    names = {"item_id": item_col, "id": id_col}
    schema = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    found = None
    for block in range(blocks):
        chosen = asked.filter(F.pmod("item", F.lit(blocks)) == block).collect()  # bounded by item_bytes
        if not chosen:
            continue
        held_items = Items([r["text"] for r in chosen])
        held = settle(bags(docs, held_items.terms, id_col=id_col, text=text))
        total_docs, total_terms = held.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
        total_docs, total_terms = total_docs or 0, total_terms or 0
        classes = settle(bag_classes(held, total_docs, total_terms, top))
        best = best_bags(classes, held_items, weights(held, len(held_items.terms), total_docs), top)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(chosen)],
                                    T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]]))
        part = ranked(best, top).join(F.broadcast(ids), "item").select("item_id", "rank", "id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.withColumnsRenamed(names)


def ranked(best: DataFrame, top: int = TOP) -> DataFrame:
    """(item, rank, id, score): members of the best bags, in slices of each item first."""
    def first(frame: DataFrame, *also: str) -> DataFrame:
        order = Window.partitionBy("item", *also).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    single = best.select("item", "score", F.explode("members").alias("id"),
                         F.pmod(F.spark_partition_id(), F.lit(RANK_SLICES)).alias("slice"))
    return first(first(single, "slice").drop("slice", "rank"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(spark.read.parquet(f"{folder}/documents.parquet"),
                  spark.read.parquet(f"{folder}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
     i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
     it AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM i) GROUP BY ALL),
     dt AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
     nl AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
     w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
           FROM dt, nl WHERE term IN (SELECT term FROM it) GROUP BY term, n_docs),
     m AS (SELECT r, doc_id, 100 - 75 + (75 * len(t) * n_docs) // n_terms AS m FROM d, nl WHERE len(t) > 0),
     s AS (SELECT q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM dt JOIN m USING (r) JOIN w USING (term) JOIN it USING (term) GROUP BY q, r),
     k AS (SELECT q, r, score, doc_id,
                  row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
           FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10
"""
