"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by a hash of their text, so that equal texts lie together, and inside
one hash by their place in the stored table.  The boundaries between shards are found
without moving rows: each round counts, over all partitions, the exact bytes between
candidate boundaries, and puts new candidates between the two around each wanted
boundary, until the bytes below one are within the tolerance.  Where one hash holds
more than that (many copies of one text), the candidates go on inside it.  With the
boundaries known, the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillgauge.session import settle

#: Candidate boundaries per open interval and round.
PROBES = 4096


@dataclass
class Search:
    """One wanted boundary: the bytes that should lie below it and the interval it lies in."""

    target: float
    low: int
    high: int
    below: int
    inside: int | None = None  # the hash, once the interval is one of places inside it


def _next(search: Search, step: int, sizes: dict[int, int], tolerance: float) -> int | None:
    """Narrow the interval to one bucket; the boundary, if one is near enough."""
    below = search.below
    for bucket in sorted(sizes):
        above = below + sizes[bucket]
        if above >= search.target:
            start = search.low + bucket * step
            end = min(start + step, search.high)
            one_row = search.inside is not None and step == 1
            if search.target - below <= tolerance or one_row and search.target - below <= above - search.target:
                return start
            if above - search.target <= tolerance or one_row:
                return end
            search.low, search.high, search.below = start, end, below
            return None
        below = above
    return search.high


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """(hash, place) of the first row of every shard but the first; ``rows`` has hash, place and size."""
    total, first, last = rows.agg(F.sum("size"), F.min("hash"), F.max("hash")).first()
    if total is None:
        return []
    allowed = tolerance * total / shards
    open_ = [Search(total * i / shards, first, last + 1, 0) for i in range(1, shards)]
    found: dict[int, tuple[int, int]] = {}
    while len(found) < shards - 1:
        left = [i for i in range(shards - 1) if i not in found]
        spans = sorted({(open_[i].inside, open_[i].low, open_[i].high) for i in left},
                       key=lambda s: (s[0] is not None, s))
        span, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        steps = []
        for k, (inside, low, high) in enumerate(spans):
            step = -(-(high - low) // PROBES)
            steps.append(step)
            name = "hash" if inside is None else "place"
            value = F.col(name)
            here = (value >= low) & (value < high)
            if inside is not None:
                here = here & (F.col("hash") == inside)
            span = F.when(here, F.lit(k)).otherwise(span)
            bucket = F.when(here, F.expr(f"({name} - {low}) div {step}")).otherwise(bucket)
        counted = (rows.select(span.alias("span"), bucket.cast("long").alias("bucket"), "size")
                   .filter(F.col("span").isNotNull()).groupBy("span", "bucket").agg(F.sum("size").alias("size")))
        sizes: dict[int, dict[int, int]] = {k: {} for k in range(len(spans))}
        for r in counted.collect():  # at most PROBES rows per span, whatever the table's size
            sizes[r["span"]][r["bucket"]] = r["size"]
        for i in left:
            search = open_[i]
            k = spans.index((search.inside, search.low, search.high))
            at = _next(search, steps[k], sizes[k], allowed)
            if at is not None:
                found[i] = (at, 0) if search.inside is None else (search.inside, at)
            elif search.inside is None and search.high - search.low == 1:
                places = rows.filter(F.col("hash") == search.low).agg(F.min("place"), F.max("place")).first()
                search.inside, search.low, search.high = search.low, places[0], places[1] + 1
    return [found[i] for i in range(shards - 1)]


def _shard(cuts: list[tuple[int, int]], first: int = 0) -> Column:
    """Number of cuts at or below a row, by a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    value, place = cuts[middle]
    above = (F.col("hash") > value) | (F.col("hash") == value) & (F.col("place") >= place)
    return F.when(above, _shard(cuts[middle + 1:], first + middle + 1)).otherwise(_shard(cuts[:middle], first))


def shard_by_bytes(docs: DataFrame, shards: int = 8, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
                   tolerance: float = 0.001) -> DataFrame:
    """(keys, size, text_crc32, shard, slot): shards whose bytes differ from the mean by ``tolerance`` of it.

    The size of a row is that of its text in UTF-8 (NULL: 0) plus 1.  A row is never cut,
    so a boundary may miss by half a row.  Equal texts lie in one shard, or in adjacent
    ones where a boundary falls among them.  Slots count from 0 in every shard.  Rows
    with NULL or repeated keys are rows like others; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(
        *keys, (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 1).alias("hash"), F.monotonically_increasing_id().alias("place")))
    cuts = splitters(rows.select("hash", "place", "size"), shards, tolerance)
    # slots: rows are ranked among those that one task stored, and begin behind those of earlier tasks
    dealt = rows.withColumns({"shard": _shard(cuts).cast("int"), "slice": F.shiftrightunsigned("place", 33)})
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = (dealt.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")))
    inside = Window.partitionBy("shard", "slice").orderBy("hash", "place")
    return (dealt.withColumn("rank", F.row_number().over(inside)).join(begins, ["shard", "slice"])
            .select(*keys, "size", "text_crc32", "shard",
                    (F.col("begin") + F.col("rank") - 1).cast("long").alias("slot")))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
