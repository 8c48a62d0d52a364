"""URL rules by a sort-merge sweep over reversed hosts.

A rule (host, path) fits a url when the url's host is the rule's or lies below it and
the url's path starts with the rule's.  A rule becomes the key ``org.example`` + end
mark + ``/es/``, which opens an interval there and closes it behind its last
continuation.  A url becomes one probe per suffix of its host, each with its path, so
that a rule fits exactly if its key begins a probe, that is, if the probe lies inside
the rule's interval.

Rules and probes are sorted together, range-partitioned, and swept.  Intervals of
prefixes are nested, so the stack of open rules is known from running sums: the depth
at a probe is the number of rules open there, and the innermost one is the last that
opened to that depth.  Each task starts from the depth and the stack the tasks before
it leave behind.  Among the suffixes the longest rule wins.

Everything is expressed in DataFrame functions.  Urls are made distinct by host and
path before the sweep.  A very long url is one row like any other; its host is probed no deeper than
the deepest rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillgauge.session import settle

#: Rules and probes that one task of the sweep takes, on average.
SWEEP_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _PROBE, _CLOSE = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for NULL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """Labels from the top level down, the end of the host, and the path; as bytes, which sort as such."""
    return F.concat(F.encode(F.array_join(labels, "\x02"), "UTF-8"), F.lit(b"\x01"), F.encode(path, "UTF-8"))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\.", -1))


def sweep(rules: DataFrame, probes: DataFrame, *, task_rows: int = SWEEP_ROWS) -> DataFrame:
    """Each probe with the innermost rule whose key begins it; probes without one are left out.

    ``rules`` has distinct ``key``s and a struct ``rule``; ``probes`` has ``key`` and a
    struct ``probe`` with distinct values.
    """
    none = F.lit(None)
    events = (
        rules.select("key", F.lit(_OPEN).alias("kind"), "rule", none.cast(probes.schema["probe"].dataType)
                     .alias("probe"))
        .unionByName(rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(_CLOSE).alias("kind"),
                                  none.cast(rules.schema["rule"].dataType).alias("rule"),
                                  none.cast(probes.schema["probe"].dataType).alias("probe")))
        .unionByName(probes.select("key", F.lit(_PROBE).alias("kind"),
                                   none.cast(rules.schema["rule"].dataType).alias("rule"), "probe")))
    events = settle(events.withColumn("tie", F.xxhash64("probe")))
    parts = max(8, math.ceil(events.count() / task_rows))
    # equal keys of many probes are told apart by the tie, so they need not share a task
    ranged = settle(events.repartitionByRange(parts, "key", "kind", "tie")
                    .withColumn("part", F.spark_partition_id()))

    change = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)
    parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    base = (ranged.groupBy("part").agg(F.sum(change).alias("change"))
            .select("part", F.coalesce(F.sum("change").over(parts_before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("part").orderBy("key", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    deep = (ranged.withColumn("moved", F.sum(change).over(inside)).join(base, "part")
            .withColumn("depth", F.col("moved") + F.col("base")).drop("moved", "base")
            .filter(F.col("kind") != _CLOSE))

    opened = deep.filter(F.col("kind") == _OPEN)
    lasts = opened.groupBy("part", "depth").agg(F.max_by("rule", "key").alias("rule"))
    # the open rule that a task finds at each depth: the last one opened to it in an earlier task
    levels = lasts.select("depth").distinct().join(base.select("part"))
    earlier = (Window.partitionBy("depth").orderBy("part")
               .rowsBetween(Window.unboundedPreceding, -1))
    left_open = (levels.join(lasts, ["part", "depth"], "left")
                 .withColumn("before", F.last("rule", ignorenulls=True).over(earlier))
                 .select("part", "depth", "before").filter(F.col("before").isNotNull()))
    level = (Window.partitionBy("part", "depth").orderBy("key", "kind", "tie")
             .rowsBetween(Window.unboundedPreceding, 0))
    return (deep.withColumn("own", F.last("rule", ignorenulls=True).over(level))
            .filter((F.col("kind") == _PROBE) & (F.col("depth") > 0))
            .join(left_open, ["part", "depth"], "left")
            .select("probe", F.coalesce("own", "before").alias("rule")))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules`` has ``verdict``, ``host`` and ``path``.  An empty or NULL path is ``/``; a rule
    without host or verdict is ignored; of two verdicts for one host and path, block wins.
    The longest fitting rule decides, of equally long ones that with the longer host.  Urls
    that no rule fits, NULL ones among them, get a NULL rule and the ``default``.
    """
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/"))
    host = F.translate("host", _UPPER, _LOWER)
    clean = settle(rules.filter((F.length("host") > 0) & F.col("verdict").isNotNull())
                   .select(host.alias("host"), path.alias("path"), "verdict")
                   .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
                   .withColumn("labels", _labels(F.col("host"))))
    rule = F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
                    F.concat("host", "path").alias("rule"), "verdict")
    keyed = clean.select(_key(F.col("labels"), F.col("path")).alias("key"), rule.alias("rule"))
    deepest = clean.agg(F.max(F.size("labels"))).first()[0] or 0

    found_host, found_path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": found_host, "path": found_path})
    distinct = pages.select("host", "path").distinct().withColumn("labels", _labels(F.col("host")))
    depths = F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, deepest)))))
    probes = (distinct.select("host", "path", "labels", depths.alias("d"))
              .select(_key(F.slice("labels", F.lit(1), F.col("d")), F.col("path")).alias("key"),
                      F.struct("host", "path", "d").alias("probe")))
    best = (sweep(keyed, probes).groupBy("probe.host", "probe.path").agg(F.max("rule").alias("best"))
            .select("host", "path", "best.rule", "best.verdict"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*rest, "host", "path").join(best, ["host", "path"], "left")
    return judged.select(*rest, "host", "path", "rule",
                         F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url judged by the rules."""
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(verdict, host, path)")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT u.*, (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict),
                                      length(r.host || r.path) * 1000 + length(r.host))
                        FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host))
                        AND starts_with(u.path, r.path)) AS best FROM urls u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
