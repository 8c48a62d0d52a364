"""Versioned record tables: reading the latest version, writing versions back."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.functions.values import (nulls_for_nans, padded_id, resolve_column, round_half_up)
from fillgauge.operators.joins import attach
from fillgauge.session import replace_path
from fillgauge.sources.generations import Hadoop, commit, current, vacuum

#: Version number of untouched records in a base table.
BASE_STATUS = 1


#: Suffix of the table that holds the edited versions of a base table.
EDITS_SUFFIX = "_edi"
#: Where a table with generations keeps what was written since the first.
_DATA = "_data"
_GENERATION = "generation"


def read_tables(spark: SparkSession, location: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The stored base table and the table of its edited versions."""
    return (spark.read.parquet(f"{location}/{table}"),
            spark.read.parquet(f"{location}/{table}{EDITS_SUFFIX}"))


def read_jdbc(spark: SparkSession, url: str, table: str, *, properties: Mapping[str, str],
              id_col: str, lower: int, upper: int, partitions: int,
              fetchsize: int = 50_000) -> DataFrame:
    """Parallel scan of a database table in ranges of its id."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=id_col, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, fetchsize=fetchsize, **properties).load()


def _finish(df: DataFrame, id_col: str, decimals: int | None) -> DataFrame:
    df = df.withColumn("ident", padded_id(F.col(id_col)))
    return df if decimals is None else round_half_up(df, decimals)


def load_input_data(base: DataFrame, edits: DataFrame, status: int, *, id_col: str,
                    status_col: str = "status_zapisa", base_status: int | None = None,
                    tie_cols: Sequence[str] = (), decimals: int | None = 2,
                    parquet_path: str | None = None) -> DataFrame:
    """Latest version per id out of ``base`` and the edits with version ``status``.

    ``base_status`` restricts the base rows to one version; ``tie_cols`` (largest
    first) order rows of equal version.  ``ident`` is the padded id.  With
    ``parquet_path`` the result is also stored there.
    """
    status_col = resolve_column(base, status_col)
    base, edits = nulls_for_nans(base), nulls_for_nans(edits)
    if base_status is not None:
        base = base.filter(F.col(status_col) == base_status)
    rows = base.unionByName(edits.filter(F.col(status_col) == status))
    newest = Window.partitionBy(id_col).orderBy(
        F.col(status_col).desc(), *[F.col(c).desc() for c in tie_cols])
    rows = rows.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") == 1)
    out = _finish(rows, id_col, decimals)
    if parquet_path:
        replace_path(base.sparkSession, parquet_path, out.write.parquet)
        return base.sparkSession.read.schema(out.schema).parquet(parquet_path)
    return out


def load_versions(base: DataFrame, edits: DataFrame, statuses: Sequence[int], *, id_col: str,
                  status_col: str = "status_zapisa", tie_cols: Sequence[str] = (),
                  keep_only_max_status: bool = False, decimals: int | None = 2) -> DataFrame:
    """Latest version per (requested status, id), with a column ``requested_status``.

    Each id is folded once to its base record and its newest record per requested
    status, so every input row is shuffled once however many versions are asked for.
    """
    status_col = resolve_column(base, status_col)
    wanted = sorted({int(s) for s in statuses})
    base = nulls_for_nans(base).filter(F.col(status_col) == BASE_STATUS)
    edits = nulls_for_nans(edits).filter(F.col(status_col).isin(wanted))
    cols = base.columns
    rows = base.withColumn("__edit", F.lit(False)).unionByName(
        edits.withColumn("__edit", F.lit(True)))
    record = F.struct(*cols)
    age = F.struct(F.col(status_col).alias("s"), *[F.col(c).alias(f"t_{c}") for c in tie_cols])

    def newest(cond: Column, name: str) -> Column:
        return F.max_by(F.when(cond, F.struct(age.alias("age"), record.alias("rec"))),
                        F.when(cond, age)).alias(name)

    folded = rows.groupBy(F.col(id_col).alias("__id")).agg(
        newest(~F.col("__edit"), "b"),
        *[newest(F.col("__edit") & (F.col(status_col) == s), f"e{s}") for s in wanted])
    picks = []
    for s in wanted:
        e, b = F.col(f"e{s}"), F.col("b")
        later = e.isNotNull() & (b.isNull() | (e["age"] >= b["age"]))
        picks.append(F.struct(F.lit(s).alias("requested_status"),
                              F.when(later, e).otherwise(b)["rec"].alias("rec")))
    out = (folded.select(F.explode(F.array(*picks)).alias("p")).filter("p.rec is not null")
           .select("p.requested_status", "p.rec.*"))
    out = _finish(out.withColumn("rn", F.lit(1)), id_col, decimals)
    return keep_max_status(out, status_col, by=["requested_status"]) if keep_only_max_status else out


def versions_as_dict(loaded: DataFrame, statuses: Sequence[int]) -> dict[int, DataFrame]:
    """One lazy DataFrame per requested status."""
    return {int(s): loaded.filter(F.col("requested_status") == int(s)).drop("requested_status")
            for s in statuses}


def keep_max_status(df: DataFrame, status_col: str = "status_zapisa",
                    by: Sequence[str] = ()) -> DataFrame:
    """Rows whose version is the largest in the table (or per ``by``), compared as numbers."""
    status_col = resolve_column(df, status_col)
    number = F.col(status_col).cast("string").try_cast("double")
    if not by:
        return df.filter(number == F.lit(df.agg(F.max(number)).first()[0]))
    tops = df.groupBy(*by).agg(F.max(number).alias("__top"))
    return attach(df, tops, list(by), null_safe=True).filter(number == F.col("__top")).drop("__top")


def align_to_target(df: DataFrame, target: DataFrame,
                    dtype: Mapping[str, str] | None = None) -> DataFrame:
    """Only the columns the target has, in the order of ``df``, cast where asked for."""
    kept = [c for c in df.columns if c in set(target.columns)]
    return df.select(*[F.col(c).cast(dtype[c]).alias(c) if dtype and c in dtype else F.col(c)
                       for c in kept])


def _version_column(columns: Sequence[str], status_col: str) -> str:
    status = next((c for c in columns if c.lower() == status_col.lower()), None)
    if status is None:
        raise ValueError(f"version column {status_col} not found among {columns}")
    return status


def _version_folders(spark: SparkSession, *parts: str) -> list[str]:
    return [n for n in Hadoop(spark, parts[0]).names(*parts[1:]) if "=" in n]


def read_output(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The table at ``path`` as it is now, or as one generation left it.

    Of a table whose versions were ever replaced, all rows come from one generation, whatever
    writers do while they are read.  Any other table is a plain Parquet folder.
    """
    manifest = current(spark, path, generation)
    if manifest is None:
        if generation is not None:
            raise ValueError(f"{path} has no generation {generation}")
        return spark.read.parquet(path)
    schema = T.StructType.fromJson(manifest["schema"])
    out = None
    for own in (False, True):  # what was there before the first generation has no folder of its own
        root = f"{path}/{_DATA}" if own else path
        reader = spark.read.option("basePath", root).schema(
            T.StructType([*schema, T.StructField(_GENERATION, T.StringType())]) if own else schema)
        paths = [f"{root}/{_GENERATION}={p['folder']}/{v}" if own else f"{root}/{v}"
                 for p in manifest["parts"] if (p["folder"] is not None) == own for v in p["versions"]]
        if paths:
            part = reader.parquet(*paths).select(*schema.names)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _add_to_generation(out: DataFrame, path: str, status: str, replace: bool) -> int:
    """Write ``out`` beside the table and commit it; without ``replace`` the versions it has grow."""
    spark = out.sparkSession
    folder = uuid.uuid4().hex
    inside = f"{_DATA}/{_GENERATION}={folder}"
    try:
        out.write.partitionBy(status).parquet(f"{path}/{inside}")
    except BaseException:
        Hadoop(spark, path).drop(inside)
        raise
    written = _version_folders(spark, path, inside)
    whole = spark.read.parquet(path).schema if current(spark, path) is None else None

    def change(before: dict | None) -> dict:
        if before is None:
            before = {"schema": whole.jsonValue(), "parts": [{"folder": None, "versions": _version_folders(spark, path)}]}
        gone = set(written) if replace else set()
        parts = [{**p, "versions": [v for v in p["versions"] if v not in gone]} for p in before["parts"]]
        parts.append({"folder": folder, "versions": written})
        return {**before, "parts": [p for p in parts if p["versions"]]}

    return commit(spark, path, change)


def vacuum_output(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete data that none of the newest ``keep`` generations has; see :func:`generations.vacuum`."""
    return vacuum(spark, path, lambda m: {f"{_GENERATION}={p['folder']}" for p in m["parts"]}, _DATA, keep)


def save_output_data(df: DataFrame, path: str, *, target: DataFrame | None = None,
                     dtype: Mapping[str, str] | None = None, delete_before_insert: bool = False,
                     status_col: str = "STATUS_ZAPISA") -> DataFrame:
    """Append to the Parquet table at ``path``, which is partitioned by version.

    ``target`` is the existing table (read from ``path`` when not given); columns
    it lacks are dropped.  With ``delete_before_insert`` the versions occurring in
    ``df`` are replaced, in one commit, and all others stay; ``df`` may be computed from the table itself.
    From the first replacement on the table has generations: appends are commits too, and
    :func:`read_output` reads it.  A job that fails at any time leaves the generation before.
    Returns the columns written.
    """
    spark = df.sparkSession
    target = read_output(spark, path) if target is None else target
    out = align_to_target(df, target, dtype)
    status = _version_column(out.columns, status_col)
    if delete_before_insert and not out.filter(F.col(status).isNull()).isEmpty():
        raise ValueError("rows without a version cannot replace a version")
    if delete_before_insert or current(spark, path) is not None:
        stored = read_output(spark, path).schema
        _add_to_generation(out.select(*[F.col(c).cast(stored[c].dataType) for c in out.columns]), path, status,
                           delete_before_insert)
    else:
        out.write.mode("append").partitionBy(status).parquet(path)
    return out


def save_output_jdbc(df: DataFrame, url: str, table: str, *, target: DataFrame,
                     properties: Mapping[str, str], dtype: Mapping[str, str] | None = None,
                     batchsize: int = 50_000) -> None:
    """Append to a database table in batches."""
    align_to_target(df, target, dtype).write.format("jdbc").options(
        url=url, dbtable=table, batchsize=batchsize, **properties).mode("append").save()


def save_csv(df: DataFrame, path: str, **options: str) -> None:
    """CSV with a header; a failed job leaves the old files in place."""
    writer = df.write.options(**({"header": "true"} | options))
    replace_path(df.sparkSession, path, writer.csv)
