"""Compare every registered query with its SQL twin, and look at its plan.

    python tools/check_oracles.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fillgauge.operators import cumulative, rankcuts, robust, sampling  # noqa: E402
from fillgauge.queries import ORACLES, QUERIES  # noqa: E402
from fillgauge.session import build_session, clear_work  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


#: Plan nodes no query may have: row-wise Python and joins of all pairs.
BARRED = ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


#: Rows that may meet in one partition: counts per task or bucket, never rows of a table.
ONE_PARTITION_ROWS = 10_000
#: The largest group that one task may order is set to this, so the ways for large groups run too.
cumulative.MAX_GROUP_ROWS = robust.MAX_GROUP_ROWS = 4_000
rankcuts.MAX_BUCKET_ROWS = sampling.MAX_BUCKET_ROWS = 4_000


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def sorted_rows(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    # -0.0 and 0.0 are the same value
    clean = [tuple((r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))


def last_execution(spark) -> int:
    """Number of executions that the session has begun."""
    store = spark._jsparkSession.sharedState().statusStore()
    return max((e.executionId() for e in _each(store.executionsList())), default=-1)


def _each(found):
    """A Scala collection as a list."""
    return [found.apply(i) for i in range(found.size())]


def barred_nodes(spark, after: int) -> list[str]:
    """What the plans of all executions since ``after`` have that they should not have.

    Eager jobs of an operator count too.  An exchange into one partition is barred if it
    carried rows by the table rather than by the task or bucket.
    """
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    store = spark._jsparkSession.sharedState().statusStore()
    found = []
    for execution in _each(store.executionsList()):
        number = execution.executionId()
        if number <= after:
            continue
        values = store.executionMetrics(number)
        for node in _each(store.planGraph(number).allNodes()):
            found += [b for b in BARRED if b in node.name()]
            if node.name() == "Exchange" and "SinglePartition" in node.desc():
                for metric in _each(node.metrics()):
                    if metric.name() == "shuffle records written":
                        text = values.get(metric.accumulatorId())
                        rows = int(text.get().replace(",", "")) if text.isDefined() else 0
                        if rows > ONE_PARTITION_ROWS:
                            found.append(f"{rows} rows in one partition")
    return sorted(set(found))


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    seen = last_execution(spark)
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    barred = barred_nodes(spark, seen)
    if barred:
        return False, f"plans have {barred}"
    if name not in ORACLES:
        return bool(got), f"{len(got)} rows, no SQL"
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} but SQL {sorted(names)}"
    a, b = sorted_rows(got, df.columns), sorted_rows(want, names)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} rows, SQL {len(b)}; {sorted(names)}; {diff}"
    odd = [f"{n}:{t}" for n, t in types.items() if t in ("HUGEINT",) or t.startswith("DECIMAL")]
    kinds = dict(df.dtypes)
    for n, t in types.items():
        pairs = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean"}
        if t in pairs and pairs[t] != kinds[n]:
            odd.append(f"{n}: {kinds[n]} but SQL {t}")
    return not odd, f"{len(a)} rows" + (f"; types {odd}" if odd else "")


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(opts.sf)
    failed = []
    for name in opts.names or QUERIES:
        t0 = time.time()
        try:
            ok, text = compare(spark, con, name, opts.sf)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, text = False, "".join(traceback.format_exception_only(exc))[:600]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {text if not ok else text[:80]}",
              flush=True)
        if not ok:
            failed.append(name)
        clear_work(spark)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
