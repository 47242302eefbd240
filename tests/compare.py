"""Run registered queries next to their SQL and compare schema and rows.

    python tests/compare.py [--sf DIR] [--master local[8]] [name prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _kind(v) -> str:
    return "none" if v is None else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(row[i]) for i in order) for row in rows),
                  key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}


def type_gaps(df, con, oracle: str) -> list[str]:
    theirs = {r[0]: r[1] for r in con.execute(f"describe {oracle}").fetchall()}
    return [f"{c} {t} vs {theirs.get(c)}" for c, t in df.dtypes if SQL_TYPES.get(t) != theirs.get(c)]


# Queries whose feature is a solve, a decomposition, a recursion or a tail probability.
PYTHON_NODES = ("m03_enet", "m04", "m05_nested", "m08", "m09_nested", "m10_sector_ic_tested", "m13_coupling_p",
                "m14_welch_p", "p14", "p15", "p16_variant", "d03_ljung_box_p", "d07", "d08", "d10", "d11", "d12")


def plan_gaps(df, name: str) -> list[str]:
    """Physical operators that must not appear in a query's plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    banned = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
    if not name.startswith(PYTHON_NODES):
        banned += ["ArrowEvalPython", "InPandas", "MapInPandas"]
    return [b for b in banned if b in plan]


def compare(spark, con, name: str, fn, oracle: str | None, sf: str) -> tuple[bool, str]:
    df = fn(spark, sf)
    gaps = plan_gaps(df, name)
    if gaps:
        return False, f"plan holds {gaps}"
    ours = rows_of(df.columns, df.collect())
    if oracle is None:
        return len(ours) > 0, f"{len(ours)} rows, no SQL"
    got = con.execute(oracle)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        return False, f"{len(ours)} rows vs {len(theirs)}"
    if not ours:
        return False, "no rows on either side"
    gaps = type_gaps(df, con, oracle)
    if gaps:
        return False, f"types differ: {gaps}"
    bad = [(a, b) for a, b in zip(ours, theirs)
           if any(x != y or _kind(x) != _kind(y) for x, y in zip(a, b))]
    if bad:
        return False, f"{len(bad)} of {len(ours)} rows differ over {sorted(names)}: {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(ours)} rows match"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from crosspanel.session import local_session
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark, con, failed = local_session(8), oracle_connection(sf), []
    oracles = oracle_sql()
    for name, fn in queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            ok, text = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as exc:                                    # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {time.time() - start:6.1f}s  {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
