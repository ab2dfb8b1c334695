"""Run queries in Spark and their SQL in DuckDB and compare the rows.

``python -m tests.compare SF_DIR [name ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, run, sql, sf_dir) -> str | None:
    """``None`` when equal, else the first difference."""
    df = run(spark, sf_dir)
    got, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    want, want_names = _rows(relation.columns, relation.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first: {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    spark_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    for n, t in zip(relation.columns, relation.types):
        if spark_types[n] in KINDS.values() and str(t) != spark_types[n]:
            return f"type of {n}: {spark_types[n]} != {t}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, failed = local_session(8), duck(sf_dir), 0
    sqls = oracle_sql()
    for name, run in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, run, sqls[name], sf_dir)
            else:
                problem = None if run(spark, sf_dir).count() >= 0 else ""
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        mark = "ok" if name in sqls else "rows"
        print(f"{time.time() - start:6.2f}s {name}: {mark if problem is None else 'DIFF ' + problem}", flush=True)
    print(f"{failed} differences")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
