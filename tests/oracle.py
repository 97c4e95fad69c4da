"""Compare a registered Spark plan with its SQL statement on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from factweave.plans.registry import NAMES


def duck(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return connection


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, root: str, key: str, plan, sql: str | None, connection=None):
    """Return (ok, message)."""
    start = time.time()
    df = plan(spark, root)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    types = {n: t for n, t in df.dtypes}
    if sql is None:
        return bool(got), f"{key}: {len(got)} rows, no SQL ({spent:.1f}s)"
    connection = connection or duck(root)
    start = time.time()
    cursor = connection.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    tail = f"({spent:.1f}s / {time.time() - start:.1f}s)"
    if got_names != want_names:
        return False, f"{key}: columns {got_names} != {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        lacking = [r for r in want if r not in set(got)][:2] if len(want) < 50000 else []
        first = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), None)
        pair = (got[first], want[first]) if first is not None else None
        return False, f"{key}: {len(got)} vs {len(want)} rows {tail}\n  names {got_names}\n  spark only {extra}\n  sql only {lacking}\n  first {pair}"
    pairs = {n: (types[n], want_types[n]) for n in types}
    odd = {n: p for n, p in pairs.items() if _kind(p[0]) != _kind(p[1])}
    note = f" types {odd}" if odd else ""
    return True, f"{key}: {len(got)} rows ok {tail}{note}"


def _kind(t: str) -> str:
    t = t.lower()
    for a, b in (("varchar", "string"), ("integer", "int"), ("hugeint", "decimal")):
        t = t.replace(a, b)
    return t.split("(")[0]


def main(argv: list[str]) -> int:
    from tests.conftest import make_session

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    sf, wanted = argv[0], argv[1:]
    root = f"/root/testdata/sf{sf}"
    spark = make_session()
    connection = duck(root)
    plans, statements = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in plans:
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(spark, root, key, plans[key], statements.get(key), connection)
        except Exception as error:  # report every key
            ok, message = False, f"{key}: {type(error).__name__} {str(error)[:500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + message, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
