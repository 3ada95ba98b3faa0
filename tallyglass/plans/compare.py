"""Run queries and their SQL side by side: same columns, same rows whatever their order."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """One spelling per value, so both engines' rows compare by equality."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 10) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_columns, got = df.columns, df.collect()
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"values {x!r:.300} != {y!r:.300} in {sorted(got_columns)}"
    kinds_got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds_want = {d[0]: str(d[1]) for d in result.description}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp": "TIMESTAMP"}
    odd = {c: (k, kinds_want[c]) for c, k in kinds_got.items() if k in names and names[k] != kinds_want[c]}
    return f"TYPES {odd}" if odd else None


def main(argv: list[str]) -> int:
    from tallyglass.plans import load
    from tallyglass.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    queries, oracles = load()
    spark, con, bad = local_session(8), duck(sf_dir), 0
    for key, fn in queries.items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if key in oracles:
                verdict = compare(df, con, oracles[key])
            else:
                verdict = f"(no SQL) rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += verdict is not None and not verdict.startswith("(no SQL)")
        print(f"{key:28s} {time.time() - start:6.2f}s {verdict or 'ok'}", flush=True)
    print(f"{bad} differ")
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
