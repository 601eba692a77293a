"""Run registered queries in Spark and their SQL in DuckDB and compare.

    python check_oracles.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import importlib
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(int(value))
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "DATE": "date",
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    want_cols, want = normal(names, result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, first: {str(bad[0][0])[:400]} != {str(bad[0][1])[:400]}"
    types = {c: k for c, k in df.dtypes}
    off = {c: (types[c], kinds[c]) for c in types if types[c] != kinds[c] and not (types[c].startswith("timestamp") and kinds[c].startswith("timestamp"))}
    return f"types {off}" if off else None


def main() -> int:
    from lodestar.session import local_session

    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    entry = importlib.import_module("__spark_entry__")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(folder), 0
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = compare(run(spark, folder), con, oracles[name])
            else:
                n = len(run(spark, folder).collect())
                problem = None if n else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
