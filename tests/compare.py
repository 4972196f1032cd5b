"""Compare every query with its SQL in DuckDB: `python tests/compare.py [sf] [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.session import local_session, table_views  # noqa: E402


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in values), key=repr)


TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def spark_rows(df) -> tuple[list[tuple], list[tuple]]:
    """(column name and type, sorted; rows, sorted)."""
    columns = sorted((f.name, TYPES.get(f.dataType.simpleString(), "?")) for f in df.schema)
    return columns, rows(df.columns, df.collect())


def duck_rows(sf_dir: str, sql: str) -> tuple[list[tuple], list[tuple]]:
    with duckdb.connect() as con:
        table_views(con, sf_dir)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        types = sorted((d[0], str(d[1])) for d in result.description)
        return types, rows(columns, result.fetchall())


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.monotonic()
        try:
            columns, got = spark_rows(query(spark, sf_dir))
        except Exception as error:
            failed += 1
            print(f"FAIL {name}: {str(error)[-1500:]}", flush=True)
            continue
        took = time.monotonic() - started
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows, {took:.2f} s")
            continue
        try:
            wanted_columns, wanted = duck_rows(sf_dir, oracles[name])
        except duckdb.Error as error:
            failed += 1
            print(f"FAIL {name}: SQL: {str(error)[:600]}", flush=True)
            continue
        same = columns == wanted_columns and got == wanted
        failed += not same
        print(f"{'ok  ' if same else 'FAIL'} {name}: {len(got)} rows, {took:.2f} s", flush=True)
        if not same:
            print("  columns", set(columns) ^ set(wanted_columns), "rows", len(got), len(wanted))
            for side, a, b in (("spark only", got, wanted), ("sql only", wanted, got)):
                for row in [r for r in a if r not in set(b)][:3]:
                    print("  ", side, row)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]) > 0)
