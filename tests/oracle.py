"""Compare registered queries with their SQL twins; run as a script to check a folder of tables.

    python -m tests.oracle [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (0, "nan")
    if isinstance(value, bool):
        return (1, str(int(value)))
    return (1, repr(float(value)) if isinstance(value, float) else str(value))


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, connection, folder: str, name: str, queries, oracles) -> str | None:
    result = queries[name](spark, folder)
    ours = sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    if name not in oracles:
        return None if ours[1] else "no rows"
    cursor = connection.execute(oracles[name])
    theirs = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} / {len(theirs[1])} rows"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, e.g. {wrong[0]}"
    kinds = {f.name: f.dataType.simpleString() for f in result.schema.fields}
    theirs_kinds = dict(zip([d[0] for d in cursor.description], [str(d[1]) for d in cursor.description]))
    same = {
        "bigint": {"BIGINT"},
        "int": {"INTEGER"},
        "double": {"DOUBLE"},
        "string": {"VARCHAR"},
        "boolean": {"BOOLEAN"},
        "timestamp_ntz": {"TIMESTAMP"},
    }
    odd = {c: (kinds[c], theirs_kinds[c]) for c in kinds if theirs_kinds[c] not in same.get(kinds[c], set())}
    return f"types {odd}" if odd else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from churnlake.session import get_spark

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = get_spark(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    todo = queries()
    for name in todo:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = differences(spark, connection, folder, name, todo, oracle_sql())
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in oracle_sql() else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
