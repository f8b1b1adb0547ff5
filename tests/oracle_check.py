"""Run registered queries next to their DuckDB oracle and compare names, types and values.

    python tests/oracle_check.py [name-prefix ...] [--sf 0.01] [--show]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if not math.isinf(value) else str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return "\0null" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(row[i]) for i in order) for row in rows)


def compare(spark, con, name, build, sql, folder):
    """Return (status, detail)."""
    df = build(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("rows" if spark_rows else "EMPTY"), f"{len(spark_rows)} rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    other = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return "NAMES", f"{sorted(df.columns)} != {sorted(names)}"
    detail = f"{len(spark_rows)} rows"
    bad_types = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if TYPE_NAMES.get(t, t) != types[c]]
    if len(spark_rows) != len(other):
        return "COUNT", f"{len(spark_rows)} != {len(other)}"
    left, right = rows_of(df.columns, spark_rows), rows_of(names, other)
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        return "VALUES", f"{len(diff)} differ of {len(left)}; first {str(diff[0])[:700]}"
    if bad_types:
        return "TYPES", " ".join(bad_types)
    return ("ok" if spark_rows else "EMPTY"), detail


def main(argv):
    from gleaner.session import local_session
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not argv or any(q.startswith(p) for p in argv)]
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            status, detail = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as error:  # report and go on: one broken query must not hide the others
            status, detail = "ERROR", str(error)[:900]
        failed += status not in ("ok", "rows")
        print(f"{status:7} {name:38} {time.time() - start:6.2f}s {detail}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} good")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
