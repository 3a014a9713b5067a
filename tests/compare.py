"""Compare registered queries with their SQL twins: python tests/compare.py FOLDER [names]."""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, float) and value != value:
        return None
    return str(value) if value is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([normal(row[i]) for i in order] for row in rows), key=str), [columns[i] for i in order]


def difference(spark, name, query, sql, folder):
    """None when equal, else a text."""
    import duckdb

    got_df = query(spark, folder)
    got, got_names = rows_of(got_df.columns, [tuple(r) for r in got_df.collect()])
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(sql)
    want, want_names = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n   got  {dict(zip(got_names, g))}\n   want {dict(zip(want_names, w))}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallystone.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    found, sqls = entry.queries(), entry.oracle_sql()
    for query_name in sys.argv[2:] or list(found):
        began = time.time()
        if query_name not in sqls:
            n = found[query_name](spark, sys.argv[1]).count()
            print(f"ROWS  {query_name} {n} {time.time() - began:.1f}s", flush=True)
            continue
        try:
            problem = difference(spark, query_name, found[query_name], sqls[query_name], sys.argv[1])
        except Exception as error:  # noqa: BLE001
            problem = str(error)[:900]
        print(f"{'OK   ' if problem is None else 'FAIL '} {query_name} {time.time() - began:.1f}s {problem or ''}", flush=True)
