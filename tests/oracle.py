"""Compare a query with its DuckDB text, as sorted rows with exact values."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def expected(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    return _sorted(names, rows)


def actual(df):
    rows = [tuple(r) for r in df.collect()]
    return _sorted(df.columns, rows)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(row[i] for i in order) for row in rows]
    plain.sort(key=lambda r: tuple((v is not None, v) for v in r))
    return [names[i] for i in order], plain


def compare(spark, con, name, query, sql, sf_dir) -> str:
    start = time.time()
    got_names, got = actual(query(spark, sf_dir))
    seconds = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} rows {seconds:.1f}s"
    want_names, want = expected(con, sql)
    if got_names != want_names:
        return f"FAIL columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got), key=str)[:2]
        return f"FAIL {len(got)} rows != {len(want)}: {extra}"
    for g, w in zip(got, want):
        if g != w or [type(v) for v in g] != [type(v) for v in w]:
            return f"FAIL value {g} != {w}"
    return f"ok {len(got)} rows {seconds:.1f}s"


def main(sf_dir: str, wanted: list[str]) -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tidemark.session import build_session

    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    texts = entry.oracle_sql()
    for name, query in entry.queries().items():
        if not wanted or name in wanted:
            print(name, compare(spark, con, name, query, texts.get(name), sf_dir), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
