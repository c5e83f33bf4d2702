"""Runs a query and its DuckDB SQL over the same tables."""

from pathlib import Path

import duckdb


def rows(result, columns) -> list:
    return sorted(tuple(str(r[c]) for c in columns) for r in result)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    got = [r.asDict() for r in query(spark, sf_dir).collect()]
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    if got:
        assert sorted(got[0]) == sorted(names)
    assert rows(got, names) == rows(want, names)
