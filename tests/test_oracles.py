"""Every oracle is SQL that DuckDB runs."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_oracles_are_sql():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str), name
        con.execute(sql).fetchone()
