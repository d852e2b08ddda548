"""Queries of the corpus operators that SQL expresses, against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace.llm import registry

from .data import SF, needs_tables, needs_vocabularies

pytestmark = [needs_tables, needs_vocabularies]


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    theirs = sorted(tuple(row[i] for i in order) for row in want.fetchall())
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == theirs


def test_every_operator_has_its_query():
    assert [n for n in registry.queries() if n.startswith("op")] == [f"op{i}_{n}" for i, n in enumerate("language_id toxicity sharding embedding_dedup minhash packing bpe_codec exact_dedup pii token_counts".split(), 1)]
