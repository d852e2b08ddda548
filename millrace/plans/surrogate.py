"""Candidates made from the ``part`` table, for queries on tables that hold no snapshots.

The expressions are plain SQL that Spark and DuckDB both read, so a query and its oracle
start from the same rows. Nulls, empty texts, rises and ties of rounding are put in by
residues of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.schema import COLUMNS

EXPRESSIONS = {
    "pos": "p_partkey",
    "ticker": "CASE WHEN p_partkey % 53 = 0 THEN '' ELSE upper(p_brand) END",
    "name": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END",
    "exchange": "CASE p_partkey % 7 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'TSX' WHEN 3 THEN '' WHEN 4 THEN 'LSE' WHEN 5 THEN 'TSX' ELSE NULL END",
    "currency": "CASE WHEN p_partkey % 7 = 2 THEN 'CAD' WHEN p_partkey % 7 = 1 AND p_partkey % 2 = 0 THEN 'CAD' ELSE NULL END",
    "sector": "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END",
    "drop_pct": "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN (p_partkey % 25) * CAST(1.25 AS DOUBLE) ELSE -(p_partkey % 25) * CAST(1.25 AS DOUBLE) END",
    "drop_window": "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '5 days' END",
    "market_cap_usd": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice * p_size * CAST(120000 AS DOUBLE) END",
    "fwd_pe": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) - CAST(5 AS DOUBLE) END",
    "pays_dividend": "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "verdict": "CASE p_partkey % 5 WHEN 0 THEN 'Real Bargain' WHEN 1 THEN 'wait and see' WHEN 2 THEN 'VALUE TRAP' WHEN 3 THEN 'other' ELSE NULL END",
    "cause_type": "CASE p_partkey % 4 WHEN 0 THEN 'one-off' WHEN 1 THEN 'Fixable' WHEN 2 THEN 'permanent' ELSE NULL END",
    "business": "concat('makes ', p_name)",
    "price": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice / CAST(8 AS DOUBLE) END",
    "prev_close": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice / CAST(8 AS DOUBLE) + CAST(p_partkey % 7 AS DOUBLE) - CAST(2 AS DOUBLE) END",
    "low52": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice / CAST(8 AS DOUBLE) - CAST(p_partkey % 40 AS DOUBLE) + CAST(4 AS DOUBLE) END",
    "high52": "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_retailprice / CAST(8 AS DOUBLE) + CAST(p_partkey % 30 AS DOUBLE) - CAST(3 AS DOUBLE) END",
}

#: A deep watchlist made from the same rows: lower-case tickers, some empty, duplicates.
DEEP = "(ticker LIKE 'BRAND#1%' OR ticker = '') AND fwd_pe > 10"
DEEP_TICKER = "CASE WHEN pos % 8 = 0 THEN '' ELSE lower(ticker) END"
USER_LIST = ("brand#11", "BRAND#13", "xom", "Brand#22", "brand#11", "BRAND#9", "ZZZ")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*[f"{e} AS {c}" for c, e in EXPRESSIONS.items()])


def deep_list(rows: DataFrame) -> DataFrame:
    return rows.where(DEEP).selectExpr("pos", f"{DEEP_TICKER} AS ticker", *[c for c in rows.columns if c not in ("pos", "ticker")])


#: Which snapshot a candidate belongs to: so many candidates each, whatever the table's size.
SNAPSHOT = "CAST(floor(pos / CAST(40 AS DOUBLE)) AS BIGINT)"
#: Candidates that are on their snapshot's own watch list too.
WATCHED = "drop_window = '5 days'"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshot, value``: the text of each snapshot as it would be published."""
    fields = {column: field for field, column in COLUMNS.items()}
    rows = candidates(spark, sf_dir)
    c = F.struct(*[F.col(column).alias(field) for column, field in fields.items() if column in rows.columns])
    pair = F.struct("pos", c.alias("c"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda p: p["c"])
    lists = rows.groupBy(F.expr(SNAPSHOT).alias("snapshot")).agg(ordered(pair).alias("candidates"), ordered(F.when(F.expr(WATCHED), pair)).alias("watch"))
    return lists.select("snapshot", F.to_json(F.struct(F.lit("2026-08-04T10:30:00Z").alias("generatedAt"), F.struct("candidates", "watch").alias("brief"))).alias("value"))


def candidates_sql() -> str:
    return "WITH cand AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in EXPRESSIONS.items()) + " FROM part)"
