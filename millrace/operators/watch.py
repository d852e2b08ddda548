"""Watched tickers: the deep list of a snapshot, the user's own list, and the day's screen.

The three inputs are tables with ``pos`` and ``ticker``; those of candidates carry the
candidate's other columns too. Only rows of watched tickers are aggregated, so the day's
screen is semi-joined before anything is shuffled by ticker.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .predicates import is_hit


def upper_ticker(ticker: Column) -> Column:
    return F.upper(F.coalesce(ticker.cast("string"), F.lit("")))


def user_list(spark: SparkSession, tickers: tuple[str, ...]) -> DataFrame:
    """``pos, ticker`` of a list in settings. From Arrow it is a local relation whose size Spark
    knows, so joins with it are broadcast while it is small and the screen is not shuffled."""
    return spark.createDataFrame(pa.table({"pos": pa.array(range(len(tickers)), pa.int64()), "ticker": pa.array(list(tickers), pa.string())}))


def first_wins(rows: DataFrame, key: Column) -> DataFrame:
    """``t, c``: of the rows with one key the first, as a struct."""
    return rows.groupBy(key.alias("t")).agg(F.min_by(F.struct(*rows.columns), "pos").alias("c"))


def last_wins(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("t")).agg(F.max_by(F.struct(*rows.columns), "pos").alias("c"))


def watch_entries(deep: DataFrame, candidates: DataFrame, user: DataFrame) -> DataFrame:
    """``src, pos, ticker, candidate, deep``: deep entries first (src 0), then the user's (src 1),
    each ticker once. Deep ones are the first of their ticker and skip empty tickers; the
    user's carry the last candidate of theirs, unfiltered, or null."""
    top = first_wins(deep, upper_ticker(F.col("ticker"))).where("t <> ''")
    own = user.groupBy(F.upper(F.coalesce("ticker", F.lit("null"))).alias("t")).agg(F.min("pos").alias("pos"))
    own = own.join(top.select("t"), "t", "left_anti")
    watched = candidates.join(own.select("t"), upper_ticker(F.col("ticker")) == F.col("t"), "left_semi")
    hits = last_wins(watched, upper_ticker(F.col("ticker")))
    theirs = own.join(hits, "t", "left")
    return top.select(F.lit(0).alias("src"), F.col("c.pos").alias("pos"), F.col("t").alias("ticker"), F.col("c").alias("candidate"), F.lit(True).alias("deep")).unionByName(
        theirs.select(F.lit(1).alias("src"), "pos", F.col("t").alias("ticker"), F.col("c").alias("candidate"), F.lit(False).alias("deep"))
    )


def entries_before_any_brief(user: DataFrame) -> DataFrame:
    """The user's list as it stands, duplicates too, without candidates."""
    return user.select("pos", "ticker", F.lit(False).alias("deep"))


def watched_candidates(candidates: DataFrame, user: DataFrame) -> DataFrame:
    own = user.select(F.upper("ticker").alias("_t")).distinct()
    return candidates.join(own, upper_ticker(F.col("ticker")) == F.col("_t"), "left_semi")


def watch_hit(deep: DataFrame, candidates: DataFrame, user: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """The first of deep list and watched candidates whose drop is known and large enough: one row or
    none; with ``by``, for each snapshot."""
    both = deep.withColumn("src", F.lit(0)).unionByName(watched_candidates(candidates, user).withColumn("src", F.lit(1)), allowMissingColumns=True)
    hits = both.where(is_hit(F.col("drop_pct"), threshold))
    if by is None:
        return hits.orderBy("src", "pos").limit(1)
    rest = [c for c in both.columns if c != by]
    return hits.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct("src", "pos")).alias("h")).select(by, "h.*")
