"""Filtering candidates, counting what the filters do, and saying what they can't see.

``rows`` is a table of candidates with ``pos``, the published order; it holds one snapshot or,
with ``by``, many, each cut and counted on its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import counted, present
from millrace.sources.schema import CANDIDATE, COLUMNS
from millrace.sources.settings import Settings

from .predicates import keeps

# Verdicts in their order, with the words of their tallies.
VERDICTS = (("real bargain", "bargain", "real bargain"), ("wait and see", "wait", "to watch"), ("value trap", "trap", "value trap"))


def screen(rows: DataFrame, s: Settings, by: str | None = None) -> DataFrame:
    """The first ``candidate_count`` rows (all if it is None), in published order, that pass every filter."""
    kept = rows.where(keeps(s))
    if s.candidate_count is None:
        return kept
    if by is None:
        return kept.orderBy("pos").limit(s.candidate_count)
    # a rank limit that Spark applies before the shuffle
    rank = F.row_number().over(Window.partitionBy(by).orderBy("pos"))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= s.candidate_count).drop("_rank")


def screen_array(candidates: Column, s: Settings) -> Column:
    """The same inside one row: an array of candidates, without exploding or shuffling."""
    fields = {column: field for field, column in COLUMNS.items()}
    known = F.filter(F.coalesce(candidates, F.array().cast(T.ArrayType(CANDIDATE))), lambda c: c.isNotNull())
    kept = F.filter(known, lambda c: keeps(s, lambda name: c[fields[name]]))
    return kept if s.candidate_count is None else F.slice(kept, 1, s.candidate_count)


def filter_stats(rows: DataFrame, s: Settings, by: str | None = None) -> DataFrame:
    """``total, shown`` and, over all rows, how many lack P/E, market cap and sector."""
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.least(F.count_if(keeps(s)), F.lit(s.candidate_count).cast("long")).alias("shown"),
        F.count_if(F.col("fwd_pe").isNull()).alias("missing_fwd_pe"),
        F.count_if(F.col("market_cap_usd").isNull()).alias("missing_market_cap_usd"),
        F.count_if(~present(F.col("sector"))).alias("missing_sector"),
    )


def blind_spots(s: Settings) -> Column:
    """Messages, for a row of ``filter_stats``, about limits that some rows have no figure for."""
    spots = []
    if s.max_pe:
        spots.append(("missing_fwd_pe", " with no P/E on file"))
    if s.min_market_cap != "M500":
        spots.append(("missing_market_cap_usd", " with no market cap"))
    if s.excluded_sectors:
        spots.append(("missing_sector", " with no sector"))
    messages = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text))) for c, text in spots]
    return F.array_compact(F.array(*messages).cast("array<string>"))


def live_effect(stats: DataFrame, s: Settings) -> DataFrame:
    gaps = blind_spots(s)
    return stats.select(
        F.concat(F.col("shown").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" in today's brief match")).alias("effect"),
        F.when(F.size(gaps) > 0, F.concat(F.array_join(gaps, ", "), F.lit(" — those can't be ruled out, so they stay."))).alias("gap"),
    )


def verdict_tallies(shown: DataFrame) -> DataFrame:
    """``rank, verdict, class, label, n``: known verdicts that occur, in their fixed order."""
    spark = shown.sparkSession
    verdicts, classes, labels = (list(c) for c in zip(*VERDICTS))
    kinds = spark.createDataFrame(pa.table({"rank": pa.array(range(len(VERDICTS)), pa.int32()), "verdict": verdicts, "class": classes, "label": labels}))
    counts = shown.groupBy(F.lower(F.coalesce("verdict", F.lit(""))).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "verdict").select("rank", "verdict", "class", "label", "n")


def summary(stats: DataFrame, note: Column) -> DataFrame:
    """The head of a brief: count, note, how much was screened, or that nothing matches."""
    total, shown = F.col("total"), F.col("shown")
    return stats.select(
        counted(shown, "candidate").alias("count_text"),
        F.when(present(note), note).alias("note"),
        F.when(total > shown, F.concat(F.lit("Screened "), total.cast("string"), F.lit(" · showing the "), shown.cast("string"), F.lit(" that match your settings"))).alias("screened_text"),
        F.when(shown == 0, F.concat(F.lit("The morning run found "), counted(total, "candidate"), F.lit(", but none get through your filters. Loosen them in Settings."))).alias("nothing_text"),
    )
