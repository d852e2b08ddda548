"""Rows as they are shown: prices, the place in the year's range, verdicts, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import DASH, drop_text, finite, long_day, money, not_available, percent, present, weekday
from millrace.sources.settings import STALE_AFTER_MS

from .screen import VERDICTS

# Classes of causes, and the captions of the range.
CAUSES = {"one-off": "oneoff", "fixable": "fixable", "permanent": "permanent"}
BUCKETS = (
    (0.12, "Trading at the bottom of its 52-week range."),
    (0.33, "In the lower third of its 52-week range."),
    (0.66, "Around mid-range for the past year."),
)
TOP_BUCKET, NO_RANGE = "Still in the upper third of its 52-week range.", "52-week range not confirmed"
METRICS_SHOWN = 8


def _looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(F.coalesce(key, F.lit("")))), F.lit(default))


def verdict_class(verdict: Column) -> Column:
    return _looked_up(verdict, {v: c for v, c, _ in VERDICTS}, "neutral")


def verdict_label(verdict: Column) -> Column:
    return F.when(present(verdict), verdict).otherwise(F.lit("unrated"))


def cause_class(cause_type: Column) -> Column:
    return _looked_up(cause_type, CAUSES, "neutral")


def range_position(value: Column, price: Column, low: Column, high: Column) -> Column:
    """Where ``value`` lies between low and high, cut to 0 and 1; null unless the price and
    both ends are finite and the high is above the low."""
    ok = finite(price) & finite(low) & finite(high) & finite(value) & (high > low)
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low))))


def range_caption(position: Column) -> Column:
    out = F.when(position.isNull(), F.lit(NO_RANGE))
    for most, text in BUCKETS:
        out = out.when(position <= most, F.lit(text))
    return out.otherwise(F.lit(TOP_BUCKET))


def shown_metrics(metrics: Column) -> Column:
    shown = F.transform(
        F.slice(metrics, 1, METRICS_SHOWN),
        lambda m: F.struct(F.coalesce(m["label"], F.lit("")).alias("label"), F.when(not_available(m["value"]), F.lit(DASH)).otherwise(m["value"]).alias("value")),
    )
    return F.coalesce(shown, F.array().cast("array<struct<label:string,value:string>>"))


def text_or_null(x: Column) -> Column:
    return F.when(present(x), x)


def tearsheet(rows: DataFrame) -> DataFrame:
    """One row per candidate, every part as it is shown; parts that are not shown are null."""
    now = range_position(F.col("price"), F.col("price"), F.col("low52"), F.col("high52"))
    prev = range_position(F.col("prev_close"), F.col("price"), F.col("low52"), F.col("high52"))
    return rows.withColumns({"_now": now, "_prev": prev}).select(
        "pos",
        F.when(present(F.col("ticker")), F.col("ticker")).otherwise(F.lit(DASH)).alias("ticker"),
        text_or_null(F.col("exchange")).alias("exchange"),
        verdict_label(F.col("verdict")).alias("verdict"),
        verdict_class(F.col("verdict")).alias("verdict_class"),
        text_or_null(F.col("name")).alias("name"),
        money(F.col("price"), F.col("currency")).alias("price_text"),
        F.when(finite(F.col("prev_close")), money(F.col("prev_close"), F.col("currency"))).alias("prev_text"),
        drop_text(F.col("drop_pct")).alias("drop_text"),
        F.when(present(F.col("drop_window")), F.concat(F.lit("over "), F.col("drop_window"))).alias("window_text"),
        F.col("_now").alias("range_now"),
        percent(F.col("_now")).alias("range_text"),
        range_caption(F.col("_now")).alias("range_caption"),
        F.when(F.col("_prev") > F.col("_now"), F.struct(percent(F.col("_now")).alias("left"), percent(F.col("_prev") - F.col("_now")).alias("width"))).alias("drop_segment"),
        text_or_null(F.col("business")).alias("business"),
        text_or_null(F.col("cause")).alias("cause"),
        text_or_null(F.lower("cause_type")).alias("cause_type"),
        cause_class(F.col("cause_type")).alias("cause_class"),
        shown_metrics(F.col("metrics")).alias("metrics"),
        text_or_null(F.col("must_go_right")).alias("must_go_right"),
        text_or_null(F.col("could_go_wrong")).alias("could_go_wrong"),
    )


def watch_row_text(entries: DataFrame) -> DataFrame:
    """``openable, text`` beside the columns of watch entries."""
    has = F.col("candidate").isNotNull()
    quiet = F.when(F.col("deep"), F.lit("no reading this morning")).otherwise(F.lit("no double-digit fall today"))
    return entries.withColumns({"openable": has, "text": F.when(has, F.coalesce(F.col("candidate.name"), F.lit(""))).otherwise(quiet)})


def is_stale(generated_ms: Column, as_of_ms: Column, after_ms: int = STALE_AFTER_MS) -> Column:
    return as_of_ms - generated_ms > after_ms


def stale_text(generated_ms: Column, as_of_ms: Column) -> Column:
    day = weekday(F.timestamp_millis(generated_ms))
    return F.when(is_stale(generated_ms, as_of_ms), F.concat(F.lit("This brief is from "), day, F.lit(". Pull down to refresh.")))


def generated_text(generated_ms: Column) -> Column:
    return long_day(F.timestamp_millis(generated_ms))
