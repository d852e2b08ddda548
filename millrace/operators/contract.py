"""The publisher's data contract as checks: what a row breaks, and whether a snapshot may go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import present, trim, word_count

# Allowed words, word limits and the bounds of the wide screen.
VERDICTS = ("real bargain", "wait and see", "value trap")
CAUSES = ("one-off", "fixable", "permanent")
EXCHANGES = ("NYSE", "NASDAQ", "TSX")
WORD_LIMITS = {"business": 14, "cause": 30, "must_go_right": 18, "could_go_wrong": 18}
NOTE_WORDS, SCREEN_SIZE, LEAST_FALL, LEAST_PRICE, LEAST_CAP = 20, 6, 10.0, 1.0, 5e8
NUMBERS = ("dropPct", "price", "prevClose", "low52", "high52", "marketCapUsd", "fwdPe")


def _one_of(x: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(x).isin(*[a.lower() for a in allowed]), F.lit(False))


def valid_verdict(verdict: Column) -> Column:
    return _one_of(verdict, VERDICTS)


def valid_cause(cause_type: Column) -> Column:
    return _one_of(cause_type, CAUSES)


def valid_exchange(exchange: Column) -> Column:
    return F.coalesce(exchange.isin(*EXCHANGES), F.lit(False))


def valid_currency(currency: Column, exchange: Column) -> Column:
    """CAD on the Toronto exchange, absent elsewhere."""
    toronto = exchange.eqNullSafe(F.lit("TSX"))
    return (toronto & currency.eqNullSafe(F.lit("CAD"))) | (~toronto & currency.isNull())


def valid_sector(sector: Column) -> Column:
    return present(trim(F.coalesce(sector, F.lit(""))))


def valid_generated_at(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}T.*Z$"), F.lit(False)) & F.try_to_timestamp(text).isNotNull()


def violations(columns: list[str]) -> Column:
    """Names of the rules that a candidate row breaks; word limits for the columns that exist."""
    rules = {
        "verdict": valid_verdict(F.col("verdict")),
        "cause": valid_cause(F.col("cause_type")),
        "exchange": valid_exchange(F.col("exchange")),
        "currency": valid_currency(F.col("currency"), F.col("exchange")),
        "sector": valid_sector(F.col("sector")),
    }
    rules |= {f"{c}_words": word_count(F.col(c)) <= n for c, n in WORD_LIMITS.items() if c in columns}
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def screenable(rows: DataFrame) -> DataFrame:
    """The wide screen: large enough falls of listed companies, at most six, in published order."""
    fits = (F.col("drop_pct") <= -LEAST_FALL) & (F.col("price") >= LEAST_PRICE) & (F.col("market_cap_usd") >= LEAST_CAP) & valid_exchange(F.col("exchange"))
    return rows.where(fits).orderBy("pos").limit(SCREEN_SIZE)


def publishable(rows: DataFrame) -> DataFrame:
    """``publishable``: there are candidates and each has an allowed verdict and cause; all or nothing."""
    good = valid_verdict(F.col("verdict")) & valid_cause(F.col("cause_type"))
    return rows.agg(F.coalesce(F.bool_and(good), F.lit(False)).alias("publishable"))


def mistyped_numbers(text: Column) -> Column:
    """Names of number fields that some candidate of a raw payload has as text."""
    # a JSON string shows as such in the raw value only, so types are read from the variant
    candidates = F.try_variant_get(F.try_parse_json(text), "$.brief.candidates", "array<variant>")
    candidates = F.coalesce(candidates, F.array().cast("array<variant>"))

    def is_text(name: str):
        return lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get(c, f"$.{name}", "variant")) == "STRING", F.lit(False))

    return F.array_compact(F.array(*[F.when(F.exists(candidates, is_text(name)), F.lit(name)) for name in NUMBERS]))


def payload_violations(text: Column) -> Column:
    """Names of the rules that a raw payload breaks as a whole: its time, and numbers sent as text."""
    stamp = F.when(~valid_generated_at(F.get_json_object(text, "$.generatedAt")), F.lit("generatedAt"))
    return F.concat(F.array_compact(F.array(stamp)), mistyped_numbers(text))
