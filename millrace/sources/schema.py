"""Schemas of published snapshots. Every field may be null; none is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC = T.StructType().add("label", "string").add("value", "string")

_TEXT = "ticker name exchange currency dropWindow verdict business cause right wrong causeType sector".split()
_NUMBER = "dropPct price prevClose low52 high52 marketCapUsd fwdPe".split()

CANDIDATE = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT] + [T.StructField(n, T.DoubleType()) for n in _NUMBER])
CANDIDATE = CANDIDATE.add("paysDividend", "boolean").add("metrics", T.ArrayType(METRIC))

BRIEF = T.StructType().add("asOf", "string").add("note", "string").add("candidates", T.ArrayType(CANDIDATE)).add("watch", T.ArrayType(CANDIDATE))
PAYLOAD = T.StructType().add("generatedAt", "string").add("brief", BRIEF)
DEEP_WATCHLIST = T.StructType().add("tickers", T.ArrayType(T.StringType()))

#: Column names of exploded candidates, by field.
COLUMNS = {
    "ticker": "ticker", "name": "name", "exchange": "exchange", "currency": "currency", "dropWindow": "drop_window",
    "verdict": "verdict", "business": "business", "cause": "cause", "right": "must_go_right", "wrong": "could_go_wrong",
    "causeType": "cause_type", "sector": "sector", "dropPct": "drop_pct", "price": "price", "prevClose": "prev_close",
    "low52": "low52", "high52": "high52", "marketCapUsd": "market_cap_usd", "fwdPe": "fwd_pe",
    "paysDividend": "pays_dividend", "metrics": "metrics",
}


def exploded(array: Column) -> list[Column]:
    """``pos`` and the candidate, for a select; null elements and a missing array give no rows
    when followed by ``flat``."""
    return [F.posexplode(F.coalesce(array, F.array().cast(T.ArrayType(CANDIDATE)))).alias("pos", "c")]


def flat(struct: str = "c") -> list[Column]:
    """A candidate's fields as columns. A number that is not one (NaN) is unknown."""
    out = []
    for name, column in COLUMNS.items():
        x = F.col(f"{struct}.{name}")
        out.append((F.when(~F.isnan(x), x) if name in _NUMBER else x).alias(column))
    return out
