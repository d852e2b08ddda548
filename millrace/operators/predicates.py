"""The rules of a screen as predicates.

Filters keep what is unknown: a row goes only if a known value fails. Each is written as a
disjunction that the Parquet reader can take whole (``x IS NULL OR x >= t OR x <= -t``). The
watch alert has the opposite rule: what is unknown is no hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.values import present
from millrace.sources.settings import Settings


def keeps_drop(drop: Column, threshold: float) -> Column:
    t = float(threshold)
    return drop.isNull() | (drop >= t) | (drop <= -t)


def keeps_cap(cap: Column, floor: float) -> Column:
    return cap.isNull() | (cap >= float(floor))


def keeps_pe(pe: Column, most: float | None) -> Column:
    return pe.isNull() | (pe <= float(most)) if most else F.lit(True)


def keeps_dividend(pays: Column, only: bool) -> Column:
    return pays.isNull() | pays if only else F.lit(True)


def keeps_sector(sector: Column, excluded: tuple[str, ...]) -> Column:
    """No excluded name holds the sector or is held in it, case aside."""
    if not excluded:
        return F.lit(True)
    own = F.lower(sector)
    clash = [F.contains(own, F.lit(x.lower())) | F.contains(F.lit(x.lower()), own) for x in excluded]
    return ~present(sector) | ~reduce(Column.__or__, clash)


def keeps(s: Settings, column=F.col) -> Column:
    """All filters; ``column`` finds a candidate's field by its column name."""
    rules = [
        keeps_drop(column("drop_pct"), s.drop_threshold),
        keeps_cap(column("market_cap_usd"), s.cap_usd),
        keeps_pe(column("fwd_pe"), s.max_pe),
        keeps_dividend(column("pays_dividend"), s.dividend_payers_only),
        keeps_sector(column("sector"), s.excluded_sectors),
    ]
    return reduce(Column.__and__, rules)


def is_hit(drop: Column, threshold: float) -> Column:
    t = float(threshold)
    return F.coalesce((drop >= t) | (drop <= -t), F.lit(False))
