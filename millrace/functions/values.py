"""Scalar rules: which values count as known, and how numbers and texts are shown.

A number is *known* if it is not null after typed parsing (infinite ones included) and
*finite* if it can be shown. A text is *present* if it is neither null nor empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
#: White space as ECMAScript trims and matches it, in a regular expression class.
SPACE = r"[\s\u000B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def finite(x: Column) -> Column:
    return F.coalesce(known(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def present(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def to_fixed(x: Column, digits: int) -> Column:
    """One or two decimals; exact ties go away from zero, everything else to the nearest."""
    ties, pattern = {1: (4.0, "0.0"), 2: (8.0, "0.00")}[digits]
    tie = (F.abs(x) * F.lit(ties)) % F.lit(2.0) == F.lit(1.0)
    return F.when(tie, F.format_string(f"%.{digits}f", x)).otherwise(F.call_function("format_number", x, F.lit(pattern)))


def money(x: Column, currency: Column) -> Column:
    sign = F.when(currency.eqNullSafe(F.lit("CAD")), F.lit("C$")).otherwise(F.lit("$"))
    return F.when(finite(x), F.concat(sign, to_fixed(x, 2))).otherwise(F.lit(DASH))


def percent(x: Column) -> Column:
    """A share as a percentage with two decimals."""
    return F.concat(to_fixed(x * 100, 2), F.lit("%"))


def drop_text(x: Column) -> Column:
    return F.when(finite(x), F.concat(to_fixed(x, 1), F.lit("%"))).otherwise(F.lit(DASH))


def not_available(x: Column) -> Column:
    """Missing, empty or some spelling of n/a."""
    return ~present(x) | x.rlike(rf"(?i)^n{SPACE}*/?{SPACE}*a\z")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", "")


def ticker_typed(x: Column) -> Column:
    """What a ticker field lets through: capitals, dot and hyphen, at most six."""
    return F.substring(F.regexp_replace(F.upper(x), r"[^A-Z.\-]", ""), 1, 6)


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def long_day(ts: Column) -> Column:
    return F.date_format(ts, "EEEE d MMMM")


def weekday(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def strip_html(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<script.*?</script>|<!--.*?-->|<style.*?</style>|<.*?>", "")


def truncate_words(x: Column, words: int) -> Column:
    parts = F.split(trim(x), r"\s+")
    cut = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(cut, F.lit("..."))).otherwise(cut)


def word_count(x: Column) -> Column:
    """Words between white space; nothing has none."""
    return F.when(trim(F.coalesce(x, F.lit(""))) == "", F.lit(0)).otherwise(F.size(F.split(trim(x), r"\s+")))
