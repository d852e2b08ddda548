from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import values


def test_fixed_point_text(spark):
    given = [(1.005, "1.00", "1.0"), (2.675, "2.67", "2.7"), (0.125, "0.13", "0.1"), (-15.85, "-15.85", "-15.8"), (1.45, "1.45", "1.4"), (0.25, "0.25", "0.3"), (-0.04, "-0.04", "-0.0")]
    df = spark.createDataFrame([(x,) for x, _, _ in given], "x double")
    got = [tuple(r) for r in df.select(values.to_fixed(F.col("x"), 2), values.to_fixed(F.col("x"), 1)).collect()]
    assert got == [(a, b) for _, a, b in given]


def test_fixed_point_text_against_exact_decimals(spark):
    rng = np.random.default_rng(1)
    xs = [float(x) for x in np.concatenate([rng.normal(0, 100, 500), rng.integers(-4000, 4000, 500) / 16])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for digits in (1, 2):
        got = {r["i"]: r["t"] for r in df.select("i", values.to_fixed(F.col("x"), digits).alias("t")).collect()}
        for i, x in enumerate(xs):
            want = Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
            assert got[i].lstrip("-") == str(abs(want)), x


def test_money_percent_and_unknown(spark):
    df = spark.createDataFrame([(1234.5, "CAD"), (1234.5, None), (None, "CAD"), (float("nan"), None), (float("inf"), None)], "x double, c string")
    assert [r[0] for r in df.select(values.money(F.col("x"), F.col("c"))).collect()] == ["C$1234.50", "$1234.50", "—", "—", "—"]
    assert [r[0] for r in df.select(values.finite(F.col("x"))).collect()] == [True, True, False, False, False]


def test_not_available_spellings(spark):
    xs = ["n/a", "N/A", "n a", "NA", "n / A", "n /a", "n/a\n", "nab", "", None, "12"]
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    assert [r[0] for r in df.select(values.not_available(F.col("x"))).collect()] == [True, True, True, True, True, True, False, False, True, True, False]


def test_texts(spark):
    df = spark.createDataFrame([("  ab\t\n", "<p>one <b>two</b></p><script>x</script><!-- c -->")], "x string, h string")
    got = df.select(values.trim(F.col("x")), values.strip_html(F.col("h")), values.ticker_typed(F.lit("brk.b-12xyz")), values.truncate_words(F.lit("a b  c d"), 3), values.truncate_words(F.lit(" a b "), 3), values.word_count(F.lit(" ")), values.word_count(F.lit("a  b"))).first()
    assert tuple(got) == ("ab", "one two", "BRK.B-", "a b c...", "a b", 0, 2)


def test_counts_and_dates(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert [r[0] for r in df.select(values.counted(F.col("n"), "candidate")).collect()] == ["1 candidate", "2 candidates"]
    assert df.limit(1).select(values.long_date(F.lit("2026-08-04").cast("date"))).first()[0] == "August 4, 2026"
