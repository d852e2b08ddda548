import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import present, screen
from millrace.sources.settings import Settings

from .fixtures import CANDIDATES, brief, rows

FIVE = Settings(candidate_count=5)


def tickers(df):
    return "".join(r["ticker"][0] for r in df.orderBy("pos").collect())


@pytest.mark.parametrize(
    "s, kept",
    [
        (Settings(), "ABD"),
        (FIVE, "ABDEF"),
        (FIVE.with_changes(max_pe=15), "ABDEF"),
        (FIVE.with_changes(max_pe=12), "ABEF"),
        (FIVE.with_changes(max_pe=0), "ABDEF"),
        (FIVE.with_changes(dividend_payers_only=True), "ABEF"),
        (FIVE.with_changes(excluded_sectors=("Energy",)), "ABEF"),
        (FIVE.with_changes(excluded_sectors=("China-domiciled",)), "ABDF"),
        (FIVE.with_changes(excluded_sectors=("",)), "BF"),
        (FIVE.with_changes(min_market_cap="B1"), "ABF"),
        (FIVE.with_changes(min_market_cap="nonsense"), "ABDEF"),
        (FIVE.with_changes(drop_threshold=15), "ABF"),
        (FIVE.with_changes(candidate_count=0), ""),
        (FIVE.with_changes(candidate_count=None), "ABDEF"),
    ],
)
def test_each_filter_keeps_the_unknown_and_its_boundary(spark, s, kept):
    assert tickers(screen.screen(rows(spark), s)) == kept
    array = brief(spark).select(F.transform(screen.screen_array(F.col("brief.candidates"), s), lambda c: c["ticker"]).alias("t")).first()["t"]
    assert "".join(t[0] for t in array) == kept


def test_a_missing_array_and_null_elements_give_no_rows(spark):
    assert rows(spark, candidates=None).count() == 0
    assert rows(spark, candidates=[None, CANDIDATES[0]]).count() == 1
    assert brief(spark, candidates=None).select(F.size(screen.screen_array(F.col("brief.candidates"), FIVE))).first()[0] == 0


def test_each_snapshot_is_cut_on_its_own(spark):
    both = rows(spark).withColumn("day", F.lit(1)).union(rows(spark).withColumn("day", F.lit(2)))
    assert screen.screen(both, Settings(), by="day").groupBy("day").count().collect() == [(1, 3), (2, 3)]


def test_stats_count_over_all_rows_and_shown_after_the_cut(spark):
    assert screen.filter_stats(rows(spark), Settings()).first().asDict() == {"total": 6, "shown": 3, "missing_fwd_pe": 2, "missing_market_cap_usd": 1, "missing_sector": 2}
    assert screen.filter_stats(rows(spark, candidates=[]), Settings()).first()["shown"] == 0


def test_blind_spots_only_for_active_limits(spark):
    stats = screen.filter_stats(rows(spark), FIVE)
    spots = lambda s: stats.select(screen.blind_spots(s)).first()[0]
    assert spots(Settings()) == []
    assert spots(Settings(max_pe=12, min_market_cap="B1", excluded_sectors=("x",))) == ["2 with no P/E on file", "1 with no market cap", "2 with no sector"]


def test_tallies_have_known_verdicts_in_fixed_order(spark):
    shown = screen.screen(rows(spark), Settings())
    assert [(r["label"], r["n"]) for r in screen.verdict_tallies(shown).orderBy("rank").collect()] == [("real bargain", 2), ("value trap", 1)]


def test_summary_wording(spark):
    one = screen.summary(screen.filter_stats(rows(spark), Settings(candidate_count=1)), F.lit("")).first()
    assert (one["count_text"], one["note"], one["nothing_text"]) == ("1 candidate", None, None)
    assert one["screened_text"] == "Screened 6 · showing the 1 that match your settings"


@pytest.mark.parametrize(
    "price, low, high, at, caption",
    [
        (12.0, 0.0, 100.0, 0.12, "bottom"),
        (33.0, 0.0, 100.0, 0.33, "lower third"),
        (66.0, 0.0, 100.0, 0.66, "mid-range"),
        (67.0, 0.0, 100.0, 0.67, "upper third"),
        (-5.0, 0.0, 100.0, 0.0, "bottom"),
        (10.0, None, 100.0, None, "not confirmed"),
        (10.0, 20.0, 20.0, None, "not confirmed"),
        (float("inf"), 0.0, 100.0, None, "not confirmed"),
    ],
)
def test_range_position(spark, price, low, high, at, caption):
    df = spark.createDataFrame([(price, low, high)], "p double, l double, h double")
    pos = present.range_position(F.col("p"), F.col("p"), F.col("l"), F.col("h"))
    got = df.select(pos.alias("x"), present.range_caption(pos).alias("c")).first()
    assert got["x"] == at and caption in got["c"]


def test_tearsheet_shows_dashes_for_what_is_unknown(spark):
    sheet = {r["ticker"]: r for r in present.tearsheet(rows(spark)).collect()}
    assert sheet["AAA"]["drop_text"] == "-15.8%" and sheet["BBB"]["drop_text"] == "—"
    assert sheet["FFF"]["verdict"] == "unrated" and sheet["FFF"]["verdict_class"] == "neutral"
    assert sheet["AAA"]["verdict_class"] == "bargain" and sheet["AAA"]["price_text"] == "—"
    assert sheet["AAA"]["metrics"] == []


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/c")
    df = spark.read.parquet(f"{tmp_path}/c")
    plan = screen.screen(df, FIVE.with_changes(max_pe=12)).select("pos", "ticker")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "Or(Or(IsNull(drop_pct),GreaterThanOrEqual(drop_pct,10.0)),LessThanOrEqual(drop_pct,-10.0))" in pushed
    assert "verdict" not in plan.split("ReadSchema: ")[1]
    assert "TakeOrderedAndProject" in plan


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 8))
def test_a_tighter_threshold_keeps_a_subset(spark, a, b, k):
    loose, tight = sorted((a, b))
    every = Settings(candidate_count=1000)
    wide = {r["pos"] for r in screen.screen(rows(spark), every.with_changes(drop_threshold=loose)).collect()}
    narrow = {r["pos"] for r in screen.screen(rows(spark), every.with_changes(drop_threshold=tight)).collect()}
    assert narrow <= wide and 1 in narrow
    assert screen.filter_stats(rows(spark), every.with_changes(drop_threshold=tight, candidate_count=k)).first()["shown"] == min(k, len(narrow))
