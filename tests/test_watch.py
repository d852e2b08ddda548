from pyspark.sql import functions as F

from millrace.operators import lists, present, watch

from .fixtures import CANDIDATES, rows


def entries(spark, user, **more):
    found = watch.watch_entries(rows(spark, "watch", **more), rows(spark, **more), watch.user_list(spark, user))
    return [(r["ticker"], r["deep"], r["candidate"] and r["candidate"]["name"], r["text"]) for r in present.watch_row_text(found).orderBy("src", "pos").collect()]


def test_deep_entries_first_then_the_users_each_ticker_once(spark):
    assert entries(spark, ("aaa", "ZZZ", "xom", "AAA")) == [("XOM", True, "first", "first"), ("AAA", False, "Alpha", "Alpha"), ("ZZZ", False, None, "no double-digit fall today")]


def test_the_last_candidate_of_a_ticker_counts_and_needs_no_filter(spark):
    twice = [*CANDIDATES, {"ticker": "aaa", "name": "Later", "dropPct": -0.1}]
    assert entries(spark, ("AAA",), candidates=twice)[1][2] == "Later"


def test_empty_inputs(spark):
    assert entries(spark, (), watch=None, candidates=None) == []
    before = watch.entries_before_any_brief(watch.user_list(spark, ("A", "A")))
    assert [(r["ticker"], r["deep"]) for r in before.collect()] == [("A", False), ("A", False)]


def test_a_hit_is_known_and_deep_ones_come_first(spark):
    hit = lambda t, user=(): [(r["ticker"], r["drop_pct"]) for r in watch.watch_hit(rows(spark, "watch"), rows(spark), watch.user_list(spark, user), t).collect()]
    assert hit(10) == [("", -50.0)]
    assert hit(60, ("bbb",)) == []
    only = rows(spark, "watch").where("pos = 0")
    got = watch.watch_hit(only, rows(spark), watch.user_list(spark, ("fff", "BBB", "eee")), 12).collect()
    assert [r["ticker"] for r in got] == ["EEE"]


def test_list_edits(spark):
    df = spark.createDataFrame([(["A", "B"], " c\n", "A")], "l array<string>, raw string, x string")
    got = df.select(
        lists.added(F.col("l"), F.col("raw")).alias("added"),
        lists.added(F.col("l"), F.lit(" a ")).alias("same"),
        lists.added(F.col("l"), F.lit(" ")).alias("nothing"),
        lists.removed(F.col("l"), F.col("x")).alias("removed"),
        lists.restored(lists.removed(F.col("l"), F.col("x")), F.lit(0), F.col("x")).alias("back"),
        lists.restored(F.array(F.lit("B")), F.lit(5), F.lit("A")).alias("end"),
        lists.toggled(F.col("l"), F.lit("B")).alias("off"),
        lists.index_of(F.col("l"), F.lit("Z")).alias("nowhere"),
        lists.first_where(F.col("l"), lambda v: v > "A").alias("first"),
        lists.first_where(F.col("l"), lambda v: v > "Z").alias("none"),
    ).first()
    assert got.asDict() == {"added": ["A", "B", "C"], "same": ["A", "B"], "nothing": ["A", "B"], "removed": ["B"], "back": ["A", "B"], "end": ["B", "A"], "off": ["A"], "nowhere": -1, "first": "B", "none": None}
