import os
import time

from pyspark.sql import functions as F

from millrace.operators.present import is_stale, stale_text
from millrace.sources.settings import Settings
from millrace.streaming import sync

from .fixtures import CANDIDATES, payload


def test_the_strictly_newest_stays_and_ties_keep_the_first(spark):
    versions = spark.createDataFrame([("brief", 0, 5, "first"), ("brief", 1, 3, "older"), ("brief", 2, 5, "tie")], "k string, arrival long, ts long, v string")
    assert sync.newest(versions, "k", "ts", "arrival", ["v"]).first()["v"] == "first"
    more = versions.union(spark.createDataFrame([("brief", 3, 9, "newer")], versions.schema))
    assert sync.newest(more, "k", "ts", "arrival", ["v"]).first()["v"] == "newer"


def test_upsert_of_a_keyed_table(spark):
    state = spark.createDataFrame([("a", 5, "old", True), ("b", 5, "old", True), ("c", 5, "old", True)], "k string, ts long, v string, seen boolean")
    new = spark.createDataFrame([("a", 6, "new"), ("b", 5, "new"), ("d", 1, "new")], "k string, ts long, v string")
    got = {r["k"]: (r["v"], r["seen"]) for r in sync.upserted(state, new, "k", "ts").collect()}
    assert got == {"a": ("new", False), "b": ("old", True), "c": ("old", True), "d": ("new", False)}


def test_as_a_stream_older_and_tied_records_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(0, 5, "first"), (1, 3, "older"), (2, 5, "tie"), (3, 9, "newer")]
    for arrival, ts, v in rows:
        spark.createDataFrame([("brief", arrival, ts, v)], "k string, arrival long, ts long, v string").coalesce(1).write.mode("append").json(str(source))
        files = sorted((f for f in source.iterdir() if f.suffix == ".json" and not f.name.startswith("n")), key=os.path.getmtime)
        files[-1].rename(source / f"n{arrival}.json")
        os.utime(source / f"n{arrival}.json", (1_700_000_000 + arrival,) * 2)
    seen = []
    stream = spark.readStream.schema("k string, arrival long, ts long, v string").option("maxFilesPerTrigger", 1).json(str(source))
    query = sync.newest(stream, "k", "ts", "arrival", ["v"]).writeStream.outputMode("update").foreachBatch(lambda b, i: seen.append([r["v"] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [s[-1] for s in seen if s] == ["first", "first", "first", "newer"]


def test_the_whole_loop_keeps_the_snapshot_on_bad_payloads_and_alerts_once(spark, tmp_path):
    landing, alerts = tmp_path / "landing", []
    landing.mkdir()
    bodies = [payload(), "{}", '{"brief":null}', "broken", '{"brief":{"candidates":{}}}', payload(at="2026-08-03T10:30:00Z"), payload(note="tie"), payload(CANDIDATES[2:3], None, at="2026-08-05T10:30:00Z"), payload(CANDIDATES[:2], [], at="2026-08-06T10:30:00Z", note=None)]
    for i, body in enumerate(bodies):
        (landing / f"{i}.json").write_text(body)
        os.utime(landing / f"{i}.json", (1_700_000_000 + i,) * 2)
    s = Settings(watchlist=("eee",))
    loop = sync.Sync(spark, str(tmp_path / "state"), lambda: s, lambda df: alerts.append([tuple(r) for r in df.collect()]))
    assert loop.cached() is None
    loop.start(str(landing), str(tmp_path / "cp"), once=True).awaitTermination()
    # the deep list's entry with an empty ticker is the first known fall
    assert alerts == [[("drop", " is down 50.0%", "A quiet day.")], [], [("new", "2 candidates today", "")]]
    last = loop.cached().first()
    assert last["generated_at_ms"] == 1786012200000 and last["seen"] is False
    loop.mark_seen()
    assert loop.cached().first()["seen"] is True
    assert loop.sync(spark.createDataFrame([(payload(), 1)], "value string, arrival long")) is False


def test_a_trigger_takes_all_files_that_are_there(spark, tmp_path, monkeypatch):
    landing, alerts = tmp_path / "landing", []
    landing.mkdir()
    for i in range(6):
        (landing / f"{i}.json").write_text(payload(at=f"2026-08-0{i + 1}T10:30:00Z"))
    monkeypatch.setattr(sync, "MIN_SYNC_INTERVAL", "1 hour")
    loop = sync.Sync(spark, str(tmp_path / "state"), Settings, lambda df: alerts.append(df.count()))
    query = loop.start(str(landing), str(tmp_path / "cp"))
    deadline = time.time() + 60
    while not alerts and time.time() < deadline:
        time.sleep(0.1)
    query.stop()
    assert len(alerts) == 1 and loop.cached().first()["generated_at_ms"] == 1786012200000


def test_alert_priority(spark):
    df = spark.createDataFrame([(True, True, "XOM", -12.25, True, 2), (True, True, "XOM", None, True, 2), (True, True, None, None, False, 1), (True, True, None, None, False, 0), (False, True, "X", -12.0, True, 1), (True, False, "X", -12.0, True, 1)], "c boolean, p boolean, t string, d double, h boolean, n long")
    alert = lambda s: [r[0] and r[0]["title"] for r in df.select(sync.notification(F.col("c"), F.col("p"), F.col("t"), F.col("d"), F.col("h"), F.col("n"), F.lit(None).cast("string"), s)).collect()]
    assert alert(Settings()) == ["XOM is down 12.3%", "XOM is down sharply", "1 candidate today", None, None, None]
    assert alert(Settings(notify_on_watchlist_drop=False)) == ["2 candidates today", "2 candidates today", "1 candidate today", None, None, None]
    assert alert(Settings(notify_on_new_brief=False)) == ["XOM is down 12.3%", "XOM is down sharply", None, None, None, None]


def test_staleness_is_strict(spark):
    df = spark.createDataFrame([(0,), (-1,)], "g long")
    assert [r[0] for r in df.select(is_stale(F.col("g"), F.lit(216_000_000))).collect()] == [False, True]
    assert df.select(stale_text(F.col("g"), F.lit(216_000_000))).collect()[1][0] == "This brief is from Wednesday. Pull down to refresh."


def test_errors_are_shown_unless_quiet_with_something_to_show(spark):
    df = spark.createDataFrame([("ok", False, False), ("unreadable", True, True), ("unreadable", True, False), ("unreadable", False, True)], "s string, q boolean, h boolean")
    assert [r[0] for r in df.select(sync.error_shown(F.col("s"), F.col("q"), F.col("h"))).collect()] == [False, False, True, True]
