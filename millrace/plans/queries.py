"""Queries over the driver's tables, one or more for each group of operators."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.api import Engine
from millrace.functions import values
from millrace.operators import contract, lists, posts, predicates, present, screen, watch
from millrace.sources import settings as st
from millrace.sources import snapshots
from millrace.sources.store import Store
from millrace.streaming import sync

from .surrogate import SNAPSHOT, USER_LIST, candidates, deep_list, payloads

Query = Callable[[SparkSession, str], DataFrame]

TIGHT = st.Settings(drop_threshold=15, min_market_cap="B1", max_pe=12, dividend_payers_only=True, candidate_count=5)
SECTOR = st.Settings(excluded_sectors=("econ", "promotional"), candidate_count=5)
ALL = st.Settings(drop_threshold=10, min_market_cap="B5", max_pe=20, excluded_sectors=("Banks", "large"), candidate_count=None)
AS_OF_MS = 1_704_500_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _screened(s: st.Settings) -> Query:
    return lambda spark, d: screen.screen(candidates(spark, d), s).select("pos", "ticker", "sector", "drop_pct", "market_cap_usd", "fwd_pe")


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    from millrace.sources.schema import CANDIDATE, COLUMNS

    fields = {f.name: f.dataType for f in CANDIDATE.fields}
    rows = candidates(spark, d).withColumn("snapshot", F.expr(SNAPSHOT))
    c = F.struct(*[(F.col(col) if col in rows.columns else F.lit(None)).cast(fields[f]).alias(f) for f, col in COLUMNS.items()])
    return rows.groupBy("snapshot").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("c")))), lambda x: x["c"]).alias("candidates"))


def screen_array(spark: SparkSession, d: str) -> DataFrame:
    """Many snapshots at once, the candidates of each as one array."""
    shown = _arrays(spark, d).select("snapshot", F.posexplode(screen.screen_array(F.col("candidates"), TIGHT)).alias("rank", "c"))
    return shown.select("snapshot", "rank", F.col("c.ticker").alias("ticker"), F.col("c.dropPct").alias("drop_pct"))


def screen_null_array(spark: SparkSession, d: str) -> DataFrame:
    """Every third snapshot has no array of candidates, and shows none."""
    some = F.when(F.col("snapshot") % 3 != 0, F.col("candidates"))
    return _arrays(spark, d).select("snapshot", F.size(screen.screen_array(some, TIGHT)).cast("long").alias("shown"))


def screen_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumn("snapshot", F.expr(SNAPSHOT))
    return screen.screen(rows, TIGHT, by="snapshot").select("snapshot", "pos", "ticker", "drop_pct")


def screen_stats(spark: SparkSession, d: str) -> DataFrame:
    return screen.filter_stats(candidates(spark, d), TIGHT)


def blind_spots(spark: SparkSession, d: str) -> DataFrame:
    s = ALL.with_changes(candidate_count=5)
    stats = screen.filter_stats(candidates(spark, d), s)
    return screen.live_effect(stats, s)


def brief_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of the whole screen with a note, and of one that nothing gets through, without."""
    rows = candidates(spark, d)
    whole = screen.summary(screen.filter_stats(rows, st.Settings()), F.lit("A quiet day."))
    none = screen.summary(screen.filter_stats(rows.where("drop_pct is not null"), st.Settings(drop_threshold=1000)), F.lit(""))
    return whole.withColumn("which", F.lit("whole")).union(none.withColumn("which", F.lit("none")))


def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    shown = screen.screen(candidates(spark, d), st.Settings(candidate_count=None))
    return screen.verdict_tallies(shown)


def range_position(spark: SparkSession, d: str) -> DataFrame:
    sheet = present.tearsheet(candidates(spark, d).withColumns({"cause": F.lit(None).cast("string"), "metrics": F.lit(None).cast("array<struct<label:string,value:string>>"), "must_go_right": F.lit(None).cast("string"), "could_go_wrong": F.lit(None).cast("string")}))
    return sheet.select("pos", "range_now", "range_text", "range_caption", F.col("drop_segment.left").alias("segment_left"), F.col("drop_segment.width").alias("segment_width"))


def tearsheet_format(spark: SparkSession, d: str) -> DataFrame:
    rows, pos = candidates(spark, d), F.col("pos")
    metric = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    metrics = F.array(metric("Margin", F.when(pos % 3 == 0, "n/a").otherwise(F.concat(pos % 40, F.lit("%")))), metric("Debt", F.when(pos % 4 != 0, F.lit("low"))))
    rows = rows.withColumns({
        "cause": F.when(pos % 4 == 0, "").otherwise(F.concat(F.lit("trouble at "), "name")),
        "must_go_right": F.when(pos % 5 != 0, F.lit("demand holds")),
        "could_go_wrong": F.when(pos % 6 == 0, "").otherwise(F.concat(F.lit("no more "), "name")),
        "metrics": F.when(pos % 7 != 0, metrics),
    })
    shown = F.array_join(F.transform("metrics", lambda m: F.concat(m["label"], F.lit("="), m["value"])), "|").alias("metrics")
    return present.tearsheet(rows).select("pos", "ticker", "exchange", "verdict", "verdict_class", "name", "price_text", "prev_text", "drop_text", "window_text", "business", "cause_type", "cause_class", "cause", "must_go_right", "could_go_wrong", shown)


def metrics_shown(spark: SparkSession, d: str) -> DataFrame:
    """Ten metrics per row, of which the first eight are shown."""
    rows = candidates(spark, d)
    value = lambda i: F.when((F.col("pos") + i) % 4 == 0, F.lit("n/a")).when((F.col("pos") + i) % 5 == 0, F.lit("N A")).when((F.col("pos") + i) % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.lit(i)))
    metrics = F.array(*[F.struct(F.when(F.lit(i) % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit(f"m{i}")).alias("label"), value(i).alias("value")) for i in range(10)])
    shown = rows.select("pos", F.posexplode(present.shown_metrics(metrics)).alias("i", "m"))
    return shown.select("pos", "i", F.col("m.label").alias("label"), F.col("m.value").alias("value"))


def watch_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    entries = watch.watch_entries(deep_list(rows), rows, watch.user_list(spark, USER_LIST))
    return present.watch_row_text(entries).select("src", "pos", "ticker", "deep", "openable", "text", F.coalesce("candidate.pos", F.lit(-1)).alias("candidate_pos"))


def entries_before_any_brief(spark: SparkSession, d: str) -> DataFrame:
    return watch.entries_before_any_brief(watch.user_list(spark, USER_LIST))


def watch_hit(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    return watch.watch_hit(deep_list(rows), rows, watch.user_list(spark, USER_LIST), 20).select("src", "pos", "ticker", "drop_pct")


def watched_candidates(spark: SparkSession, d: str) -> DataFrame:
    return watch.watched_candidates(candidates(spark, d), watch.user_list(spark, USER_LIST)).select("pos", "ticker", "drop_pct")


def brief_upsert(spark: SparkSession, d: str) -> DataFrame:
    versions = _table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return sync.newest(versions, "user_id", "hour", "event_id", ["event_type", "value"]).select("user_id", "hour", "event_id", "event_type", "value")


def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """State of even events, updated by the newest of the odd ones."""
    events = _table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    state = sync.newest(events.where("event_id % 2 = 0"), "user_id", "hour", "event_id", ["value"]).withColumn("seen", F.lit(True))
    incoming = sync.newest(events.where("event_id % 2 = 1"), "user_id", "hour", "event_id", ["value"])
    return sync.upserted(state, incoming, "user_id", "hour").select("user_id", "event_id", "value", "seen")


def stale_flag(spark: SparkSession, d: str) -> DataFrame:
    # the table's times carry no zone
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return _table(spark, d, "events").select("event_id", present.is_stale(ms, F.lit(AS_OF_MS)).alias("stale"), present.stale_text(ms, F.lit(AS_OF_MS)).alias("banner"))


def props_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").withColumn("p", F.from_json("props", T.StructType().add("k", "double")))
    return rows.select("event_id", F.col("p.k").alias("k"))


def payload_status(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of every shape, made from events."""
    return _payloads(spark, d).select("event_id", snapshots.payload_status(F.col("value")).alias("status"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 10
    shapes = ['{"brief":{"candidates":[]}}', "{}", '{"brief":null}', "not json", '{"brief":{"candidates":{}}}', '{"brief":{}}', '{"brief":""}', '{"brief":0}', '{"brief":{"candidates":null}}', '{"brief":[1]}']
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(k == i, F.lit(shape)).otherwise(text)
    return _table(spark, d, "events").select("event_id", text.alias("value"))


def response_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _payloads(spark, d)
    outcome = F.when(F.col("event_id") % 11 == 0, "timeout").when(F.col("event_id") % 13 == 0, "error").otherwise("response")
    http = F.when(F.col("event_id") % 17 == 0, 404).when(F.col("event_id") % 19 == 0, 503).otherwise(200)
    return snapshots.with_status(rows, outcome, http).select("event_id", "status", "message", F.coalesce("code", F.lit(200)).alias("code"))


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with times that can and can't be read, made from events."""
    k, stamp = F.col("event_id") % 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(k == 0, F.concat(stamp, F.lit("Z"))).when(k == 1, F.lit("soon")).when(k == 2, F.concat(stamp, F.lit("+02:00"))).when(k == 4, F.lit("")).when(k == 5, F.concat(stamp, F.lit("Z")))
    drop = F.when(F.col("event_id") % 4 == 0, F.lit('"-12"')).otherwise(F.lit("-12.5"))
    rows = F.concat(F.lit('[{"ticker":"A","dropPct":'), drop, F.lit("},null,"), F.lit('{"ticker":"B","fwdPe":'), F.when(F.col("event_id") % 5 == 0, F.lit('"9"')).otherwise(F.lit("null")), F.lit("}]"))
    brief = F.when(k == 5, F.lit("null")).otherwise(F.concat(F.lit('{"note":"n'), F.col("event_id"), F.lit('","candidates":'), rows, F.lit("}")))
    head = F.when(time.isNull(), F.lit("")).otherwise(F.concat(F.lit('"generatedAt":"'), time, F.lit('",')))
    return _table(spark, d, "events").select("event_id", F.concat(F.lit("{"), head, F.lit('"brief":'), brief, F.lit("}")).alias("value"))


def payload_parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots.parsed(_stamped(spark, d), F.timestamp_millis(F.lit(AS_OF_MS)))
    listed = F.filter("brief.candidates", lambda c: c.isNotNull())
    return rows.select("event_id", "status", F.coalesce("generated_at_ms", F.lit(-1)).alias("generated_at_ms"), F.col("brief.note").alias("note"), F.array_join(F.transform(listed, lambda c: c["ticker"]), "|").alias("tickers"))


def payload_contract(spark: SparkSession, d: str) -> DataFrame:
    return _stamped(spark, d).select("event_id", F.array_join(contract.payload_violations(F.col("value")), ",").alias("broken"))


WATCHING = st.Settings(watchlist=USER_LIST, candidate_count=3)


def refresh_shown(spark: SparkSession, d: str) -> DataFrame:
    """From payload texts to the rows that a refresh shows."""
    shown, _ = sync.refreshed(snapshots.parsed(payloads(spark, d), F.timestamp_millis(F.lit(AS_OF_MS))), WATCHING, by="snapshot")
    return shown.select("snapshot", "pos", "ticker", "drop_pct", "market_cap_usd")


def refresh_hit(spark: SparkSession, d: str) -> DataFrame:
    """From payload texts to the watched fall of each snapshot."""
    _, hit = sync.refreshed(snapshots.parsed(payloads(spark, d), F.timestamp_millis(F.lit(AS_OF_MS))), WATCHING, by="snapshot")
    return hit.select("snapshot", "src", "pos", "ticker", "drop_pct")


def sync_keeps_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Each user's cached version after the payloads of all event types but clicks, of which only
    good and newer ones count."""
    events = _table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    state = sync.newest(events.where("event_type = 'click'"), "user_id", "hour", "event_id", ["value"]).withColumn("seen", F.lit(True))
    texts = _payloads(spark, d).withColumnRenamed("value", "text").withColumnRenamed("event_id", "_id")
    arrived = events.where("event_type <> 'click'").join(texts, F.col("event_id") == F.col("_id")).where(snapshots.payload_status(F.col("text")) == "ok")
    incoming = sync.newest(arrived, "user_id", "hour", "event_id", ["value"])
    return sync.upserted(state, incoming, "user_id", "hour").select("user_id", "event_id", "value", "seen")


def error_shown(spark: SparkSession, d: str) -> DataFrame:
    rows = _payloads(spark, d).withColumn("status", snapshots.payload_status(F.col("value")))
    return rows.select("event_id", sync.error_shown(F.col("status"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("shown"))


def seen_marked(spark: SparkSession, d: str) -> DataFrame:
    state = _table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 2 == 0).alias("seen"))
    return sync.marked_seen(state, "c_mktsegment", "BUILDING").select("c_custkey", "seen")


def generated_text(spark: SparkSession, d: str) -> DataFrame:
    # the table's times carry no zone
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return _table(spark, d, "events").select("event_id", present.generated_text(ms).alias("day"), values.clock(F.timestamp_millis(ms)).alias("clock"))


def deep_watchlist(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    tickers = F.concat(F.lit('["'), F.upper("c_mktsegment"), F.lit('","","'), F.lower("c_mktsegment"), F.lit('"]'))
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit('{"_comment":"none"}')).otherwise(F.concat(F.lit('{"_comment":"made by hand","tickers":'), tickers, F.lit("}")))
    return snapshots.deep_watchlist(c.select("c_custkey", text.alias("value")), by="c_custkey").select("c_custkey", "pos", "ticker")


def post_permalinks(spark: SparkSession, d: str) -> DataFrame:
    """Posts made from orders: front matter with and without a date, title in quotes or not."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(k % 3 != 0, F.concat(F.lit("date: "), day, F.lit(" 10:00:00 +0000\n"))).otherwise(F.lit(""))
    title = F.when(k % 2 == 0, F.concat(F.lit('"No. '), k, F.lit('"'))).otherwise(F.concat(F.lit("No. "), k))
    text = F.concat(F.lit("---\nlayout: post\ntitle: "), title, F.lit("\n"), date, F.lit("---\n\nFirst <b>words</b> of "), k, F.lit(".\n\nMore.\n"))
    files = _table(spark, d, "orders").select(text.alias("value"), F.concat(F.lit("/x/_posts/"), day, F.lit("-order-"), k, F.lit(".md")).alias("file"))
    return posts.cards(snapshots.posts(files)).select("title", "url", "date_text", "excerpt")


def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    """Stored settings over the defaults; a key that is there counts even if it is null."""
    stored = [None, {}, {"dropThreshold": 15, "maxPe": 12}, {"maxPe": None, "candidateCount": None, "excludedSectors": ["Banks", "Energy"]}, {"watchlist": ["XOM"], "notifyOnNewBrief": False, "minMarketCap": None, "other": 1}]
    rows = []
    for i, s in enumerate(map(st.merged, stored)):
        rows.append((i, float(s.drop_threshold), s.min_market_cap, s.max_pe and float(s.max_pe), s.dividend_payers_only, ",".join(s.excluded_sectors), -1 if s.candidate_count is None else s.candidate_count, ",".join(s.watchlist), s.notify_on_new_brief, s.notify_on_watchlist_drop))
    return spark.createDataFrame(rows, "n int, drop_threshold double, min_market_cap string, max_pe double, dividend_payers_only boolean, excluded_sectors string, candidate_count int, watchlist string, notify_on_new_brief boolean, notify_on_watchlist_drop boolean")


def settings_choices(spark: SparkSession, d: str) -> DataFrame:
    tried = [st.Settings(), TIGHT, SECTOR, ALL, st.Settings(drop_threshold=11, max_pe=10, min_market_cap="B2"), st.Settings(excluded_sectors=("Banks", "Energy"))]
    return spark.createDataFrame([(i, ",".join(sorted(st.outside_choices(s)))) for i, s in enumerate(tried)], "n int, outside string")


def notify_decision(spark: SparkSession, d: str) -> DataFrame:
    """One decision per customer: whether something changed, is permitted, was hit, is shown."""
    c = _table(spark, d, "customer")
    k = F.col("c_custkey")
    drop = F.when(k % 3 == 0, -(k % 40) * 1.25)
    alert = sync.notification(k % 2 == 0, k % 7 != 0, F.col("c_mktsegment"), drop, (k % 5 == 0), k % 4, F.when(k % 11 != 0, F.col("c_name")), st.Settings())
    return c.select("c_custkey", alert["kind"].alias("kind"), alert["title"].alias("title"), alert["body"].alias("body"))


def validate_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    return rows.select("pos", F.array_join(contract.violations(rows.columns), ",").alias("broken"))


def publishable(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    return contract.publishable(rows).select(F.lit("all").alias("which"), "publishable").union(contract.publishable(rows.where("pos % 5 < 3 and pos % 4 < 3")).select(F.lit("allowed"), "publishable")).union(contract.publishable(rows.where("pos < 0")).select(F.lit("none"), "publishable"))


def wide_screen(spark: SparkSession, d: str) -> DataFrame:
    return contract.screenable(candidates(spark, d)).select("pos", "ticker", "drop_pct", "price")


def word_limits(spark: SparkSession, d: str) -> DataFrame:
    n = values.word_count(F.col("text"))
    return _table(spark, d, "benchmark").select("item_id", n.cast("long").alias("words"), (n <= contract.NOTE_WORDS).alias("fits_note"))


def html_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", values.truncate_words(values.strip_html(F.col("html")), posts.EXCERPT_WORDS).alias("excerpt"))


def ticker_sanitise(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", values.ticker_typed(F.concat("p_brand", F.lit(".x-9 "), "p_name")).alias("ticker"))


def list_edit(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    items = F.array(F.lit("AAA"), F.upper("c_mktsegment"), F.lit("BBB"))
    item = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lit("CCC"))
    less = lists.removed(items, item)
    joined = lambda a: F.array_join(a, "|")
    return c.select(
        "c_custkey",
        joined(lists.added(items, F.concat(F.lit(" \t"), F.lower(item), F.lit("\n")))).alias("added"),
        lists.already_there(items, F.lower(item)).alias("message"),
        joined(less).alias("removed"),
        lists.index_of(items, item).cast("long").alias("place"),
        joined(lists.restored(less, F.lit(2), item)).alias("restored"),
        joined(lists.toggled(items, item)).alias("toggled"),
        lists.first_where(items, lambda x: F.length(x) > 3).alias("first_long"),
    )


def newest_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("url"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("excerpt_source"))
    return posts.cards(rows).select("title", "url", "date_text")


def to_fixed_text(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.col("l_discount") / 8 - 100
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.to_fixed(x, 1).alias("one"), values.to_fixed(x, 2).alias("two"))


def settings_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, st.preview_line(s), st.header_line(s)) for i, s in enumerate((st.Settings(), TIGHT, SECTOR))]
    return spark.createDataFrame(rows, "n int, preview string, header string")


def _scratch(spark: SparkSession) -> str:
    """A new folder that the whole cluster sees; a local one where none is named and all is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """What a store gives back: the last value of a key, a fallback, merged settings, guarded snapshots."""
    store, rows = Store(spark, _scratch(spark)), []
    rows.append(("missing", json.dumps(store.get("none", "fallback"))))
    store.put("key", {"a": [1, None]})
    store.put("key", "ümlaut")
    rows.append(("last", json.dumps(store.get("key"), ensure_ascii=False)))
    rows.append(("defaults", json.dumps(store.settings() == st.Settings())))
    store.put_settings(st.Settings(max_pe=12, watchlist=("XOM",)))
    rows.append(("settings", f"{store.settings().max_pe:g} {','.join(store.settings().watchlist)}"))
    for name, value in (("text", "brief"), ("no array", {"brief": {"candidates": {}}}), ("good", {"brief": {"candidates": []}, "seen": True})):
        store.put(st.SNAPSHOT_KEY, value)
        rows.append((f"snapshot: {name}", json.dumps(store.snapshot() is not None)))
    return spark.createDataFrame(rows, "step string, found string")


def engine_refresh(spark: SparkSession, d: str) -> DataFrame:
    """One user's round over the first snapshot, published as a file: sync, show, mark as seen."""
    folder = _scratch(spark)
    payloads(spark, d).where("snapshot = 0").select("value").coalesce(1).write.text(f"{folder}/published")
    engine = Engine(spark, f"{folder}/kv", f"{folder}/published")
    engine.put_settings(WATCHING)
    first = engine.refresh_brief()
    brief, s = engine.get_brief(), engine.get_settings()
    shown = [r["ticker"] for r in engine.filter_candidates(brief, s).orderBy("pos").collect()]
    stats = engine.filter_stats(brief, s).first()
    rows = [("changed", str(first["ok"])), ("shown", "|".join(shown)), ("total", str(stats["total"])), ("hit", first["watchlist_hit"]["ticker"]), ("seen", str(brief["seen"]))]
    rows.append(("spots", "|".join(engine.blind_spots(brief, ALL))))
    rows.append(("entries", "|".join(sorted(r["ticker"] for r in engine.watch_entries(brief, s).collect()))))
    rows.append(("again", str(engine.refresh_brief()["ok"])))
    engine.mark_seen()
    rows.append(("marked", str(engine.get_brief()["seen"])))
    return spark.createDataFrame(rows, "step string, found string")


QUERIES: dict[str, Query] = {
    "screen_default": _screened(st.Settings()),
    "screen_tight": _screened(TIGHT),
    "screen_sector": _screened(SECTOR),
    "screen_all": _screened(ALL),
    "screen_array": screen_array,
    "screen_null_array": screen_null_array,
    "screen_unknown_tier": _screened(st.Settings(min_market_cap="X9", candidate_count=5)),
    "screen_grouped": screen_grouped,
    "screen_stats": screen_stats,
    "blind_spots": blind_spots,
    "brief_summary": brief_summary,
    "verdict_tally": verdict_tally,
    "range_position": range_position,
    "tearsheet_format": tearsheet_format,
    "metrics_shown": metrics_shown,
    "watch_entries": watch_entries,
    "entries_before_any_brief": entries_before_any_brief,
    "watch_hit": watch_hit,
    "watched_candidates": watched_candidates,
    "brief_upsert": brief_upsert,
    "state_upsert": state_upsert,
    "stale_flag": stale_flag,
    "props_parse": props_parse,
    "payload_status": payload_status,
    "response_status": response_status,
    "payload_parsed": payload_parsed,
    "payload_contract": payload_contract,
    "refresh_shown": refresh_shown,
    "refresh_hit": refresh_hit,
    "sync_keeps_snapshot": sync_keeps_snapshot,
    "error_shown": error_shown,
    "seen_marked": seen_marked,
    "generated_text": generated_text,
    "deep_watchlist": deep_watchlist,
    "post_permalinks": post_permalinks,
    "notify_decision": notify_decision,
    "validate_contract": validate_contract,
    "publishable": publishable,
    "wide_screen": wide_screen,
    "word_limits": word_limits,
    "html_excerpt": html_excerpt,
    "ticker_sanitise": ticker_sanitise,
    "list_edit": list_edit,
    "newest_first": newest_first,
    "to_fixed_text": to_fixed_text,
    "settings_preview": settings_preview,
    "settings_merged": settings_merged,
    "settings_choices": settings_choices,
    "store_roundtrip": store_roundtrip,
    "engine_refresh": engine_refresh,
}
