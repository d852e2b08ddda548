"""Keeping the newest valid snapshot, and alerting on it.

``newest`` is the rule as an aggregation: of the versions of a key the strictly newest stays,
of equal ones the first to arrive. It runs on a table or on a stream (update mode), where the
state is one row for each key. ``Sync`` is the whole loop for one key: land, classify, keep if
newer, filter, decide on one notification.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.values import counted, known, present, to_fixed
from millrace.operators.screen import filter_stats, screen
from millrace.operators.watch import user_list, watch_hit
from millrace.sources.schema import exploded, flat
from millrace.sources.settings import MIN_SYNC_INTERVAL, Settings
from millrace.sources.snapshots import parsed


def newest(versions: DataFrame, key: str, version: str, arrival: str, payload: list[str]) -> DataFrame:
    """The key, and ``version``, ``arrival`` and ``payload`` of the version that stays."""
    order = F.struct(F.col(version), -F.col(arrival))
    kept = F.max_by(F.struct(version, arrival, *payload), order)
    return versions.groupBy(key).agg(kept.alias("_v")).select(key, "_v.*")


def upserted(state: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """``state`` (with ``seen``) after ``incoming``, one row for each key: replaced, and then not
    seen, only by a strictly newer version."""
    fresh = incoming.withColumn("_in", F.struct(*incoming.columns)).select(F.col(key).alias("_k"), "_in")
    both = state.withColumn("_old", F.struct(*state.columns)).select(F.col(key).alias("_key"), "_old").join(fresh, F.col("_key") == F.col("_k"), "full")
    newer = F.col("_old").isNull() | (F.col(f"_in.{version}") > F.col(f"_old.{version}"))
    take = F.col("_in").isNotNull() & newer
    columns = [c for c in state.columns if c != "seen"]
    return both.select(*[F.when(take, F.col(f"_in.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns], F.when(take, F.lit(False)).otherwise(F.col("_old.seen")).alias("seen"))


def marked_seen(state: DataFrame, key: str, shown: str) -> DataFrame:
    return state.withColumn("seen", F.col("seen") | (F.col(key) == shown))


def error_shown(status: Column, quiet: Column, has_snapshot: Column) -> Column:
    """A failed sync is shown unless it was quiet and there is something to show instead."""
    return (status != "ok") & ~(quiet & has_snapshot)


def notification(changed: Column, permitted: Column, hit_ticker: Column, hit_drop: Column, hit: Column, shown: Column, note: Column, s: Settings) -> Column:
    """``kind, title, body`` of the one alert, or null: a watched fall first, else that there are candidates."""
    body = F.coalesce(note, F.lit(""))
    size = F.when(known(hit_drop), F.concat(to_fixed(F.abs(hit_drop), 1), F.lit("%"))).otherwise(F.lit("sharply"))
    drop = F.struct(F.lit("drop").alias("kind"), F.concat(hit_ticker, F.lit(" is down "), size).alias("title"), body.alias("body"))
    new = F.struct(F.lit("new").alias("kind"), F.concat(counted(shown, "candidate"), F.lit(" today")).alias("title"), body.alias("body"))
    may = F.coalesce(changed & permitted, F.lit(False))
    out = F.when(~may, F.lit(None))
    if s.notify_on_watchlist_drop:
        out = out.when(hit, drop)
    return out.when(shown > 0, new) if s.notify_on_new_brief else out.otherwise(F.lit(None).cast("struct<kind:string,title:string,body:string>"))


def replaces(cached_ms: int | None, fresh_ms: int) -> bool:
    """Whether a snapshot takes the cached one's place: only a strictly newer one does."""
    return cached_ms is None or fresh_ms > cached_ms


def listed(brief: DataFrame, array: str, by: str | None = None) -> DataFrame:
    """The candidates of ``brief`` in ``array``, each with ``pos``."""
    key = [by] if by else []
    return brief.select(*key, *exploded(F.col(f"brief.{array}"))).where("c is not null").select(*key, "pos", *flat())


def refreshed(brief: DataFrame, s: Settings, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Shown rows and the watch hit (one row or none) of a one-row table with ``brief``; with ``by``,
    of each row of a table of snapshots."""
    candidates, deep = listed(brief, "candidates", by), listed(brief, "watch", by)
    return screen(candidates, s, by), watch_hit(deep, candidates, user_list(brief.sparkSession, s.watchlist), s.drop_threshold, by)


def decided(brief: DataFrame, s: Settings, permitted: bool = True) -> DataFrame:
    """``kind, title, body``: no row or one."""
    _, hit = refreshed(brief, s)
    stats = filter_stats(listed(brief, "candidates"), s).select("shown")
    found = hit.agg(F.first("ticker").alias("hit_ticker"), F.first("drop_pct").alias("hit_drop"), F.count(F.lit(1)).alias("hits"))
    note = brief.agg(F.first("brief.note").alias("note"))
    parts = stats.unionByName(found, allowMissingColumns=True).unionByName(note, allowMissingColumns=True)  # one row each
    one = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    alert = notification(F.lit(True), F.lit(permitted), F.col("hit_ticker"), F.col("hit_drop"), F.col("hits") > 0, F.col("shown"), F.col("note"), s)
    return one.select(alert.alias("n")).where("n is not null").select("n.*")


class Sync:
    """A folder of landed payloads into one cached snapshot.

    The state is a table under ``state``, a new version for each change; a payload that is not
    ok, older or equally old changes nothing. ``alert`` gets the rows of ``decided`` after a change.
    """

    KEY = "brief"

    def __init__(self, spark: SparkSession, state: str, settings: Callable[[], Settings], alert: Callable[[DataFrame], None], permitted: bool = True):
        self.spark, self.state, self.settings, self.alert, self.permitted = spark, state, settings, alert, permitted

    def cached(self) -> DataFrame | None:
        """``generated_at_ms, brief, seen, version``, one row; None before any snapshot."""
        try:
            rows = self.spark.read.parquet(self.state)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return rows.orderBy(F.col("version").desc()).limit(1)

    def sync(self, payloads: DataFrame) -> bool:
        """Whether the cached snapshot changed. ``payloads`` has ``value`` and ``arrival``."""
        ok = parsed(payloads, F.current_timestamp()).where("status = 'ok'").withColumn("key", F.lit(self.KEY))
        best = newest(ok, "key", "generated_at_ms", "arrival", ["brief"]).select("generated_at_ms", "brief")
        cached, found = self.cached(), best.select("generated_at_ms").first()
        last = cached.select("generated_at_ms", "version").first() if cached is not None else None
        if found is None or not replaces(last and last["generated_at_ms"], found["generated_at_ms"]):
            return False
        best = best.withColumns({"seen": F.lit(False), "version": F.lit(last["version"] + 1 if last else 0).cast("long")})
        best.coalesce(1).write.mode("append").parquet(self.state)
        self.alert(decided(self.cached().select("brief"), self.settings(), self.permitted))
        return True

    def mark_seen(self) -> None:
        last = self.cached()
        if last is not None and not last.first()["seen"]:
            last.withColumns({"seen": F.lit(True), "version": F.col("version") + 1}).coalesce(1).write.mode("append").parquet(self.state)

    def start(self, landing: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Follow a landing folder. A trigger takes all files that are there; of those the newest
        snapshot counts, the first to arrive of equally new ones. With ``once`` what is there is
        gone through file by file, in the order of arrival, with an alert for each change."""
        reader = self.spark.readStream.format("text").option("wholetext", True)
        stream = (reader.option("maxFilesPerTrigger", 1) if once else reader).load(landing)
        rows = stream.select("value", F.unix_micros("_metadata.file_modification_time").alias("arrival"))
        writer = rows.writeStream.foreachBatch(lambda batch, _: self.sync(batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=MIN_SYNC_INTERVAL)).start()


def has_note(note: Column) -> Column:
    return present(note)
