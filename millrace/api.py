"""The engine's surface for one user and one published snapshot.

``Engine`` binds a session, a store and the place where snapshots are published; its methods
are what an app calls. Tables go in and out as DataFrames, settings as ``Settings``.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.screen import blind_spots, filter_stats, screen
from millrace.operators.watch import entries_before_any_brief, user_list, watch_entries
from millrace.sources.fetch import fetched
from millrace.sources.schema import PAYLOAD, exploded, flat
from millrace.sources.settings import CAPS, DISCLAIMER, SECTORS, SNAPSHOT_KEY, STALE_AFTER_MS, Settings, preview_line
from millrace.sources.snapshots import epoch_ms, with_status
from millrace.sources.store import Store
from millrace.streaming.sync import refreshed, replaces

DEFAULTS = Settings()

__all__ = ["CAPS", "DEFAULTS", "DISCLAIMER", "SECTORS", "SNAPSHOT_KEY", "STALE_AFTER_MS", "BriefError", "Engine", "Settings", "preview_line"]


class BriefError(Exception):
    """A fetch that gave no snapshot: a message to show and a status (404: none published yet)."""

    def __init__(self, message: str, status: int):
        super().__init__(message)
        self.status = status


class Engine:
    """``published``: an http(s) URL, or a path that Spark reads."""

    def __init__(self, spark: SparkSession, store: str, published: str):
        self.spark, self.store, self.published = spark, Store(spark, store), published

    # store
    def get(self, key: str, fallback: Any = None) -> Any:
        return self.store.get(key, fallback)

    def put(self, key: str, value: Any) -> None:
        self.store.put(key, value)

    def get_settings(self) -> Settings:
        return self.store.settings()

    def put_settings(self, settings: Settings) -> None:
        self.store.put_settings(settings)

    def get_brief(self) -> dict | None:
        return self.store.snapshot()

    # snapshots
    def fetch_published(self) -> dict:
        """``brief`` and ``generatedAtEpochMs`` of what is published now, or a BriefError."""
        if self.published.startswith(("http://", "https://")):
            rows = fetched(self.spark, self.published)
        else:
            rows = with_status(self.spark.read.text(self.published, wholetext=True), F.lit("response"), F.lit(200))
        stamp = epoch_ms(F.get_json_object("value", "$.generatedAt"), F.current_timestamp())
        row = rows.withColumn("ms", F.when(F.col("status") == "ok", stamp)).first()
        if row["status"] != "ok":
            raise BriefError(row["message"], row["code"] or 0)
        return {"brief": json.loads(row["value"])["brief"], "generatedAtEpochMs": row["ms"]}

    def sync_published(self) -> tuple[bool, dict | None]:
        """Whether the cached snapshot changed, and it; only a strictly newer one replaces it."""
        fresh, cached = self.fetch_published(), self.get_brief()
        if not replaces(cached and cached["generatedAtEpochMs"], fresh["generatedAtEpochMs"]):
            return False, cached
        self.put(SNAPSHOT_KEY, fresh | {"seen": False})
        return True, self.get_brief()

    def mark_seen(self) -> None:
        cached = self.get_brief()
        if cached and not cached.get("seen"):
            self.put(SNAPSHOT_KEY, cached | {"seen": True})

    # tables of a snapshot
    def brief_table(self, snapshot: dict) -> DataFrame:
        text = json.dumps({"brief": snapshot["brief"]})
        return self.spark.createDataFrame([(text,)], "value string").select(F.from_json("value", PAYLOAD).alias("p")).select("p.brief")

    def candidates(self, snapshot: dict, array: str = "candidates") -> DataFrame:
        return self.brief_table(snapshot).select(*exploded(F.col(f"brief.{array}"))).where("c is not null").select("pos", *flat())

    def filter_candidates(self, snapshot: dict, s: Settings) -> DataFrame:
        return screen(self.candidates(snapshot), s)

    def filter_stats(self, snapshot: dict, s: Settings) -> DataFrame:
        return filter_stats(self.candidates(snapshot), s)

    def blind_spots(self, snapshot: dict, s: Settings) -> list[str]:
        return self.filter_stats(snapshot, s).select(blind_spots(s).alias("spots")).first()["spots"]

    def watch_entries(self, snapshot: dict | None, s: Settings) -> DataFrame:
        user = user_list(self.spark, s.watchlist)
        if snapshot is None:
            return entries_before_any_brief(user)
        return watch_entries(self.candidates(snapshot, "watch"), self.candidates(snapshot), user)

    def refresh_brief(self) -> dict:
        """Sync; if something changed, what is shown and the watch hit (or None)."""
        settings = self.get_settings()
        changed, snapshot = self.sync_published()
        if not changed:
            return {"ok": False, "reason": "unchanged"}
        shown, hit = refreshed(self.brief_table(snapshot), settings)
        return {"ok": True, "brief": snapshot["brief"], "shown": shown, "settings": settings, "watchlist_hit": hit.first()}
