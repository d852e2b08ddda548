"""A key-value store as a folder: each key's value is the last one written, as JSON text.

Reads fall back on any error and writes swallow errors, as the app's own store does: the
session works on in memory.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .settings import SETTINGS_KEY, SNAPSHOT_KEY, Settings, merged


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, key: str, fallback: Any = None) -> Any:
        try:
            rows = self.spark.read.schema("version long, value string").json(f"{self.path}/{key}")
            # a file that is there but holds another type reads as null
            last = rows.agg(F.max_by("value", "version").alias("v"), F.count("value").alias("n")).first()
            return json.loads(last["v"]) if last and last["n"] else fallback
        except (PySparkException, ValueError):
            return fallback

    def put(self, key: str, value: Any) -> None:
        try:
            folder = f"{self.path}/{key}"
            try:
                version = self.spark.read.schema("version long, value string").json(folder).agg(F.max("version")).first()[0] or 0
            except PySparkException:
                version = 0
            row = self.spark.range(1).select(F.lit(version + 1).cast("long").alias("version"), F.lit(json.dumps(value)).alias("value"))
            row.coalesce(1).write.mode("append").json(folder)
        except (PySparkException, TypeError):
            pass

    def settings(self) -> Settings:
        return merged(self.get(SETTINGS_KEY, {}))

    def put_settings(self, settings: Settings) -> None:
        self.put(SETTINGS_KEY, settings.to_stored())

    def snapshot(self) -> dict | None:
        """The cached snapshot, if its brief has an array of candidates."""
        found = self.get(SNAPSHOT_KEY)
        brief = found.get("brief") if isinstance(found, dict) else None
        return found if isinstance(brief, dict) and isinstance(brief.get("candidates"), list) else None
