"""Fetching a published snapshot over HTTP and landing it as a file for the readers."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .settings import FETCH_TIMEOUT_MS
from .snapshots import with_status

RESPONSE = "outcome string, http int, value string"


def fetch(url: str, timeout_ms: int = FETCH_TIMEOUT_MS) -> tuple[str, int | None, str | None]:
    """``outcome, http, text``: ``timeout``, ``error`` or ``response`` with its code and body."""
    request = urllib.request.Request(url, headers={"Cache-Control": "no-cache"})
    try:
        with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as response:
            return "response", response.status, response.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return "response", e.code, None
    except TimeoutError:
        return "timeout", None, None
    except urllib.error.URLError as e:
        return ("timeout" if isinstance(e.reason, TimeoutError) else "error"), None, None
    except OSError:
        return "error", None, None


def fetched(spark: SparkSession, url: str, timeout_ms: int = FETCH_TIMEOUT_MS) -> DataFrame:
    """One row: ``outcome, http, value, status, message, code``."""
    row = spark.createDataFrame([fetch(url, timeout_ms)], RESPONSE)
    return with_status(row, F.col("outcome"), F.col("http"))


def land(response: DataFrame, folder: str) -> None:
    """Add an ok response's text to a landing folder, for ``Sync.start`` to follow."""
    response.where("status = 'ok'").select("value").coalesce(1).write.mode("append").text(folder)
