"""Invented candidates, as a published payload and as rows."""

import json

from millrace.sources.schema import PAYLOAD, exploded, flat
from pyspark.sql import functions as F

CANDIDATES = [
    {"ticker": "AAA", "name": "Alpha", "dropPct": -15.8, "marketCapUsd": 5.9e9, "fwdPe": 8.3, "paysDividend": True, "sector": "Consumer discretionary", "verdict": "Real Bargain"},
    {"ticker": "BBB", "dropPct": None, "marketCapUsd": None, "fwdPe": None, "paysDividend": None, "sector": None, "verdict": "value trap"},
    {"ticker": "CCC", "dropPct": -9.9, "marketCapUsd": 2e9, "fwdPe": 5, "paysDividend": True, "sector": "Banks", "verdict": "wait and see"},
    {"ticker": "DDD", "dropPct": -10, "marketCapUsd": 5e8, "fwdPe": 15, "paysDividend": False, "sector": "Renewable Energy", "verdict": "real bargain"},
    {"ticker": "EEE", "dropPct": 12, "marketCapUsd": 6e8, "fwdPe": -3, "paysDividend": True, "sector": "China", "verdict": "other"},
    {"ticker": "FFF", "dropPct": -20, "marketCapUsd": 1e9, "fwdPe": "n/a", "paysDividend": None, "sector": "", "verdict": None},
]
WATCH = [{"ticker": "xom", "name": "first", "dropPct": -4.0}, {"ticker": "", "name": "none", "dropPct": -50}, {"ticker": "XOM", "name": "dup", "dropPct": -30}]


def payload(candidates=CANDIDATES, watch=WATCH, at="2026-08-04T10:30:00Z", note="A quiet day."):
    return json.dumps({"generatedAt": at, "brief": {"asOf": "4 August", "note": note, "candidates": candidates, "watch": watch}})


def brief(spark, **more):
    return spark.createDataFrame([(payload(**more),)], "value string").select(F.from_json("value", PAYLOAD).alias("p")).select("p.brief")


def rows(spark, array="candidates", **more):
    return brief(spark, **more).select(*exploded(F.col(f"brief.{array}"))).where("c is not null").select("pos", *flat())
