import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import contract, posts
from millrace.sources import settings as st
from millrace.sources import snapshots
from millrace.sources.store import Store

from .fixtures import CANDIDATES, payload, rows


@pytest.mark.parametrize(
    "text, status",
    [
        (payload(), "ok"),
        ('{"brief":{"candidates":[]}}', "ok"),
        ("{}", "not_published"),
        ("null", "not_published"),
        ('{"brief":null}', "not_published"),
        ('{"brief":""}', "not_published"),
        ('{"brief":0}', "not_published"),
        ('{"brief":false}', "not_published"),
        ("not json", "unreadable"),
        ("", "unreadable"),
        ('{"brief":{}}', "unreadable"),
        ('{"brief":"text"}', "unreadable"),
        ('{"brief":{"candidates":{}}}', "unreadable"),
        ('{"brief":{"candidates":null}}', "unreadable"),
    ],
)
def test_payload_status(spark, text, status):
    assert spark.createDataFrame([(text,)], "v string").select(snapshots.payload_status(F.col("v"))).first()[0] == status


def test_parsing_types_are_strict(spark):
    odd = [{"ticker": 7, "dropPct": "-15.8", "fwdPe": "NaN", "paysDividend": "false"}]
    got = rows(spark, candidates=odd).first()
    assert (got["ticker"], got["drop_pct"], got["fwd_pe"], got["pays_dividend"]) == ("7", None, None, None)


def test_time_of_generation_falls_back_to_now(spark):
    df = spark.createDataFrame([("2026-08-04T10:30:00Z",), ("garbage",), (None,)], "t string")
    now = F.lit("2026-01-01").cast("timestamp")
    assert [r[0] for r in df.select(snapshots.epoch_ms(F.col("t"), now)).collect()] == [1785839400000, 1767225600000, 1767225600000]


def test_landed_files_are_parsed_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(json.loads(payload()), indent=2))
    got = snapshots.parsed(snapshots.read_payloads(spark, str(tmp_path)), F.current_timestamp()).first()
    assert got["status"] == "ok" and len(got["brief"]["candidates"]) == 6 and got["generated_at_ms"] == 1785839400000


def test_deep_watchlist(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"_comment": "x",\n "tickers": ["XOM", "T"]}')
    assert [tuple(r) for r in snapshots.read_deep_watchlist(spark, f"{tmp_path}/w.json").collect()] == [(0, "XOM"), (1, "T")]


def test_posts_newest_first(spark, tmp_path):
    (tmp_path / "2026-07-26-first-post.md").write_text('---\nlayout: post\ntitle: "First post"\ndate: 2026-07-26\n---\n\nHello <b>there</b>.\n\nMore.\n')
    (tmp_path / "2026-08-04-next.md").write_text("---\ntitle: Next\ndate: 2026-08-04\n---\n" + "word " * 40)
    got = [tuple(r) for r in posts.cards(snapshots.read_posts(spark, str(tmp_path))).collect()]
    assert got[0][:3] == ("Next", "/blog/2026/08/04/next/", "August 4, 2026") and got[0][3] == " ".join(["word"] * 30) + "..."
    assert got[1] == ("First post", "/blog/2026/07/26/first-post/", "July 26, 2026", "Hello there.")


def test_store_and_settings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"))
    assert store.get("nothing", 5) == 5 and store.settings() == st.Settings() and store.snapshot() is None
    store.put_settings(st.Settings(max_pe=12, watchlist=("A",)))
    store.put_settings(st.Settings(max_pe=15, watchlist=("B",)))
    assert store.settings() == st.Settings(max_pe=15, watchlist=("B",))
    store.put("brief", {"brief": {"candidates": 3}})
    assert store.snapshot() is None
    store.put("brief", {"brief": {"candidates": []}, "seen": False})
    assert store.snapshot()["seen"] is False
    store.put("bad", {1, 2})
    assert store.get("bad") is None


def test_a_stored_null_counts_and_a_missing_key_does_not():
    assert st.merged({"candidateCount": 5, "maxPe": None}) == st.Settings(candidate_count=5)
    assert st.merged({"minMarketCap": None}).cap_usd == 5e8
    with pytest.raises(ValueError):
        st.Settings(candidate_count=-1)


def test_preview_and_choices():
    s = st.Settings(max_pe=12, dividend_payers_only=True, excluded_sectors=("Energy", "Banks"))
    assert st.preview_line(s) == "falls of 10%+ in a day or week, above $500m market cap, forward P/E under 12, dividend payers only, excluding energy, banks. Top 3."
    assert st.outside_choices(s) == [] and st.outside_choices(st.Settings(drop_threshold=11, excluded_sectors=("x",))) == ["drop_threshold", "excluded_sectors"]
    assert st.toggled(("a", "b"), "a") == ("b",) and st.toggled(("b",), "a") == ("b", "a")


def test_contract_rules(spark):
    full = [{"ticker": "A", "exchange": "TSX", "currency": "CAD", "verdict": "Real bargain", "causeType": "one-off", "sector": "Banks", "business": "makes things", "dropPct": -12.0, "price": 2.0, "marketCapUsd": 6e8}]
    broken = [{**full[0], "exchange": "NYSE", "sector": " ", "business": "w " * 15, "verdict": "maybe"}]
    seen = lambda c: rows(spark, candidates=c).select(contract.violations(rows(spark).columns)).first()[0]
    assert seen(full) == [] and seen(broken) == ["verdict", "currency", "sector", "business_words"]
    ready = lambda c: contract.publishable(rows(spark, candidates=c)).first()[0]
    assert ready(full) and not ready(full + broken) and not ready([])
    assert contract.screenable(rows(spark, candidates=full * 8)).count() == 6


def test_numbers_sent_as_text_are_found(spark):
    df = spark.createDataFrame([(payload(),), (payload(candidates=CANDIDATES[:2]),), ("broken",)], "v string")
    assert [r[0] for r in df.select(contract.mistyped_numbers(F.col("v"))).collect()] == [["fwdPe"], [], []]
