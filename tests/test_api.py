import http.server
import socket
import threading

import pytest

from millrace.api import BriefError, Engine, Settings
from millrace.sources import fetch

from .fixtures import payload


class Handler(http.server.BaseHTTPRequestHandler):
    body, code = payload(), 200

    def do_GET(self):
        self.send_response(Handler.code)
        self.end_headers()
        if Handler.code == 200:
            self.wfile.write(Handler.body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Handler.body, Handler.code = payload(), 200
    yield f"http://127.0.0.1:{server.server_address[1]}/brief.json"
    server.shutdown()


def test_refresh_over_http(spark, tmp_path, url):
    engine = Engine(spark, str(tmp_path / "kv"), url)
    engine.put_settings(Settings(watchlist=("fff",), drop_threshold=20))
    assert [r["ticker"] for r in engine.watch_entries(None, engine.get_settings()).collect()] == ["fff"]
    result = engine.refresh_brief()
    assert result["ok"] and result["watchlist_hit"]["drop_pct"] == -50.0
    assert [r["ticker"] for r in result["shown"].orderBy("pos").collect()] == ["BBB", "FFF"]
    assert engine.refresh_brief() == {"ok": False, "reason": "unchanged"}
    snapshot = engine.get_brief()
    assert snapshot["seen"] is False and engine.filter_stats(snapshot, Settings()).first()["total"] == 6
    assert engine.blind_spots(snapshot, Settings(max_pe=12)) == ["2 with no P/E on file"]
    assert [r["ticker"] for r in engine.watch_entries(snapshot, Settings(watchlist=("aaa",))).orderBy("src", "pos").collect()] == ["XOM", "AAA"]
    assert [r["ticker"] for r in engine.filter_candidates(snapshot, Settings()).orderBy("pos").collect()] == ["AAA", "BBB", "DDD"]
    # failures leave the snapshot as it is
    for Handler.code, Handler.body, status in ((404, "", 404), (503, "", 503), (200, "broken", 0), (200, '{"brief":null}', 404)):
        with pytest.raises(BriefError) as e:
            engine.refresh_brief()
        assert e.value.status == status and engine.get_brief() == snapshot


def test_outcomes_without_a_response(spark, tmp_path, url):
    assert fetch.fetch("http://127.0.0.1:9/none")[0] == "error"
    got = fetch.fetched(spark, "http://127.0.0.1:9/none").first()
    assert (got["status"], got["code"]) == ("unreachable", 0)
    ok = fetch.fetched(spark, url)
    fetch.land(ok, str(tmp_path / "landing"))
    assert spark.read.text(str(tmp_path / "landing"), wholetext=True).first()[0].strip() == payload()


def test_a_server_that_does_not_answer_in_time(spark):
    with socket.socket() as silent:
        silent.bind(("127.0.0.1", 0))
        silent.listen()
        got = fetch.fetched(spark, f"http://127.0.0.1:{silent.getsockname()[1]}/", timeout_ms=300).first()
    assert (got["outcome"], got["status"], got["code"]) == ("timeout", "timeout", 0) and got["message"].startswith("That took too long")


def test_a_snapshot_is_marked_as_seen(spark, tmp_path):
    (tmp_path / "brief.json").write_text(payload())
    engine = Engine(spark, str(tmp_path / "kv"), str(tmp_path / "brief.json"))
    engine.mark_seen()
    assert engine.get_brief() is None
    engine.sync_published()
    assert engine.get_brief()["seen"] is False
    engine.mark_seen()
    assert engine.get_brief()["seen"] is True and engine.sync_published()[0] is False and engine.get_brief()["seen"] is True


def test_a_published_file(spark, tmp_path):
    (tmp_path / "brief.json").write_text(payload())
    engine = Engine(spark, str(tmp_path / "kv"), str(tmp_path / "brief.json"))
    assert engine.sync_published()[0] is True and engine.sync_published()[0] is False
    assert engine.get_brief()["generatedAtEpochMs"] == 1785839400000
