"""DuckDB SQL for the queries, written from the rules and not from the operators."""

from __future__ import annotations

from .surrogate import DEEP, DEEP_TICKER, SNAPSHOT, USER_LIST, WATCHED, candidates_sql

CAND = candidates_sql()


def _screen(where: str, limit: int | None) -> str:
    tail = f"LIMIT {limit}" if limit is not None else ""
    return f"{CAND} SELECT pos, ticker, sector, drop_pct, market_cap_usd, fwd_pe FROM cand WHERE {where} ORDER BY pos {tail}"


def _rules(drop: int, cap: str, pe: int | None = None, dividend: bool = False, excluded: tuple[str, ...] = ()) -> str:
    rules = [f"NOT coalesce(abs(drop_pct) < {drop}, false)", f"NOT coalesce(market_cap_usd < {cap}, false)"]
    if pe:
        rules.append(f"NOT coalesce(fwd_pe > {pe}, false)")
    if dividend:
        rules.append("pays_dividend IS DISTINCT FROM false")
    for x in excluded:
        rules.append(f"(coalesce(sector, '') = '' OR NOT (contains(lower(sector), '{x}') OR contains('{x}', lower(sector))))")
    return " AND ".join(rules)


def _fixed(x: str, digits: int) -> str:
    ties, step = {1: (4, "0.01"), 2: (8, "0.001")}[digits]
    return f"printf('%.{digits}f', {x} + CASE WHEN abs({x}) * {ties} % 2 = 1 THEN sign({x}) * CAST({step} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def _money(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE concat(CASE WHEN currency = 'CAD' THEN 'C$' ELSE '$' END, {_fixed(x, 2)}) END"


DEFAULT, TIGHT = _rules(10, "5e8"), _rules(15, "1e9", 12, True)
SECTOR, ALL = _rules(10, "5e8", excluded=("econ", "promotional")), _rules(10, "5e9", 20, excluded=("banks", "large"))
USERS = "users AS (SELECT unnest(range(len(l))) AS pos, unnest(l) AS ticker FROM (SELECT [" + ", ".join(f"'{t}'" for t in USER_LIST) + "] AS l))"
DEEPS = f"deeps AS (SELECT * REPLACE ({DEEP_TICKER} AS ticker) FROM cand WHERE {DEEP})"

_STATUS = "CASE event_id % 10 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_published' WHEN 2 THEN 'not_published' WHEN 6 THEN 'not_published' WHEN 7 THEN 'not_published' ELSE 'unreadable' END"
_POSITION = "CASE WHEN price IS NOT NULL AND low52 IS NOT NULL AND high52 IS NOT NULL AND {x} IS NOT NULL AND high52 > low52 THEN least(greatest(({x} - low52) / (high52 - low52), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END"
_VALUE = "CASE WHEN (pos + i) % 4 = 0 OR (pos + i) % 5 = 0 OR (pos + i) % 7 = 0 THEN '—' ELSE concat('v', i) END"
_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_STRIPPED = "regexp_replace(html, '(?s)<script.*?</script>|<!--.*?-->|<style.*?</style>|<.*?>', '', 'g')"

ORACLES = {
    "screen_default": _screen(DEFAULT, 3),
    "screen_tight": _screen(TIGHT, 5),
    "screen_sector": _screen(SECTOR, 5),
    "screen_all": _screen(ALL, None),
    "screen_array": f"{CAND} SELECT {SNAPSHOT} AS snapshot, row_number() OVER (PARTITION BY {SNAPSHOT} ORDER BY pos) - 1 AS rank, ticker, drop_pct FROM cand WHERE {TIGHT} QUALIFY rank < 5",
    "screen_grouped": f"{CAND} SELECT {SNAPSHOT} AS snapshot, pos, ticker, drop_pct FROM cand WHERE {TIGHT} QUALIFY row_number() OVER (PARTITION BY {SNAPSHOT} ORDER BY pos) <= 5",
    "screen_null_array": f"{CAND} SELECT {SNAPSHOT} AS snapshot, CASE WHEN {SNAPSHOT} % 3 = 0 THEN 0 ELSE least(count(*) FILTER (WHERE {TIGHT}), 5) END AS shown FROM cand GROUP BY {SNAPSHOT}",
    "screen_unknown_tier": _screen(DEFAULT, 5),
    "screen_stats": f"{CAND} SELECT count(*) AS total, least(count(*) FILTER (WHERE {TIGHT}), 5) AS shown, count(*) FILTER (WHERE fwd_pe IS NULL) AS missing_fwd_pe, count(*) FILTER (WHERE market_cap_usd IS NULL) AS missing_market_cap_usd, count(*) FILTER (WHERE coalesce(sector, '') = '') AS missing_sector FROM cand",
    "blind_spots": f"""{CAND} SELECT concat(least(count(*) FILTER (WHERE {ALL}), 5), ' of ', count(*), ' in today''s brief match') AS effect,
        concat(count(*) FILTER (WHERE fwd_pe IS NULL), ' with no P/E on file, ', count(*) FILTER (WHERE market_cap_usd IS NULL), ' with no market cap, ', count(*) FILTER (WHERE coalesce(sector, '') = ''), ' with no sector — those can''t be ruled out, so they stay.') AS gap FROM cand""",
    "brief_summary": f"""{CAND}, n AS (SELECT count(*) AS total, least(count(*) FILTER (WHERE {DEFAULT}), 3) AS shown FROM cand)
        SELECT 'whole' AS which, concat(shown, CASE WHEN shown = 1 THEN ' candidate' ELSE ' candidates' END) AS count_text, 'A quiet day.' AS note,
        CASE WHEN total > shown THEN concat('Screened ', total, ' · showing the ', shown, ' that match your settings') END AS screened_text, NULL AS nothing_text FROM n
        UNION ALL SELECT 'none', '0 candidates', NULL, concat('Screened ', count(*), ' · showing the 0 that match your settings'),
        concat('The morning run found ', count(*), ' candidates, but none get through your filters. Loosen them in Settings.') FROM cand WHERE drop_pct IS NOT NULL""",
    "verdict_tally": f"""{CAND}, shown AS (SELECT lower(verdict) AS verdict FROM cand WHERE {DEFAULT}),
        kinds(rank, verdict, class, label) AS (VALUES (0, 'real bargain', 'bargain', 'real bargain'), (1, 'wait and see', 'wait', 'to watch'), (2, 'value trap', 'trap', 'value trap'))
        SELECT rank, verdict, class, label, count(*) AS n FROM kinds JOIN shown USING (verdict) GROUP BY ALL""",
    "range_position": f"""{CAND}, placed AS (SELECT pos, {_POSITION.format(x='price')} AS now, {_POSITION.format(x='prev_close')} AS prev FROM cand)
        SELECT pos, now AS range_now, CASE WHEN now IS NOT NULL THEN concat({_fixed('now * 100', 2)}, '%') END AS range_text,
        CASE WHEN now IS NULL THEN '52-week range not confirmed' WHEN now <= 0.12 THEN 'Trading at the bottom of its 52-week range.' WHEN now <= 0.33 THEN 'In the lower third of its 52-week range.'
             WHEN now <= 0.66 THEN 'Around mid-range for the past year.' ELSE 'Still in the upper third of its 52-week range.' END AS range_caption,
        CASE WHEN prev > now THEN concat({_fixed('now * 100', 2)}, '%') END AS segment_left, CASE WHEN prev > now THEN concat({_fixed('(prev - now) * 100', 2)}, '%') END AS segment_width FROM placed""",
    "tearsheet_format": f"""{CAND} SELECT pos, CASE WHEN ticker = '' THEN '—' ELSE ticker END AS ticker, nullif(exchange, '') AS exchange, coalesce(verdict, 'unrated') AS verdict,
        CASE lower(verdict) WHEN 'real bargain' THEN 'bargain' WHEN 'wait and see' THEN 'wait' WHEN 'value trap' THEN 'trap' ELSE 'neutral' END AS verdict_class, name,
        {_money('price')} AS price_text, CASE WHEN prev_close IS NOT NULL THEN {_money('prev_close')} END AS prev_text,
        CASE WHEN drop_pct IS NULL THEN '—' ELSE concat({_fixed('drop_pct', 1)}, '%') END AS drop_text, CASE WHEN drop_window <> '' THEN concat('over ', drop_window) END AS window_text,
        business, lower(cause_type) AS cause_type, CASE lower(cause_type) WHEN 'one-off' THEN 'oneoff' WHEN 'fixable' THEN 'fixable' WHEN 'permanent' THEN 'permanent' ELSE 'neutral' END AS cause_class,
        CASE WHEN pos % 4 <> 0 THEN 'trouble at ' || name END AS cause, CASE WHEN pos % 5 <> 0 THEN 'demand holds' END AS must_go_right, CASE WHEN pos % 6 <> 0 THEN 'no more ' || name END AS could_go_wrong,
        CASE WHEN pos % 7 = 0 THEN '' ELSE concat('Margin=', CASE WHEN pos % 3 = 0 THEN '—' ELSE concat(pos % 40, '%') END, '|Debt=', CASE WHEN pos % 4 = 0 THEN '—' ELSE 'low' END) END AS metrics FROM cand""",
    "metrics_shown": f"{CAND} SELECT pos, i, CASE WHEN i % 3 = 0 THEN '' ELSE concat('m', i) END AS label, {_VALUE} AS value FROM cand, (SELECT unnest(range(8)) AS i)",
    "watch_entries": f"""{CAND}, {USERS}, {DEEPS},
        d AS (SELECT upper(ticker) AS t, arg_min(pos, pos) AS pos, count(*) AS n FROM deeps WHERE ticker <> '' GROUP BY 1),
        u AS (SELECT upper(ticker) AS t, min(pos) AS pos FROM users GROUP BY 1),
        c AS (SELECT upper(ticker) AS t, max(pos) AS pos FROM cand GROUP BY 1),
        e AS (SELECT 0 AS src, d.pos, d.t AS ticker, true AS deep, d.pos AS candidate_pos FROM d
              UNION ALL SELECT 1, u.pos, u.t, false, c.pos FROM u LEFT JOIN c USING (t) WHERE u.t NOT IN (SELECT t FROM d))
        SELECT e.src, e.pos, e.ticker, e.deep, e.candidate_pos IS NOT NULL AS openable, coalesce(e.candidate_pos, -1) AS candidate_pos,
        CASE WHEN e.candidate_pos IS NULL THEN 'no double-digit fall today' ELSE coalesce(cand.name, '') END AS text FROM e LEFT JOIN cand ON cand.pos = e.candidate_pos""",
    "entries_before_any_brief": f"WITH {USERS} SELECT pos, ticker, false AS deep FROM users",
    "watch_hit": f"""{CAND}, {USERS}, {DEEPS}, b AS (SELECT 0 AS src, pos, ticker, drop_pct FROM deeps UNION ALL SELECT 1, pos, ticker, drop_pct FROM cand WHERE upper(ticker) IN (SELECT upper(ticker) FROM users))
        SELECT * FROM b WHERE abs(drop_pct) >= 20 ORDER BY src, pos LIMIT 1""",
    "watched_candidates": f"{CAND}, {USERS} SELECT pos, ticker, drop_pct FROM cand WHERE upper(ticker) IN (SELECT upper(ticker) FROM users)",
    "brief_upsert": "SELECT user_id, date_trunc('hour', ts) AS hour, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC, event_id) = 1",
    "state_upsert": """WITH e AS (SELECT *, date_trunc('hour', ts) AS hour FROM events),
        s AS (SELECT * FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour DESC, event_id) = 1),
        i AS (SELECT * FROM e WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour DESC, event_id) = 1)
        SELECT coalesce(s.user_id, i.user_id) AS user_id, CASE WHEN s.user_id IS NULL OR i.hour > s.hour THEN i.event_id ELSE s.event_id END AS event_id,
        CASE WHEN s.user_id IS NULL OR i.hour > s.hour THEN i.value ELSE s.value END AS value, NOT (s.user_id IS NULL OR coalesce(i.hour > s.hour, false)) AS seen FROM s FULL JOIN i ON s.user_id = i.user_id""",
    "stale_flag": """SELECT event_id, 1704500000000 - epoch_ms(ts) > 216000000 AS stale,
        CASE WHEN 1704500000000 - epoch_ms(ts) > 216000000 THEN concat('This brief is from ', dayname(ts), '. Pull down to refresh.') END AS banner FROM events""",
    "props_parse": "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events",
    "payload_status": f"SELECT event_id, {_STATUS} AS status FROM events",
    "response_status": f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 404 WHEN event_id % 19 = 0 THEN 503 ELSE 200 END AS http,
            CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'unreachable' WHEN event_id % 17 = 0 THEN 'not_published' WHEN event_id % 19 = 0 THEN 'http_error' ELSE {_STATUS} END AS status FROM events)
        SELECT event_id, status, CASE status WHEN 'timeout' THEN 'That took too long. Try again.' WHEN 'unreachable' THEN 'Couldn''t reach the brief. Check your connection.'
            WHEN 'not_published' THEN 'No brief has been published yet. The first one arrives after tomorrow morning''s run.' WHEN 'unreadable' THEN 'The published brief was unreadable. Your last one is unchanged.'
            WHEN 'http_error' THEN 'Couldn''t load the brief (HTTP 503).' END AS message,
        CASE status WHEN 'ok' THEN 200 WHEN 'not_published' THEN 404 WHEN 'http_error' THEN http ELSE 0 END AS code FROM r""",
    "payload_parsed": """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'not_published' ELSE 'ok' END AS status,
        CASE event_id % 6 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) WHEN 2 THEN epoch_ms(date_trunc('second', ts)) - 7200000 WHEN 5 THEN -1 ELSE 1704500000000 END AS generated_at_ms,
        CASE WHEN event_id % 6 <> 5 THEN concat('n', event_id) END AS note, CASE WHEN event_id % 6 <> 5 THEN 'A|B' END AS tickers FROM events""",
    "payload_contract": """SELECT event_id, concat_ws(',', CASE WHEN event_id % 6 IN (1, 2, 3, 4) THEN 'generatedAt' END, CASE WHEN event_id % 6 <> 5 AND event_id % 4 = 0 THEN 'dropPct' END,
        CASE WHEN event_id % 6 <> 5 AND event_id % 5 = 0 THEN 'fwdPe' END) AS broken FROM events""",
    "refresh_shown": f"""{CAND}, placed AS (SELECT *, {SNAPSHOT} AS snapshot, row_number() OVER (PARTITION BY {SNAPSHOT} ORDER BY pos) - 1 AS nth FROM cand)
        SELECT snapshot, nth AS pos, ticker, drop_pct, market_cap_usd FROM placed WHERE {DEFAULT} QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY nth) <= 3""",
    "refresh_hit": f"""{CAND}, {USERS}, placed AS (SELECT *, {SNAPSHOT} AS snapshot, row_number() OVER (PARTITION BY {SNAPSHOT} ORDER BY pos) - 1 AS nth FROM cand),
        own AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY nth) - 1 AS place FROM placed WHERE {WATCHED}),
        b AS (SELECT snapshot, 0 AS src, place AS pos, ticker, drop_pct FROM own UNION ALL SELECT snapshot, 1, nth, ticker, drop_pct FROM placed WHERE upper(ticker) IN (SELECT upper(ticker) FROM users))
        SELECT * FROM b WHERE abs(drop_pct) >= 10 QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY src, pos) = 1""",
    "sync_keeps_snapshot": f"""WITH e AS (SELECT *, date_trunc('hour', ts) AS hour FROM events),
        s AS (SELECT * FROM e WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour DESC, event_id) = 1),
        i AS (SELECT * FROM e WHERE event_type <> 'click' AND {_STATUS} = 'ok' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour DESC, event_id) = 1)
        SELECT coalesce(s.user_id, i.user_id) AS user_id, CASE WHEN s.user_id IS NULL OR i.hour > s.hour THEN i.event_id ELSE s.event_id END AS event_id,
        CASE WHEN s.user_id IS NULL OR i.hour > s.hour THEN i.value ELSE s.value END AS value, NOT (s.user_id IS NULL OR coalesce(i.hour > s.hour, false)) AS seen FROM s FULL JOIN i ON s.user_id = i.user_id""",
    "error_shown": f"SELECT event_id, {_STATUS} <> 'ok' AND NOT (event_id % 2 = 0 AND event_id % 3 = 0) AS shown FROM events",
    "seen_marked": "SELECT c_custkey, c_custkey % 2 = 0 OR c_mktsegment = 'BUILDING' AS seen FROM customer",
    "generated_text": "SELECT event_id, strftime(ts, '%A %-d %B') AS day, strftime(ts, '%H:%M') AS clock FROM events",
    "deep_watchlist": "WITH l AS (SELECT c_custkey, [upper(c_mktsegment), '', lower(c_mktsegment)] AS t FROM customer WHERE c_custkey % 5 <> 0) SELECT c_custkey, unnest(range(3)) AS pos, unnest(t) AS ticker FROM l",
    "post_permalinks": "SELECT concat('No. ', o_orderkey) AS title, concat('/blog/', strftime(o_orderdate, '%Y/%m/%d'), '/order-', o_orderkey, '/') AS url, strftime(o_orderdate, '%B %-d, %Y') AS date_text, concat('First words of ', o_orderkey, '.') AS excerpt FROM orders",
    "notify_decision": f"""WITH k AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 40) * CAST(1.25 AS DOUBLE) END AS fall, c_custkey % 2 = 0 AND c_custkey % 7 <> 0 AS may, c_custkey % 5 = 0 AS hit, c_custkey % 4 AS n FROM customer)
        SELECT c_custkey, CASE WHEN may AND hit THEN 'drop' WHEN may AND n > 0 THEN 'new' END AS kind,
        CASE WHEN may AND hit THEN concat(c_mktsegment, ' is down ', CASE WHEN fall IS NULL THEN 'sharply' ELSE concat({_fixed('fall', 1)}, '%') END) WHEN may AND n > 0 THEN concat(n, CASE WHEN n = 1 THEN ' candidate' ELSE ' candidates' END, ' today') END AS title,
        CASE WHEN may AND (hit OR n > 0) THEN CASE WHEN c_custkey % 11 <> 0 THEN c_name ELSE '' END END AS body FROM k""",
    "validate_contract": f"""{CAND} SELECT pos, concat_ws(',', CASE WHEN coalesce(lower(verdict), '') NOT IN ('real bargain', 'wait and see', 'value trap') THEN 'verdict' END,
        CASE WHEN cause_type IS NULL THEN 'cause' END, CASE WHEN coalesce(exchange, '') NOT IN ('NYSE', 'NASDAQ', 'TSX') THEN 'exchange' END,
        CASE WHEN (exchange IS NOT DISTINCT FROM 'TSX') <> (currency IS NOT NULL) THEN 'currency' END, CASE WHEN coalesce(sector, '') = '' THEN 'sector' END) AS broken FROM cand""",
    "publishable": "SELECT * FROM (VALUES ('all', false), ('allowed', true), ('none', false)) AS v(which, publishable)",
    "wide_screen": f"{CAND} SELECT pos, ticker, drop_pct, price FROM cand WHERE drop_pct <= -10 AND price >= 1 AND market_cap_usd >= 5e8 AND exchange IN ('NYSE', 'NASDAQ', 'TSX') ORDER BY pos LIMIT 6",
    "word_limits": f"SELECT item_id, {_WORDS} AS words, {_WORDS} <= 20 AS fits_note FROM benchmark",
    "html_excerpt": f"""WITH w AS (SELECT page_id, string_split_regex(regexp_replace({_STRIPPED}, '^\\s+|\\s+$', '', 'g'), '\\s+') AS l FROM pages)
        SELECT page_id, concat(array_to_string(l[1:30], ' '), CASE WHEN len(l) > 30 THEN '...' ELSE '' END) AS excerpt FROM w""",
    "ticker_sanitise": "SELECT p_partkey, left(regexp_replace(upper(concat(p_brand, '.x-9 ', p_name)), '[^A-Z.\\-]', '', 'g'), 6) AS ticker FROM part",
    "list_edit": """WITH a AS (SELECT c_custkey, ['AAA', upper(c_mktsegment), 'BBB'] AS l, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE 'CCC' END AS x FROM customer)
        SELECT c_custkey, array_to_string(CASE WHEN list_contains(l, x) THEN l ELSE list_append(l, x) END, '|') AS added,
        CASE WHEN list_contains(l, x) THEN concat(x, ' is already on your list.') END AS message, array_to_string(list_filter(l, lambda y: y <> x), '|') AS removed,
        CASE WHEN list_contains(l, x) THEN 1 ELSE -1 END AS place, array_to_string(list_filter(l, lambda y: y <> x)[1:2], '|') || '|' || x || CASE WHEN list_contains(l, x) THEN '' ELSE '|BBB' END AS restored,
        array_to_string(CASE WHEN list_contains(l, x) THEN list_filter(l, lambda y: y <> x) ELSE list_append(l, x) END, '|') AS toggled, l[2] AS first_long FROM a""",
    "newest_first": "SELECT o_orderpriority AS title, concat('/', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS url, strftime(o_orderdate, '%B %-d, %Y') AS date_text FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, url DESC",
    "to_fixed_text": f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_discount / 8 - 100 AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {_fixed('v', 1)} AS one, {_fixed('v', 2)} AS two FROM x",
    "settings_preview": """SELECT * FROM (VALUES (0, 'falls of 10%+ in a day or week, above $500m market cap. Top 3.', '10%+ · above $500m'),
        (1, 'falls of 15%+ in a day or week, above $1bn market cap, forward P/E under 12, dividend payers only. Top 5.', '15%+ · above $1bn'),
        (2, 'falls of 10%+ in a day or week, above $500m market cap, excluding econ, promotional. Top 5.', '10%+ · above $500m')) AS v(n, preview, header)""",
    "settings_merged": """SELECT * FROM (VALUES (0, CAST(10 AS DOUBLE), 'M500', CAST(NULL AS DOUBLE), false, '', 3, '', true, true), (1, 10, 'M500', NULL, false, '', 3, '', true, true),
        (2, 15, 'M500', 12, false, '', 3, '', true, true), (3, 10, 'M500', NULL, false, 'Banks,Energy', -1, '', true, true), (4, 10, NULL, NULL, false, '', 3, 'XOM', false, true))
        AS v(n, drop_threshold, min_market_cap, max_pe, dividend_payers_only, excluded_sectors, candidate_count, watchlist, notify_on_new_brief, notify_on_watchlist_drop)""",
    "store_roundtrip": """SELECT * FROM (VALUES ('missing', '"fallback"'), ('last', '"ümlaut"'), ('defaults', 'true'), ('settings', '12 XOM'),
        ('snapshot: text', 'false'), ('snapshot: no array', 'false'), ('snapshot: good', 'true')) AS v(step, found)""",
    "engine_refresh": f"""{CAND}, {USERS}, one AS (SELECT * FROM cand WHERE {SNAPSHOT} = 0), own AS (SELECT DISTINCT upper(ticker) AS t FROM users),
        deep AS (SELECT upper(ticker) AS t FROM one WHERE {WATCHED} AND ticker <> '' GROUP BY 1),
        hits AS (SELECT 0 AS src, pos, ticker, drop_pct FROM one WHERE {WATCHED} UNION ALL SELECT 1, pos, ticker, drop_pct FROM one WHERE upper(ticker) IN (SELECT t FROM own))
        SELECT 'changed' AS step, 'True' AS found UNION ALL SELECT 'again', 'False' UNION ALL SELECT 'seen', 'False' UNION ALL SELECT 'marked', 'True'
        UNION ALL SELECT 'shown', string_agg(ticker, '|' ORDER BY pos) FROM (SELECT ticker, pos FROM one WHERE {DEFAULT} ORDER BY pos LIMIT 3)
        UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR) FROM one
        UNION ALL SELECT * FROM (SELECT 'hit', ticker FROM hits WHERE abs(drop_pct) >= 10 ORDER BY src, pos LIMIT 1)
        UNION ALL SELECT 'spots', concat_ws('|', concat(count(*) FILTER (WHERE fwd_pe IS NULL), ' with no P/E on file'), concat(count(*) FILTER (WHERE market_cap_usd IS NULL), ' with no market cap'), concat(count(*) FILTER (WHERE coalesce(sector, '') = ''), ' with no sector')) FROM one
        UNION ALL SELECT 'entries', string_agg(t, '|' ORDER BY t) FROM (SELECT t FROM deep UNION SELECT t FROM own)""",
    "settings_choices": "SELECT * FROM (VALUES (0, ''), (1, ''), (2, 'excluded_sectors'), (3, 'candidate_count,excluded_sectors'), (4, 'drop_threshold,min_market_cap'), (5, '')) AS v(n, outside)",
}
