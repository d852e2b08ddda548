import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from millrace.llm import exact_dedup as ed

from .data import SF, TEXTS, empty_documents, needs_tables, odd_documents


def expected():
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups[t or ""].append(d)
    return sorted(((d, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=str)


def check(rows):
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == expected()
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({t or "" for _, t in TEXTS}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_odd_rows(spark):
    check(ed.dedup_report(odd_documents(spark)).collect())


def test_a_colliding_digest_changes_nothing(spark):
    check(ed.dedup_report(odd_documents(spark), digest=lambda t: F.length(t) % 3).collect())


def test_kept_rows_pass_with_all_their_columns(spark):
    docs = odd_documents(spark)
    kept = ed.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in TEXTS})
    assert {r["doc_id"] for r in kept.collect()} >= {2, 3, 9, 10, 12, 14}


def test_empty_table(spark):
    assert ed.dedup_report(empty_documents(spark)).count() == 0
    assert ed.deduplicated(empty_documents(spark)).count() == 0


def test_state_outlives_a_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (5, "a")], "doc_id long, text string")
    state = ed.DedupState(spark, str(tmp_path / "state"))
    state.add(ed.fingerprints(docs.where("doc_id < 3")))
    again = ed.DedupState(spark, str(tmp_path / "state"))
    again.add(ed.fingerprints(docs.where("doc_id = 5")))
    got = {r["keep"]["doc_id"]: r["group_size"] for r in again.table().collect()}
    assert got == {5: 2, 2: 1}


def test_two_calls_share_a_folder(spark, tmp_path):
    texts = {1: "a", 2: "b", 5: "a", 7: "c", 3: "b", 8: None, 9: "a"}
    rows = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    for digest in (ed.sha256, lambda t: F.length(t) % 2):
        folder = str(tmp_path / f"state{digest is ed.sha256}")
        first = {r["doc_id"]: r for r in ed.dedup_report(rows([1, 2, 5, 7]), digest, folder).collect()}
        assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in first.items()} == {1: (5, 2, False), 5: (5, 2, True), 2: (2, 1, True), 7: (7, 1, True)}
        second = {r["doc_id"]: r for r in ed.dedup_report(rows([3, 8, 1]), digest, folder).collect()}
        assert {i: (r["keep_id"], r["group_size"], r["kept"], r["keep_here"]) for i, r in second.items()} == {3: (3, 2, True, True), 8: (8, 1, True, True), 1: (5, 3, False, False)}
        third = ed.dedup_report(spark.createDataFrame([(9, "a"), (5, "a"), (7, "c"), (7, "c")], "doc_id long, text string"), digest, folder).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in third) == [(5, 9, 5, False), (7, 7, 3, False), (7, 7, 3, False), (9, 9, 5, True)]


def test_later_calls_return_new_texts_only(spark, tmp_path):
    docs = [spark.createDataFrame(r, "doc_id long, text string, x int") for r in ([(1, "a", 0), (5, "a", 1), (2, "b", 2)], [(3, "a", 3), (2, "b", 4), (4, "d", 5), (4, "d", 5), (6, "b", 6)], [])]
    folder = str(tmp_path / "state")
    got = [sorted((r["doc_id"], r["x"]) for r in ed.deduplicated(d, folder).collect()) for d in docs]
    assert got == [[(2, 2), (5, 1)], [(4, 5), (6, 6)], []]


def test_the_content_of_earlier_calls_is_read_where_it_lies(spark, tmp_path):
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    spark.createDataFrame([(1, "ab"), (2, "cd")], "doc_id long, text string").coalesce(1).write.parquet(paths[0])
    spark.createDataFrame([(9, "ab"), (8, "ef")], "doc_id long, text string").coalesce(1).write.parquet(paths[1])
    folder = str(tmp_path / "state")
    reports = [ed.dedup_report(spark.read.parquet(p), lambda t: F.length(t), folder).collect() for p in paths]
    assert all(r["locator"]["file"].startswith("file:") for rows in reports for r in rows)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in reports[0]) == [(1, 1, 1), (2, 2, 1)]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in reports[1]) == [(8, 8, 1), (9, 9, 2)]


def test_the_plan_has_no_python(spark):
    plan = ed.dedup_report(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@needs_tables
def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in ed.op8_exact_dedup(spark, SF).collect())
    assert got == sorted(con.execute(ed.ORACLE).fetchall())
