from collections import defaultdict

import pytest

import corpus_pipeline
from millrace.llm import pii

from .data import SF, clashing_documents, empty_documents, made_names, needs_tables, needs_vocabularies, odd_documents
from .test_minhash import brute

tokenizers = pytest.importorskip("tokenizers")
pytestmark = [needs_tables, needs_vocabularies]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d: t for d, t in rows.items() if any(c.isalpha() for c in t)}
    stage = dict(corpus_pipeline.STAGES)

    got = stage["language_id"](spark, docs, SF)
    assert got.columns == columns and {r["doc_id"]: r["text"] for r in got.collect()} == want

    last = defaultdict(int)
    for d, t in want.items():
        last[t] = max(last[t], d)
    want = {d: t for t, d in last.items()}
    got = stage["exact_dedup"](spark, got, SF)
    assert got.columns == columns and {r["doc_id"]: r["text"] for r in got.collect()} == want

    component = brute(list(want.items()), 5, 80)
    want = {d: t for d, t in want.items() if component[d][1] == d}
    got = stage["near_dedup"](spark, got, SF)
    assert got.columns == columns and {r["doc_id"]: r["text"] for r in got.collect()} == want

    want = {d: pii.redacted(t) for d, t in want.items()}
    got = stage["pii"](spark, got, SF)
    assert got.columns == columns and {r["doc_id"]: r["text"] for r in got.collect()} == want

    packed = corpus_pipeline.run(spark, SF).collect()
    tokens = defaultdict(int)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    from millrace.llm.bpe import vocabulary

    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert dict(tokens) == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}


def test_every_stage_takes_odd_and_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_documents(spark), SF).count() == 0
        assert stage(spark, odd_documents(spark), SF).count() >= 0


@pytest.mark.parametrize("upper", [False, True])
def test_every_stage_but_the_last_returns_columns_of_any_name(spark, upper):
    docs = clashing_documents(spark, upper)
    assert len(made_names()) > 100
    want = docs.select("doc_id", "text").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert 0 < len(rows) <= docs.count()
        for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")):
            assert {r[docs.columns.index(c)] for r in rows} == {i}, (name, c)
    assert want > 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= want
