import random

from pyspark.sql import functions as F

from millrace.llm import minhash
from millrace.llm.common import written

from .data import TEXTS, empty_documents, odd_documents
from .test_common import union_find


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = union_find(edges)
    return {d: (len(s), found.get(d, d)) for d, s in sets.items()}


def check(spark, docs, k, percent):
    got = minhash.linked(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    assert len(got) == len(docs)
    want = brute(docs, k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def mutated(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_a_large_group_of_near_copies_with_stragglers_and_a_common_passage(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, mutated(base, rng, rng.choice([0, 1, 2, 3, 6, 9]))) for i in range(150)]
    docs += [(1000 + i, " ".join(passage + [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 90))])) for i in range(100)]
    docs += [(2000 + i, docs[i][1]) for i in range(40)]
    check(spark, docs, 3, 85)
    check(spark, docs, 5, 80)


def test_any_threshold(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = [(i, mutated(base, rng, rng.choice([0, 1, 2, 3, 4, 6]))) for i in range(40)]
    check(spark, docs, 3, 90)
    check(spark, docs, 3, 70)
    assert [minhash.needed(p) for p in (85, 80)] == [12, 10]
    assert all(1 <= minhash.needed(p) <= minhash.needed(p + 1) <= minhash.K for p in range(1, 100))


def test_a_value_that_all_share_is_split(spark):
    """One coordinate with one value for all documents: the join on it must not be one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB"}
    rows = spark.range(6000).select("id", F.lit(9).alias("n"), F.array(*[F.lit(0).cast("long") for _ in range(8)]).alias("odd"), F.array(F.lit(7).cast("long"), F.xxhash64("id")).alias("sig"))
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        counted = minhash.postings(written(rows.repartition(8), "reps"), 1).groupBy().count()
        assert counted.first()[0] == 6000
        counted = counted.select("count")
        counted._jdf.collectToPython()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hub_meets_its_partners_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 4)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    docs = [(0, " ".join(base))] + [(i, mutated(base, rng, 3)) for i in range(1, 60)]
    check(spark, docs, 3, 85)


def test_short_texts_and_chains(spark):
    words = [f"c{i}" for i in range(60)]
    chain = [(i, " ".join(words[i : i + 40])) for i in range(12)]
    check(spark, chain + [(100, "a b"), (101, "A  b"), (102, "a b c"), (103, "a"), (104, "b")], 3, 85)


def test_odd_rows(spark):
    got = minhash.linked(odd_documents(spark), 3, 85).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 12)] == [1, 1, 1, 4, 5, 6, 8, 8, 8, 12]
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[12]["n_shingles"] == 1
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    docs = odd_documents(spark)
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert {1, 4, 5, 6, 8, 12, None} <= {r["doc_id"] for r in kept.collect()} and not {2, 3, 9, 10} & {r["doc_id"] for r in kept.collect()}


def test_empty_table(spark):
    assert minhash.linked(empty_documents(spark), 3, 85).count() == 0
    assert minhash.without_near_copies(empty_documents(spark)).count() == 0


def test_one_id_that_names_several_texts(spark):
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    a, b, c, e = text(), text(), text(), text()
    near = {k: mutated(v, rng, 2) for k, v in zip("abce", (a, b, c, e))}
    docs = [(1, " ".join(a)), (7, near["a"]), (7, " ".join(b)), (9, near["b"]), (20, " ".join(c)), (20, near["c"]), (30, " ".join(e)), (30, None), (30, ""), (40, near["e"]), (40, near["a"])]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    brute_rows = brute([(i, t) for i, (_, t) in enumerate(docs)], 5, 80)
    want = sorted((d, brute_rows[i][0], min(docs[j][0] for j in brute_rows if brute_rows[j][1] == brute_rows[i][1])) for i, (d, _) in enumerate(docs))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.linked(rows, 5, 80).collect()) == want
    kept = [(r["doc_id"], r["text"]) for r in minhash.without_near_copies(rows).collect()]
    assert len(kept) == 6 and {(1, " ".join(a)), (7, " ".join(b)), (30, " ".join(e)), (30, None), (30, "")} <= set(kept)
    assert sum(d == 20 for d, _ in kept) == 1


def test_sketches_never_differ_more_than_the_sets(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(50))) for i in range(30)]
    rows = minhash.signatures(spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()
    sets = {d: shingles(t, 3) for d, t in docs}
    for a in rows:
        for b in rows:
            apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a["odd"], b["odd"]))
            assert apart <= len(sets[a["doc_id"]] ^ sets[b["doc_id"]])
