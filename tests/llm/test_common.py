import random

from pyspark.sql import functions as F

from millrace.llm.common import connected_components, drop, gapless_rank, memory_bytes, setting, shared_dir, sized, written


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(200, i) for i in range(201, 260)] + [(201, 200)]
    loose = [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    edges = chain + star + loose + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0


def test_ranks_have_no_gaps_and_hot_keys_are_spread(spark):
    df = written(spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k")), "t")
    rows = gapless_rank(df, ["k"], [F.col("id")], F.xxhash64("id"), "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r["k"], []).append(r["rank"])
    assert len(rows) == 5000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_scratch_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(3), "x")
    assert all(shared_dir(spark) in f for f in df.inputFiles())


def test_dropping_deletes_written_tables_only(spark, tmp_path):
    import os

    table = written(spark.range(3).withColumn("_scratch_path", F.lit("x")), "x")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    own = spark.createDataFrame([(str(tmp_path),)], "_scratch_path string")
    drop(table, own, None)
    assert not os.path.exists(folder) and tmp_path.exists()


def test_broadcast_sides_are_measured(spark):
    """The estimate is above the size of the hash table that Spark reports."""
    wide = written(spark.range(20_000).select(F.col("id").alias("_k"), F.concat(F.lit("x" * 50), "id").alias("s"), F.array("id", "id").alias("a")), "side")
    assert 20_000 * 70 < memory_bytes(wide) < 20_000 * 600
    assert memory_bytes(wide.limit(0)) == 0
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    join = lambda side: spark.range(10).join(side, F.col("id") == F.col("_k"))
    assert "broadcast" in plan(join(sized(wide))) and "broadcast" not in plan(join(sized(wide, limit=1 << 20)))


def test_settings_of_several_threads(spark):
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key, None)
    one, two = setting(spark, key, "false"), setting(spark, key, "false")
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(key) == "false"
    two.__exit__(None, None, None)
    assert spark.conf.get(key, None) == before
