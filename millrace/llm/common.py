"""What the corpus operators share: scratch tables, ranks without one big task, components.

Scratch tables go to the folder in ``spark.checkpoint.dir``, which every executor and the
driver see; a lost executor costs only the tasks it ran. They are deleted when the
application ends.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side of a join is broadcast only when it was counted and is at most so large.
BROADCAST_BYTES = 32 << 20
#: Small shuffles end in few partitions, and so few files, if parallelism doesn't come first.
BY_SIZE = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(docs: DataFrame, without: str = "") -> Column:
    """All columns of ``docs`` but ``without`` as the struct ``row``, so that none clashes with what
    an operator adds beside it."""
    return F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != without]).alias("row")


def columns_of(docs: DataFrame, **own: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, in their order; those in ``own`` from there."""
    return [own.get(c.lower(), F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


_own_dirs: dict[str, str] = {}
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset (local tests), one of our own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _file_system(spark, path)
    return fs.exists(jvm_path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the application ends."""
    root = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    if root not in _roots:
        fs, jvm_path = _file_system(spark, root)
        fs.mkdirs(jvm_path)
        fs.deleteOnExit(jvm_path)
        _roots.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_lock = threading.Lock()
_held: dict[tuple[int, str], list] = {}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for a while. Where several threads hold it at once, the last one to
    leave puts back what the first one found."""
    at = (spark._jsparkSession.hashCode(), key)
    with _lock:
        held = _held.setdefault(at, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _held[at]
                spark.conf.unset(key) if held[1] is None else spark.conf.set(key, held[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with setting(spark, BY_SIZE, "false"):
        df.write.parquet(path)
    table = spark.read.schema(_nullable(df.schema)).parquet(path)
    table._scratch_path = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        path = vars(table).get("_scratch_path") if table is not None else None
        if path:
            fs, jvm_path = _file_system(table.sparkSession, path)
            fs.delete(jvm_path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def hash_bounds(counts: dict, sample: int, times: int = 1) -> dict:
    """For each value with so many rows, the signed 64-bit hash below which the sample and six
    standard deviations more are to be expected, ``times`` that; None: take all."""
    want = times * (sample + 6 * math.isqrt(sample) + 16)
    return {value: None if n <= want else (want << 64) // n - (1 << 63) for value, n in counts.items()}


def least_hashed(rows: DataFrame, by: str, counts: dict, sample: int, hashed: list[str], name: str) -> DataFrame:
    """Of each value of ``by`` the ``sample`` rows with the least hashes of ``hashed``, all where it
    has fewer, as a written table. ``counts``: rows of each value.

    A bound on the hash, from the counts, lets through a few more; the least of those are taken
    exactly. Where the bound let through too few (rows that repeat share a hash), it
    is raised, so the sample is full for any number of rows.
    """
    h, times = F.xxhash64(*hashed), 1
    # first within a part of the rows, so that one hash that very many share is no single task
    ranks = [F.row_number().over(Window.partitionBy(by, *part).orderBy("_h")) for part in (["_part"], [])]
    while True:
        bounds = hash_bounds(counts, sample, times)
        take = F.lit(False)
        for value, bound in bounds.items():
            take |= (F.col(by) == F.lit(value)) & (F.lit(True) if bound is None else F.col("_h") < F.lit(bound))
        near = rows.withColumn("_h", h).where(take).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(256)))
        for rank in ranks:
            near = near.withColumn("_rank", rank).where(F.col("_rank") <= sample)
        table = written(near.drop("_h", "_part", "_rank"), name)
        found = {r[by]: r["n"] for r in table.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(bound is None or found.get(value, 0) >= sample for value, bound in bounds.items()):
            return table
        drop(table)
        times *= 64


def memory_bytes(table: DataFrame) -> int:
    """An upper estimate of what the rows of a table take as the hash table of a broadcast join:
    counted rows and counted bytes of texts and lists."""
    var = F.lit(0).cast("long")
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            var += F.coalesce(F.octet_length(quoted(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            var += F.greatest(F.lit(0), F.coalesce(F.size(quoted(f.name)), F.lit(0))) * 64
        elif isinstance(f.dataType, T.StructType):
            var += F.lit(64 + 16 * len(f.dataType.fields))
    n, more = table.agg(F.count(F.lit(1)), F.sum(var)).first()
    # a row and its key, each with a header and eight bytes a column, and an entry that points there
    return n * (64 + 16 * len(table.schema.fields)) + 2 * (more or 0)


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if what was counted of it fits in ``limit`` bytes;
    beyond that the join shuffles and AQE splits skewed keys."""
    return F.broadcast(table) if memory_bytes(table) <= limit else table


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, out: str, salts: int | None = None) -> DataFrame:
    """0, 1, 2 ... within ``keys``, without bringing the rows of a key into one task.

    Rows are numbered inside (keys, salt); the counts per (keys, salt) give each salt's
    start. ``salt`` must be a hash of the row that does not change when it is recomputed;
    ``keys`` must not be null. The number of salts follows the shuffle partitions, so it
    grows with the cluster. ``df`` is read twice: give a written table.
    """
    spark = df.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), "_start")
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_local", F.row_number().over(local) - 1)
    on = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        on &= F.col(k) == F.col(f"_k{i}")
    return ranked.join(starts, on).withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_salt", "_local", "_s", "_start", *[f"_k{i}" for i in range(len(keys))])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(a, b)``; component is the smallest id.

    Contraction: every vertex hooks to its smallest neighbour, pointer jumping flattens the
    trees, edges are renamed to the roots and deduplicated; what stays between different
    roots is the next round's graph. A vertex that is less than all its neighbours may wait a
    round, but then a neighbour has hooked to a smaller one and it hooks to that one's root, so
    the vertices that still have edges at least halve in two rounds. All steps are joins and aggregations over written tables; nothing reaches the
    driver but counts. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = written(pairs, "cc-edges")
    label: DataFrame | None = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p"))
        parent = written(parent, "cc-parent")
        while True:
            up = parent.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
            jumped = parent.join(up, parent["p"] == up["_i"]).select("id", F.col("_p").alias("p"), (F.col("p") != F.col("_p")).alias("moved"))
            jumped = written(jumped, "cc-jump")
            drop(parent)
            parent = jumped
            if parent.where("moved").isEmpty():
                break
        root = parent.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
        left = pairs.join(root, pairs["a"] == root["_i"]).select(F.col("_p").alias("ra"), "b")
        ends = left.join(root, left["b"] == root["_i"]).select("ra", F.col("_p").alias("rb"))
        ends = ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = written(ends, "cc-edges")
        drop(pairs)
        pairs = rest
        if label is None:
            label = parent
        else:
            merged = written(label.join(root, label["p"] == root["_i"], "left").select("id", F.coalesce("_p", "p").alias("p")), "cc-label")
            drop(label, parent)
            label = merged
    if label is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label.select("id", F.col("p").alias("component"))
