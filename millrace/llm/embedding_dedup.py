"""Near-duplicate vectors by random-hyperplane sign hashing.

Vectors with one label are compared. Equal vectors are one entry with a multiplicity. Each
table hashes a vector to the signs of some random projections; vectors in one bucket (label,
table, signs) are compared exactly, in double precision. The number of signs follows the
logarithm of the label's entries, so a bucket holds some ``BUCKET`` unrelated vectors at any
size, and the number of tables follows from the signs: as many as leave a pair at the threshold
unmet with a probability of ``MISS`` at most; closer pairs are missed less often. At 0.93 a pair
agrees in one sign with probability 0.88, so signs that grow with log2 n ask for about n ** 0.18
tables, and shuffled bytes and products grow with n ** 1.18.

A large bucket holds vectors that really are close. First its entries meet a few of their own
number. Entries within half the threshold's angle of one of these are a *cluster*: any two of
them are within the whole angle, so they are linked and counted without a product. What is left
of large buckets is cut into blocks of bounded size, those of a cluster apart; a pair of blocks
that are not of one cluster is a unit of work. Its blocks are multiplied, a pair counts only in
the first table where its two vectors share a bucket, and what comes out is one row per vector
(links counted there) and a spanning forest of the links, never the pairs themselves. So a
task's output grows with the vectors and not with their square.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label or an id, link with nothing; vectors of different
lengths are never compared; rows that repeat an id and its vector are linked to each other;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, documents, sized, written

THRESHOLD, SEED = 0.93, 11
#: Unrelated vectors in a bucket, the chance of missing a pair at the threshold, and bounds of the signs.
BUCKET, MISS, LEAST_BITS, MOST_BITS = 128, 1e-4, 4, 24
#: Vectors in a block, and how many of them are multiplied at once.
BLOCK, STRIP = 2048, 512
#: Entries of a large bucket that the others meet first.
PIVOTS = 8
#: Columns that name a unit of work: what is compared, where, and the two blocks.
UNIT = ("label", "dim", "t", "s", "x", "y")


def _units(vectors: np.ndarray) -> np.ndarray:
    m = vectors.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tables_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold is unmet with a probability of ``miss`` at most."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1


def bits_for(n: Column) -> Column:
    """Signs for a label with n entries."""
    return F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), F.round(F.log2(n / F.lit(BUCKET))).cast("int")))


@lru_cache(maxsize=8)
def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def sign_hashes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(vectors, tables): each table's signs as one number. The planes follow the shape alone."""
    bit = (_units(vectors) @ _planes(vectors.shape[1], tables, bits) >= 0).reshape(len(vectors), tables, bits)
    return (bit @ (1 << np.arange(bits))).astype(np.int32)


def forest(hit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of a symmetric adjacency matrix, breadth first."""
    unseen, edges = hit.any(axis=1), []
    while unseen.any():
        front = np.array([unseen.argmax()])
        unseen[front] = False
        while len(front):
            ahead = np.flatnonzero(unseen)
            step = hit[np.ix_(front, ahead)]
            reached = step.any(axis=0)
            edges.append((front[step[:, reached].argmax(axis=0)], ahead[reached]))
            front = ahead[reached]
            unseen[front] = False
    return edges


def compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit in; ``id, n, other`` out: counts (other null) and edges (n zero)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def unit(rows: pa.RecordBatch, out: list) -> None:
        dim, table = rows["dim"][0].as_py(), rows["t"][0].as_py()
        own = rows["own"].to_numpy()
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        if not len(left) or not len(right):
            return
        unit_vectors = _units(_matrix(rows["v"], dim))
        a, b = unit_vectors[left], unit_vectors[right].T
        hit = np.concatenate([a[i : i + STRIP] @ b >= threshold for i in range(0, len(a), STRIP)])
        if x == y:
            np.fill_diagonal(hit, False)
        of = rows["cluster"].to_numpy()
        if (of >= 0).any():  # linked and counted already
            hit &= (of[left][:, None] != of[right][None, :]) | (of[left] < 0)[:, None]
        if table and hit.any():
            signs = _matrix(rows["signs"], len(rows["signs"][0]))
            for t in range(table):
                hit &= signs[left, t][:, None] != signs[right, t][None, :]
        if not hit.any():
            return
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        none = np.full(len(ids), -1)
        out.append((ids[left], hit @ copies[right], none[left]))
        if x == y:
            edges, ends = forest(hit), ids[left]
        else:
            out.append((ids[right], hit.T @ copies[left], none[right]))
            n = len(left)
            square = np.zeros((n + len(right),) * 2, bool)
            square[:n, n:], square[n:, :n] = hit, hit.T
            edges, ends = forest(square), np.concatenate([ids[left], ids[right]])
        for a, b in edges:
            out.append((ends[a], np.zeros(len(a), np.int64), ends[b]))

    def made(out: list) -> pa.RecordBatch:
        ids, n, other = (np.concatenate(c) for c in zip(*out))
        keep = (n > 0) | (other >= 0)
        edge = (n == 0)[keep]
        return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(n[keep], pa.int64()), pa.array(other[keep], pa.int64(), mask=~edge)], schema=schema)

    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows - 1, bool)
        for name in UNIT:
            c = batch[name].to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        out: list = []
        for lo, hi in zip(starts, starts[1:]):
            if hi - lo > 1:
                unit(batch.slice(lo, hi - lo), out)
        carry = batch.slice(starts[-1])
        if out:
            yield made(out)
    if carry is not None and carry.num_rows > 1:
        out = []
        unit(carry, out)
        if out:
            yield made(out)


def comparable(embedding: Column) -> Column:
    """Whether a vector can link; false for null."""
    finite = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def clusters(hashed: DataFrame, large: DataFrame, threshold: float, least: float) -> DataFrame | None:
    """``id, cluster`` of entries in large buckets of the first table that are within half the
    threshold's angle of one of the bucket's pivots, a few of its entries chosen by a hash; any
    two of one cluster are linked. Clusters of fewer than ``least`` are left out."""
    first = large.where("t = 0").select("label", "dim", "s")
    if first.isEmpty():
        return None
    inside = hashed.select("id", "label", "dim", F.col("signs")[0].alias("s"), "v").join(sized(first), ["label", "dim", "s"])
    near = [F.min_by(F.struct("id", "v"), F.xxhash64("id", F.lit(r))).alias(f"p{r}") for r in range(PIVOTS)]
    pivots = inside.groupBy("label", "dim", "s").agg(*near).select("label", "dim", "s", F.array_distinct(F.array(*[f"p{r}" for r in range(PIVOTS)])).alias("pivots"))
    pivots = written(pivots, "vector-pivots")
    half = math.cos(math.acos(threshold) / 2 - 1e-9)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for row in batch.to_pylist():
                towards = _units(np.array([p["v"] for p in row["pivots"]])) @ _units(np.array([row["v"]]))[0]
                best = int(towards.argmax())
                if towards[best] >= half:
                    ids.append(row["id"])
                    found.append(row["pivots"][best]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["id", "cluster"])

    meeting = inside.join(pivots, ["label", "dim", "s"]).select("id", "v", "pivots")
    found = written(meeting.mapInArrow(met, "id long, cluster long"), "vector-near-pivots")
    many = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("cluster").alias("_c"))
    found = written(found.join(sized(written(many, "vector-many")), F.col("cluster") == F.col("_c")).drop("_c"), "vector-clusters")
    return None if found.isEmpty() else found


def similar(rows: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    can = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("v"))
    vectors = rows.where(can)
    entries = vectors.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # one id may name several vectors, so an entry has a number of its own
    entries = written(entries.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("vec_id"), "copies", "v", F.size("v").alias("dim"), "label"), "vector-entries")

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch["dim"].to_numpy(), batch["bits"].to_numpy()])
            for dim, bits in np.unique(kinds, axis=1).T.tolist():
                part = batch.filter(pa.array((kinds == [[dim], [bits]]).all(axis=0)))
                tables = tables_for(bits, threshold, miss)
                signs = sign_hashes(_matrix(part["v"], dim), tables, bits)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(signs.ravel(), pa.int32()), tables).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["id"], part["label"], part["dim"], part["copies"], part["v"], lists], names=["id", "label", "dim", "copies", "v", "signs"])

    element = entries.schema["v"].dataType.simpleString()
    schema = f"id long, label string, dim int, copies long, v {element}, signs array<int>"
    held = written(entries.groupBy("label", "dim").agg(bits_for(F.count(F.lit(1))).alias("bits")), "vector-labels")
    hashed = entries.select("id", "label", "dim", "copies", "v").join(sized(held), ["label", "dim"])
    hashed = written(hashed.select("id", "label", "dim", "copies", "v", "bits").mapInArrow(posts, schema), "vector-signs")
    place = ["label", "dim", "t", "s"]
    posted = hashed.select("id", "label", "dim", F.posexplode("signs").alias("t", "s"))
    large = written(posted.groupBy(*place).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block), "vector-large")
    cluster = clusters(hashed, large, threshold, block / PIVOTS)
    if cluster is None:
        cluster = hashed.select("id", F.lit(None).cast("long").alias("cluster")).limit(0)
    named = hashed.select("id", "label", "dim", "copies", "v", "signs", F.posexplode("signs").alias("t", "s"))
    named = named.join(sized(cluster), "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    if large.isEmpty():
        paired = named.withColumns({"own": F.lit(0), "other": F.lit(0)})
    else:
        # parts of a large bucket: each cluster with many entries there, and the rest; each has its own blocks
        big = large.drop("m").select(*[F.col(c).alias(f"_{c}") for c in place])
        here = [F.col(c) == F.col(f"_{c}") for c in place]
        parts = posted.join(sized(big), here).join(sized(cluster), "id", "left").groupBy(*big.columns, "cluster").agg(F.count(F.lit(1)).alias("m"))
        parts = parts.withColumn("cluster", F.when(F.col("m") >= block / PIVOTS, F.col("cluster"))).groupBy(*big.columns, "cluster").agg(F.sum("m").alias("m"))
        before = Window.partitionBy(*big.columns).orderBy(F.col("cluster").asc_nulls_first())
        parts = parts.withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int")).withColumn("begin", (F.sum("blocks").over(before) - F.col("blocks")).cast("int"))
        parts = parts.groupBy(*big.columns).agg(F.sum("blocks").cast("int").alias("total"), F.collect_list(F.struct("cluster", "begin", "blocks")).alias("parts"))
        parts = written(parts, "vector-blocks")
        named = named.join(sized(parts), here, "left")
        mine = F.coalesce(F.try_element_at(F.filter("parts", lambda x: x["cluster"] == F.col("cluster")), F.lit(1)), F.try_element_at(F.filter("parts", lambda x: x["cluster"].isNull()), F.lit(1)))
        begin, blocks = F.coalesce("part.begin", F.lit(0)), F.coalesce("part.blocks", F.lit(1))
        # a vector meets each block of its bucket but those of its own cluster; the two blocks name the unit
        met = F.sequence(F.lit(0), F.coalesce("total", F.lit(1)) - 1)
        met = F.when(F.col("part.cluster").isNull(), met).otherwise(F.filter(met, lambda x: (x < begin) | (x >= begin + blocks)))
        paired = named.withColumn("part", mine).withColumn("own", (begin + F.pmod(F.xxhash64("id", "t"), blocks)).cast("int")).withColumn("other", F.explode(met))
    paired = paired.select("label", "dim", "t", "s", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "copies", "cluster", "v", "signs")
    units = paired.repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = written(units.mapInArrow(lambda batches: compare(batches, threshold), "id long, n long, other long"), "vector-links")

    # what is linked by its cluster alone
    of = cluster.join(entries.select("id", "copies"), "id")
    total = written(of.groupBy("cluster").agg(F.sum("copies").alias("all")), "vector-cluster-sizes")
    close = of.join(total, "cluster").select("id", (F.col("all") - F.col("copies")).alias("n"), F.lit(None).cast("long").alias("other"))
    counts = found.unionByName(close).groupBy(F.col("id").alias("_i")).agg(F.sum("n").alias("links"))
    edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).union(cluster.select("id", "cluster"))
    names = entries.select(F.col("id").alias("_e"), F.col("vec_id").alias("_v"))
    edges = edges.join(names, F.col("a") == F.col("_e")).select(F.col("_v").alias("a"), "b").join(names, F.col("b") == F.col("_e")).select("a", F.col("_v").alias("b"))
    label = connected_components(edges)
    named = entries.join(counts, F.col("id") == F.col("_i"), "left").drop("_i")
    named = named.join(label.select(F.col("id").alias("_i"), "component"), F.col("vec_id") == F.col("_i"), "left")
    named = written(named.select(F.col("label").alias("_label"), F.col("v").alias("_vec"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec_id").alias("component")), "vector-named")
    linked = vectors.join(named, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_vec")))
    linked = linked.select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir, "embeddings"))


#: All pairs of a label; for small tables only.
ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
    SELECT vec_id, label, e FROM v WHERE list_dot_product(e, e) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
    SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), c AS (
    SELECT id, min(c) AS component_id FROM r GROUP BY id
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
"""
