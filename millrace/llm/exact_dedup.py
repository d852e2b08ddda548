"""Exact deduplication with streaming state (built-in DataFrame and streaming operators only).

A row is reduced to a fingerprint: SHA-256 of its text, a stable identifier and where its
content lies. Fingerprints stream through an aggregation keyed by the digest whose state is
kept on disk (RocksDB) without watermark or expiry. On a hit, that is a digest held by several
rows, the full bytes are compared with those of the row that stays; rows whose bytes differ are
grouped again by the bytes themselves.

With a ``folder`` the state outlives the call: a later call's rows meet the digests of all
earlier ones, and the content of an earlier row is read from the file that its locator names
(Parquet with ``doc_id`` and ``text``; a table that comes from no files is kept in the folder).
A call reports its own rows. One that outranks a row kept by an earlier call takes its place:
the state's table then names it.

Results for odd input: a null text counts as empty; of repeated rows with one doc_id one
stays, that of the earliest call; a null doc_id ranks below all others; an empty table gives an
empty result. Other columns of the input are ignored by the report and pass through
``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, documents, exists, row_of, scratch_path, sized, written

#: Disk-backed state. Without preallocation a store of few keys takes kilobytes, not megabytes,
#: so the number of state partitions costs no disk.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share so much memory
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: On a local or mounted file system the default manager runs a shell command for each file.
FILE_CONF = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256, run: int = 0) -> DataFrame:
    """``doc_id, prior, uid, digest, sha, locator``: one row per input row. ``uid`` tells repeated
    rows apart; it is fixed once the table is written. ``prior`` is higher in earlier runs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(-run).cast("long").alias("prior"),
        F.monotonically_increasing_id().alias("uid"),
        digest(text).cast("string").alias("digest"),
        sha256(text).alias("sha"),
        F.struct(F.input_file_name().alias("file"), F.octet_length(text).alias("n_bytes")).alias("locator"),
    )


class DedupState:
    """The keyed state: digest to the row that stays, its locator and the rows seen.

    ``add`` runs one streaming query over all fingerprint files that were added to
    ``source`` since the last call. ``table`` is the state after the last call.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.source = spark, folder, f"{folder}/fingerprints"

    def runs(self) -> int:
        """How many runs were added."""
        if not exists(self.spark, self.source):
            return 0
        last = self.fingerprints().agg(F.min("prior")).first()[0]
        return 0 if last is None else 1 - last

    def kept_here(self, docs: DataFrame, run: int) -> DataFrame:
        """``docs`` as files in the folder, for locators of a table that comes from no files."""
        path = f"{self.folder}/content/run={run}"
        docs.select("doc_id", "text").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def add(self, prints: DataFrame) -> None:
        prints.write.mode("append").parquet(self.source)
        # a session of its own, so that its settings disturb no other thread
        spark = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        for k, v in (STATE_CONF | (FILE_CONF if self.folder.startswith(("/", "file:")) else {})).items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(spark.read.parquet(self.source).schema).parquet(self.source)
        row = F.struct("doc_id", "prior", "uid", "locator")
        state = stream.groupBy("digest").agg(F.max(row).alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def changed(batch: DataFrame, number: int) -> None:
            batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def fingerprints(self, run: int | None = None) -> DataFrame:
        found = self.spark.read.parquet(self.source)
        return found if run is None else found.where(F.col("prior") == -run)

    def table(self) -> DataFrame:
        """``digest, keep, group_size``. A digest that several runs changed counts as its last."""
        changes = self.spark.read.parquet(f"{self.folder}/changes")
        last = changes.groupBy("digest").agg(F.max(F.struct("version", "keep", "group_size")).alias("s"))
        return last.select("digest", "s.keep", "s.group_size")


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))


def _located(located: DataFrame) -> DataFrame | None:
    """``doc_id, body`` of the files that locators name; only their names, at most as many as there
    are input files, reach the driver."""
    files = [r["file"] for r in located.select("locator.file").distinct().collect()]
    return _bodies(located.sparkSession.read.parquet(*files)) if files else None


def dedup_report(docs: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, locator, keep_here``: one row per input row.

    ``digest`` may be any function of the text, also a weak one: the byte comparison makes
    the result exact whatever it is. ``keep_here``: whether the row that stays is of this call.
    """
    spark = docs.sparkSession
    state = DedupState(spark, folder or scratch_path(spark, "dedup"))
    run = state.runs() if folder else 0
    if folder and not docs.inputFiles():
        docs = state.kept_here(docs, run)
    state.add(fingerprints(docs, digest, run))
    # the state as a table of its own, so that AQE can split a hot digest in the joins with it
    prints, table = state.fingerprints(run), written(state.table(), "dedup-state")

    hits = table.where("group_size > 1").select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.prior").alias("keep_prior"), F.col("keep.locator").alias("locator"))
    hits = written(hits, "dedup-hits")
    hit = hits.select(F.col("digest").alias("_d"), "keep_id", "keep_prior")
    texts = _bodies(docs).withColumn("digest", digest(F.col("body")).cast("string"))
    # the copies, read and hashed once; repeated bodies take little room in Parquet
    suspects = written(texts.join(sized(hit), F.col("digest") == F.col("_d")).drop("_d"), "dedup-suspects")
    stays = suspects.where((F.col("keep_prior") == -run) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", "body")
    earlier = hits.where(F.col("keep_prior") != -run)
    if run and (bodies := _located(earlier)) is not None:
        wanted = earlier.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k"))
        bodies = bodies.join(sized(wanted), F.col("doc_id").eqNullSafe(F.col("_k")))
        stays = stays.unionByName(bodies.withColumn("digest", digest(F.col("body")).cast("string")).where("digest = _d").select("digest", "body"))
    stays = stays.groupBy(F.col("digest").alias("_d")).agg(F.max("body").alias("kept_body"))
    stays = written(stays, "dedup-stays")  # a table of its own, so that AQE can split a hot digest in the join
    differs = suspects.select("digest", "body").join(stays, F.col("digest") == F.col("_d")).where("body <> kept_body").select("digest")
    # an aggregation right above the join would keep AQE from splitting it
    differs = written(differs, "dedup-differs").distinct()

    if differs.isEmpty():
        groups = table.select(F.col("digest").alias("_d"), "keep", "group_size")
        joined = prints.join(groups, F.col("digest") == F.col("_d"))
    else:
        joined = _by_bytes(state.fingerprints(), texts, digest, differs, table, run).where(F.col("prior") == -run)
    own = [F.col("keep.doc_id").eqNullSafe(F.col("doc_id")), F.col("keep.prior") == F.col("prior"), F.col("keep.uid") == F.col("uid")]
    return joined.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (own[0] & own[1] & own[2]).alias("kept"),
        F.col("sha").alias("text_sha256"), "locator", own[1].alias("keep_here"),
    )


def _by_bytes(prints: DataFrame, texts: DataFrame, digest: Callable[[Column], Column], differs: DataFrame, table: DataFrame, run: int) -> DataFrame:
    """Groups where some digest is shared by different bytes: those are split by the bytes, the
    others stay as the state has them. Partial aggregation meets repeated bytes map-side."""
    bad = differs.select(F.col("digest").alias("_b"))
    clean = table.join(bad, F.col("digest") == F.col("_b"), "left_anti").select(F.col("digest").alias("_d"), "keep", "group_size")
    fine = prints.where(F.col("prior") == -run).join(clean, F.col("digest") == F.col("_d")).drop("_d")
    doubtful = prints.join(bad, F.col("digest") == F.col("_b"), "left_semi")
    if run and (earlier := _located(doubtful.where(F.col("prior") != -run))) is not None:
        texts = texts.unionByName(earlier.withColumn("digest", digest(F.col("body")).cast("string")))
    split = texts.join(bad, F.col("digest") == F.col("_b")).select("doc_id", "digest", "body").withColumn("bsha", sha256(F.col("body"))).distinct()
    rows = doubtful.alias("p").join(split.alias("s"), F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.digest") == F.col("s.digest")) & (F.col("p.sha") == F.col("s.bsha"))).select("p.*", "s.body")
    groups = rows.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "prior", "uid", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("digest").alias("_d"), F.col("body").alias("_t"), "keep", "group_size")
    regrouped = rows.join(groups, (F.col("digest") == F.col("_d")) & (F.col("body") == F.col("_t"))).drop("_d", "_t", "body")
    return fine.unionByName(regrouped)


def deduplicated(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each text; with a
    ``folder``, of those only that no earlier call has kept, unless their ids are larger.

    Only the dropped ids are joined to the texts. Rows that repeat both doc_id and text can't
    be told apart by them, so where such rows exist one more aggregation picks one.
    """
    report = dedup_report(docs.select("doc_id", "text"), folder=folder).select("doc_id", "keep_id", "kept", "text_sha256", "keep_here")
    report = written(report, "dedup-report")
    twin = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("keep_here")
    dropped = report.where(~F.col("kept") & ~twin).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
    dropped = written(dropped.distinct(), "dedup-dropped")
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), sha256(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sha"))
    rows = rows.join(sized(dropped), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    if not report.where(~F.col("kept") & twin).isEmpty():
        rows = rows.dropDuplicates(["sha"])
    return rows.select(*columns_of(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
