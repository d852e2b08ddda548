"""The queries of this package and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dedup, exact_dedup, langid, minhash, packing, pii, sharding, token_counts, toxicity
from .common import documents


def sharding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any sharding by the law ``bytes`` fulfils: one row of totals and broken rules."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = sharding.sharded(docs)
    groups = docs.select(F.coalesce("text", F.lit("")).alias("t")).groupBy("t").agg(F.sum(F.octet_length("t") + sharding.ROW_BYTES).alias("b")).agg(F.max("b").alias("largest"))
    shards = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("slots"))
    shards = shards.agg(
        F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"),
        F.count_if((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("slots") != F.col("n"))).alias("shards_with_gaps"), F.max("bytes").alias("most"), F.min("bytes").alias("least"),
    )
    split = found.join(docs, "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.countDistinct("shard").alias("c")).agg(F.count_if(F.col("c") > 1).alias("split_texts"))
    rows = shards.unionByName(split, allowMissingColumns=True).unionByName(groups, allowMissingColumns=True)  # one row each
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns]).select("documents", "bytes", "shards", "shards_with_gaps", "split_texts", (F.col("most") - F.col("least") <= F.col("largest")).alias("balanced"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def token_count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text, and whether its tokens are as many as these allow: the longest has 128."""
    n, size = F.col("n_tokens"), F.col("n_bytes")
    rows = token_counts.op10_token_counts(spark, sf_dir)
    return rows.select("doc_id", "n_bytes", ((n <= size) & (128 * n >= size) & (F.col("over_limit") == (n > token_counts.LIMIT))).alias("possible"))


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(len({d})), lambda i: CAST({d}[len({d}) - i] AS INT) * (1 + i % 2) - CASE WHEN CAST({d}[len({d}) - i] AS INT) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0".format(d=_DIGITS)
PII_ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
       len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
           lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0)) AS n_ip,
       len(list_filter(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
       len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: len({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone
FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_sharding": sharding.op3_sharding,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_minhash": minhash.op5_minhash,
        "op6_packing": packing.op6_packing,
        "op7_bpe_codec": bpe_codec.op7_bpe_codec,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_pii": pii.op9_pii,
        "op10_token_counts": token_counts.op10_token_counts,
        # parts of the results that SQL can state
        "sharding_totals": sharding_totals,
        "pii_base_counts": pii_base_counts,
        "token_count_bounds": token_count_bounds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embedding_dedup": embedding_dedup.ORACLE,
        "op5_minhash": minhash.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "sharding_totals": "SELECT count(*) AS documents, sum(strlen(coalesce(text, '')) + 8) AS bytes, least(24, count(DISTINCT coalesce(text, ''))) AS shards, 0 AS shards_with_gaps, 0 AS split_texts, true AS balanced FROM documents",
        "pii_base_counts": PII_ORACLE,
        "token_count_bounds": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, true AS possible FROM documents",
    }
