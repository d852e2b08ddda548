"""BPE encoding and decoding of whole texts (see ``bpe``).

Results for odd input: a null text counts as empty and gives no tokens, an id stays null if
it is null, repeated rows are encoded each, an empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_texts
from .bpe import vocabulary, word_bpe
from .common import documents

VOCABULARY = "word_bpe_49k.json"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded``."""

    def setup():
        bpe = word_bpe(path)
        return lambda texts: [(ids.tolist(), bpe.joined(ids).decode("utf-8")) for ids in bpe.encode_batch(texts)]

    return map_texts(_texts(docs), None, "ids array<int>, decoded string", setup=setup)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` without carrying the ids."""

    def setup():
        bpe = word_bpe(path)

        def row(ids: np.ndarray) -> tuple:
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.joined(ids)).hexdigest()

        return lambda texts: list(map(row, bpe.encode_batch(texts)))

    return map_texts(_texts(docs), None, "n_tokens long, ids_sha256 string, decoded_sha256 string", setup=setup)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary(VOCABULARY))
