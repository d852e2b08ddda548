"""Small tables with every odd case: nulls in each column, empty and long texts, ties, repeated
rows, and columns whose names clash with those that the operators make."""

import os
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import common

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
needs_vocabularies = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabularies here")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string, id long, row string, size long, n long, _salt int, score string, clean string, sig string, component_id long"
LONG = " ".join(f"word{i % 997} thing{i % 13}" for i in range(20_000))
TEXTS = [
    (1, "the cat sat on the mat and looked at the dog"),
    (2, "the cat sat on the mat and looked at the dog"),
    (3, "The cat sat on the mat and looked at the dog"),
    (4, ""),
    (5, None),
    (6, "   \n\t "),
    (7, "12345 !!! 678"),
    (8, LONG),
    (9, LONG),
    (9, LONG),
    (10, LONG + " tail"),
    (None, "a text without an id"),
    (None, None),
    (11, "le chat est sur la table avec le chien"),
    (12, "a"),
    (15, "½ ² 3"),
    (13, "mail bob@example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.255"),
    (14, "don't STOP ÀÉß ﬁ İstanbul ΣΑΣ <|endoftext|> 中文 😀 \x1c end"),
    (14, "don't STOP ÀÉß ﬁ İstanbul ΣΑΣ <|endoftext|> 中文 😀 \x1c end"),
]


def odd_documents(spark):
    rows = [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if i % 5 == 0 else len(t or ""), "d", None, i, "r", i, i, i, "s", "c", "g", i) for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def made_names():
    """Every name that the modules give a column."""
    folder = pathlib.Path(common.__file__).parent
    text = "\n".join(p.read_text() for p in folder.glob("*.py"))
    found = re.findall(r"""(?:alias|withColumn|withColumnRenamed)\(f?"(\w+)\"""", text) + re.findall(r"\b(\w+) (?:long|string|int|binary|double|array<)", text)
    return sorted({n.lower() for n in [*found, "a.b", "row", "_id", "_sha", "_own_sha", "_gone", "key", "_"]} - {"doc_id", "text", "n_chars"})


def clashing_documents(spark, upper):
    """The odd rows with every name that an operator could use for itself, in either case."""
    names = [n.upper() if upper else n for n in made_names()]
    rows = odd_documents(spark).select("doc_id", "text", "n_chars")
    return rows.select(*[F.lit(i).alias(n) for i, n in enumerate(names)], "*")
