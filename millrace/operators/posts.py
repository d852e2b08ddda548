"""The list of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import long_date, present, strip_html, truncate_words

EXCERPT_WORDS = 30


def cards(posts: DataFrame) -> DataFrame:
    """``title, url, date_text, excerpt``, newest first; no rows where there are no posts."""
    excerpt = F.when(present(F.col("excerpt_source")), truncate_words(strip_html(F.col("excerpt_source")), EXCERPT_WORDS))
    return posts.orderBy(F.col("date").desc(), F.col("url").desc()).select("title", "url", long_date(F.col("date")).alias("date_text"), excerpt.alias("excerpt"))
