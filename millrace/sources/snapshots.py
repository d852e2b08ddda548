"""Published snapshots: reading, classifying, parsing; the deep watchlist; posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.values import present

from .schema import DEEP_WATCHLIST, PAYLOAD

# Messages of the outcomes.
MESSAGES = {
    "timeout": "That took too long. Try again.",
    "unreachable": "Couldn't reach the brief. Check your connection.",
    "not_published": "No brief has been published yet. The first one arrives after tomorrow morning's run.",
    "unreadable": "The published brief was unreadable. Your last one is unchanged.",
}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, modified``: one row per landed file."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def payload_status(text: Column) -> Column:
    """``ok``, ``not_published`` (no brief, or a false one) or ``unreadable`` (no JSON, or no
    array of candidates), in the reader's order of checks."""
    payload = F.try_parse_json(text)
    brief = F.try_variant_get(payload, "$.brief", "variant")
    kind = F.schema_of_variant(brief)
    plain = F.try_variant_get(payload, "$.brief", "string")
    number = F.try_variant_get(payload, "$.brief", "double")
    false = (kind == "VOID") | ((kind == "STRING") & (plain == "")) | ((kind == "BOOLEAN") & (plain == "false")) | (kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (number == 0))
    candidates = F.schema_of_variant(F.try_variant_get(brief, "$.candidates", "variant"))
    status = F.when(payload.isNull(), "unreadable").when(F.schema_of_variant(payload) == "VOID", "not_published").when(brief.isNull() | F.coalesce(false, F.lit(False)), "not_published")
    return status.when(F.coalesce(candidates.startswith("ARRAY"), F.lit(False)), "ok").otherwise("unreadable")


def response_status(outcome: Column, http: Column, text: Column) -> Column:
    """Of a fetch: ``outcome`` is ``timeout``, ``error`` or ``response``; ``http`` its code."""
    return (
        F.when(outcome == "timeout", "timeout")
        .when(outcome == "error", "unreachable")
        .when(http == 404, "not_published")
        .when(~http.between(200, 299), "http_error")
        .otherwise(payload_status(text))
    )


def with_status(rows: DataFrame, outcome: Column, http: Column) -> DataFrame:
    """``status, message, code`` beside the columns of ``rows`` (``value``: the text). The status is a
    column before the others read it, so the text is parsed once."""
    rows = rows.withColumn("status", response_status(outcome, http, F.col("value")))
    return rows.withColumns({"message": status_message(F.col("status"), http), "code": status_code(F.col("status"), http)})


def status_message(status: Column, http: Column) -> Column:
    out = F.when(status == "http_error", F.concat(F.lit("Couldn't load the brief (HTTP "), http.cast("string"), F.lit(").")))
    for name, message in MESSAGES.items():
        out = out.when(status == name, F.lit(message))
    return out


def status_code(status: Column, http: Column) -> Column:
    return F.when(status == "not_published", F.lit(404)).when(status == "http_error", http).when(status != "ok", F.lit(0))


def epoch_ms(generated_at: Column, now: Column) -> Column:
    """When the snapshot was generated; now, where that can't be read."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(generated_at), now))


def parsed(payloads: DataFrame, now: Column) -> DataFrame:
    """``status, brief, generated_at_ms`` beside the columns of ``payloads`` (``value``: its text).
    The brief is null unless the status is ok."""
    typed = payloads.withColumn("status", payload_status(F.col("value"))).withColumn("_p", F.from_json("value", PAYLOAD))
    ok = F.col("status") == "ok"
    return typed.withColumns({"brief": F.when(ok, F.col("_p.brief")), "generated_at_ms": F.when(ok, epoch_ms(F.col("_p.generatedAt"), now))}).drop("_p")


def deep_watchlist(texts: DataFrame, by: str | None = None) -> DataFrame:
    """``pos, ticker`` of the list in ``value``; with ``by``, of each row's list."""
    rows = texts.withColumn("_list", F.from_json("value", DEEP_WATCHLIST))
    return rows.select(*([by] if by else []), F.posexplode("_list.tickers").alias("pos", "ticker"))


def read_deep_watchlist(spark: SparkSession, path: str) -> DataFrame:
    return deep_watchlist(spark.read.text(path, wholetext=True))


def _front(text: Column, name: str) -> Column:
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    found = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.regexp_replace(found, r"""^["'](.*)["']$""", "$1")


def posts(texts: DataFrame) -> DataFrame:
    """``title, date, url, body, excerpt_source`` from ``value`` (a Markdown file with front matter)
    and ``file``, named year-month-day-slug."""
    name = F.regexp_extract("file", r"([^/]+)\.(?:md|markdown)$", 1)
    dated = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})-", 1)
    date = F.coalesce(F.try_to_date(F.substring(_front(F.col("value"), "date"), 1, 10)), F.try_to_date(dated))
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""), r"\A\s+|\s+\z", "")
    slug = F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}-", "")
    return texts.select(
        _front(F.col("value"), "title").alias("title"), date.alias("date"),
        F.concat(F.lit("/blog/"), F.date_format(date, "yyyy/MM/dd"), F.lit("/"), slug, F.lit("/")).alias("url"),
        body.alias("body"), F.element_at(F.split(body, r"\r?\n[ \t]*\r?\n"), 1).alias("excerpt_source"),
    ).where(present(F.col("title")) | F.col("date").isNotNull())


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return posts(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")))
