"""Personal data: expressions propose spans, checksums confirm them, context moves the score.

Kinds: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits, Luhn), ``phone``
(9 to 15 digits after a plus), ``iban`` (mod 97) and ``ssn`` (three, two and four digits with
valid parts, only where a context word stands near). An account number ends at its country's
length. A kind's matches are the leftmost
non-overlapping ones; a match that its check refuses is dropped and not retried inside.

All kinds but email consist of digits and ``( ) . + -`` and blanks, so one pass finds maximal
runs of these and the expressions work inside a run; an address is looked for around each
``@``. Both are linear in the text.

Results for odd input: a null text counts as empty and has no spans; a null id stays null;
repeated rows are searched each; an empty table gives an empty result. Offsets are code
points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import each, map_texts
from .common import columns_of, documents, row_of

# The contract's expressions and limits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
#: Characters of an account number, by length: the registry's countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BF CM DJ FR GR IT MC MG MR SM", 28: "AL AZ BY CY DO GT HN HU LB NE PL SN SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC NI", 33: "RU",
}
IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
RUN = re.compile(r"[0-9+][0-9 ().+-]*")
#: Whole words near a span that speak for its kind, and how far near is.
CONTEXT = {
    "email": "mail email emails contact write",
    "ip": "ip host server address",
    "card": "card cards visa mastercard credit payment",
    "phone": "phone telephone call tel mobile cell fax",
    "iban": "iban account bank",
    "ssn": "ssn social security",
}
CONTEXT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
LETTERS = re.compile(r"[^\W\d_]+")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
NEAR, CONTEXT_GAIN, THRESHOLD = 40, 0.3, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def iban_end(text: str, begin: int) -> int:
    """Where the account number ends that begins there, of its country's length, single blanks
    between; -1 if there is none."""
    left = IBAN_LENGTH.get(text[begin : begin + 2], 0)
    if not left or not IBAN_HEAD.match(text, begin):
        return -1
    at, plain = begin, []
    while left and at < len(text):
        c = text[at]
        if "0" <= c <= "9" or "A" <= c <= "Z":
            plain.append(c)
            left -= 1
        elif c != " " or text[at - 1] == " ":
            return -1
        at += 1
    ends = at == len(text) or not (text[at].isascii() and text[at].isalnum())
    return at if not left and ends and mod97("".join(plain)) else -1


def near_words(text: str, begin: int, end: int) -> set[str]:
    """The whole words within ``NEAR`` characters of a span."""
    low, high = max(0, begin - NEAR), min(len(text), end + NEAR)
    before = [m[0] for m in LETTERS.finditer(text, low, begin) if m.start() > low or not low or not text[low - 1].isalpha()]
    behind = [m[0] for m in LETTERS.finditer(text, end, high) if m.end() < high or high == len(text) or not text[high].isalpha()]
    return {w.lower() for w in (*before, *behind)}


def small(part: str) -> bool:
    """Whether a part of an address is at most 255, leading zeros aside."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """``kind, start, end, score`` by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    for run in RUN.finditer(text):
        begin, end = run.span()
        if end - begin < 7:
            if not (begin >= 2 and text[begin - 1].isupper() and text[begin - 2].isupper()):
                continue
        for m in IP.finditer(text, begin, end):
            if all(map(small, m[0].split("."))):
                found["ip"].append(m.span())
        for m in CARD.finditer(text, begin, end):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found["card"].append(m.span())
        for m in PHONE.finditer(text, begin, end):
            if 9 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
        found["ssn"] += [m.span() for m in SSN.finditer(text, begin, end)]
        if begin >= 2 and "A" <= text[begin - 1] <= "Z" and "A" <= text[begin - 2] <= "Z":
            close = iban_end(text, begin - 2)
            if close >= 0 and (not found["iban"] or found["iban"][-1][1] <= begin - 2):
                found["iban"].append((begin - 2, close))
    out = []
    for kind in KINDS:
        for begin, end in found[kind]:
            score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(CONTEXT[kind] & near_words(text, begin, end)))
            if kind in BASE or score >= THRESHOLD:
                out.append((kind, begin, end, score))
    return out


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping ones by the first."""
    parts, at = [], 0
    for kind, begin, end, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if begin >= at:
            parts += [text[at:begin], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*parts, text[at:]]) if parts else text


def _row(text: str) -> tuple:
    all_spans = spans(text)
    counts = [sum(s[0] == k for s in all_spans) for k in BASE]
    listed = [f"{k}:{b}:{e}" for k, b, e, _ in all_spans]
    base = ",".join(listed[: sum(counts)])
    return *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(listed), ",".join(f"{s:.2f}" for _, _, _, s in all_spans)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end, score``: a row per span."""
    return map_texts(_texts(docs), each(spans), "kind string, start long, end long, score double", many=True)


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and digest of the base spans, all ``spans`` and their ``scores``, in step."""
    return map_texts(_texts(docs), each(_row), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its spans replaced in ``text``; other columns and clean texts as they were
    (a null text stays null). ``n_chars``, where it exists, follows the new text."""
    packed = docs.select(row_of(docs, "text"), F.col("text").isNull().alias("was_null"), F.col("text").cast("string").alias("text"))
    out = map_texts(packed, each(lambda t: (redacted(t),)), "clean string")
    own = {"text": F.when(~F.col("was_null"), F.col("clean"))}
    at = next((i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"), None)
    if at is not None:
        own["n_chars"] = F.when(F.col("was_null"), F.col(f"row.c{at}")).otherwise(F.length("clean").cast(docs.schema[at].dataType))
    return out.select(*columns_of(docs, **own))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(documents(spark, sf_dir))
