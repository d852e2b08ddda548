"""Language identification by Viterbi over per-word scores.

A model holds, for each learned language, the logarithm of how often hashed letter trigrams
(with word borders) occur in it, relative to the best language, and the scripts it is
written in. A word's script, from its code point range, narrows the candidates; the others
get a floor. A word's score for a language is the sum over its trigrams. Viterbi with a
penalty for each switch labels every word; runs of one label are the spans. A text's
language is the one with most letters in its spans.

The path is exact for texts of any length: words are cut into blocks whose (max, +) transfer
matrices are computed for all texts at once, a pass over block borders fixes the states
there, and a second pass over the blocks fills in the path.

Training takes ``SAMPLE`` texts of each language (all where it has fewer), those with the least
hashes of doc_id and text, from rows that are not held out; counts are gathered as numbers per bucket, never
texts, so the model has ``BUCKETS`` numbers for each language.

Results for odd input: a null text and one without a letter are ``und`` with score 0; a text
without a word in a script that a learned language is written in has score 0 too, as nothing
speaks for the language it is given; rows
with a null doc_id are not learned from and are scored like others; without any row to learn
from all is ``und``; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import columns_of, documents, least_hashed, row_of

SAMPLE, BUCKETS, SMOOTH, FLOOR, SWITCH, BLOCK = 3000, 1 << 16, 0.02, -5.0, 12.0, 32
#: Bytes of text labelled at once.
AT_ONCE = 1 << 20
#: Texts without a higher score are rejected by ``sure_language``; `und` always is.
SURE = 0.0
WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges (Unicode blocks); a code point belongs to
# the last entry that does not exceed it.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Japanese"), (0x3100, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
)
_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_INDEX = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def script(char: str) -> str:
    return SCRIPTS[max(0, bisect_right(_STARTS, ord(char)) - 1)][1]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), at most 0
    scripts: np.ndarray  # (script names, languages), whether a language is written in it


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams centred on a letter, where each word begins among them, and
    the words' first code points."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    letter = codes[1:-1] != 10
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    return bucket[letter], begin, codes[1:-1][letter][begin]


def _scripts_of(first: np.ndarray) -> np.ndarray:
    return _INDEX[np.maximum(0, np.searchsorted(_STARTS, first, side="right") - 1)]


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """(words, languages), the best of each word 0."""
    bucket, begin, first = _hashed(words)
    s = np.add.reduceat(model.weights[bucket], begin, axis=0)
    can = model.scripts[_scripts_of(first)]
    s = np.where(can | ~can.any(axis=1, keepdims=True), s, 4 * FLOOR)
    s[~can.any(axis=1)] = 0  # no learned language has this script
    return s - s.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word of all texts; ``lengths``: each text's words, not 0."""
    langs, blocks = scores.shape[1], -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(scores)) + np.repeat(first * BLOCK - begin, lengths)
    x = np.zeros((int(blocks.sum()) * BLOCK, langs), np.float32)  # padding costs nothing
    x[place] = scores
    x = x.reshape(-1, BLOCK, langs)
    enter = np.float32(switch) * (np.eye(langs, dtype=np.float32) - 1)
    m = enter + x[:, 0, None, :]
    for t in range(1, BLOCK):
        m = np.maximum(m, m.max(axis=2, keepdims=True) - switch) + x[:, t, None, :]
    # states at block borders, text by text in step
    order = np.argsort(-blocks, kind="stable")
    depth = blocks[order]
    live = [int(np.searchsorted(-depth, -k, side="left")) for k in range(int(depth[0]) if len(depth) else 0)]
    back = np.zeros((len(x), langs), np.int8 if langs < 128 else np.int32)
    v = np.zeros((len(order), langs), np.float32)
    for k, n in enumerate(live):
        at = first[order[:n]] + k
        through = v[:n, :, None] + m[at]
        back[at] = through.argmax(axis=1)
        v[:n] = through.max(axis=1)
    last, came = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    state = v.argmax(axis=1)
    for k in range(len(live) - 1, -1, -1):
        n = live[k]
        at = first[order[:n]] + k
        last[at] = state[:n]
        state[:n] = back[at, state[:n]]
        came[at] = state[:n]
    v = enter[came] + x[:, 0]
    moved, source = np.zeros((BLOCK, len(x), langs), bool), np.zeros((BLOCK, len(x)), np.int64)
    for t in range(1, BLOCK):
        source[t] = v.argmax(axis=1)
        best = v.max(axis=1, keepdims=True) - np.float32(switch)
        moved[t] = v < best
        v = np.maximum(v, best) + x[:, t]
    path, rows = np.zeros((len(x), BLOCK), np.int64), np.arange(len(x))
    for t in range(BLOCK - 1, -1, -1):
        path[:, t] = last
        last = np.where(moved[t, rows, last], source[t], last)
    return path.reshape(-1)[place]


def _lettered(word: str) -> bool:
    return any(map(str.isalpha, word))


def label(texts: list[str], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Each text's language, its score, and spans ``first word, words, language``."""
    out: list = [("und", 0.0, [])] * len(texts)
    words = [WORD.findall(t.lower()) for t in texts]
    some = [k for k, w in enumerate(words) if model.languages and any(map(_lettered, w))]  # not only ½ and the like
    if not some:
        return out
    numbered = pa.array([w for k in some for w in words[k]], pa.large_string()).dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    table, number = word_scores(distinct, model), numbered.indices.to_numpy()
    scores = table[number]
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))[number]
    lengths = np.array([len(words[k]) for k in some])
    path = viterbi(scores, lengths, switch)
    begin, end = np.cumsum(lengths) - lengths, np.cumsum(lengths)
    letters = np.zeros((len(some), len(model.languages)))
    np.add.at(letters, (np.repeat(np.arange(len(some)), lengths), path), size)
    top = letters.argmax(axis=1)
    total = np.add.reduceat(scores.astype(np.float64), begin, axis=0)
    # how much better the language explains the text than the next one, for at most eight words
    gap = total[np.arange(len(some)), top][:, None] - total
    gap[np.arange(len(some)), top] = np.inf
    sure = 1 / (1 + np.exp(-np.clip(gap.min(axis=1) * np.minimum(1, 8 / lengths), -30, 30))) if len(model.languages) > 1 else np.ones(len(some))
    share = letters[np.arange(len(some)), top] / letters.sum(axis=1)
    written_in = model.scripts.any(axis=1)[_scripts_of(np.fromiter((ord(w[0]) for w in distinct), np.int64, len(distinct)))]
    lettered = np.fromiter(map(_lettered, distinct), bool, len(distinct))
    evidence = np.logical_or.reduceat((written_in & lettered)[number], begin)
    cut = np.flatnonzero(np.diff(path)) + 1
    for i, k in enumerate(some):
        starts = [begin[i], *cut[np.searchsorted(cut, begin[i], side="right") : np.searchsorted(cut, end[i], side="left")], end[i]]
        spans = [(int(a - begin[i]), int(b - a), model.languages[path[a]]) for a, b in zip(starts, starts[1:])]
        out[k] = (model.languages[top[i]], float(sure[i] * share[i] * evidence[i]), spans)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of rows that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    languages = [lang for lang, _ in found]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    taken = least_hashed(rows, "lang", dict(found), sample, ["doc_id", "text"], "language-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                if words:
                    bucket, _, first = _hashed(words)
                    a, b = held.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                    a += np.bincount(bucket, minlength=BUCKETS)
                    b += np.bincount(_scripts_of(first), minlength=len(SCRIPT_NAMES))
        for lang, (a, b) in held.items():
            both = np.concatenate([a, b])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(both[at])], names=["lang", "at", "n"])

    gathered = taken.select("lang", "text").mapInArrow(counts, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    n[gathered["at"].to_numpy(), [languages.index(x) for x in gathered["lang"]]] = gathered["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    share = grams / np.maximum(1, grams.sum(axis=0))
    overall = (grams.sum(axis=1, keepdims=True) + 1) / (grams.sum() + BUCKETS)
    w = np.log(share + SMOOTH * overall)
    w = np.maximum(w - w.max(axis=1, keepdims=True), FLOOR)
    return Model(languages, w.astype(np.float32), scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0)))


def identified(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` and, if asked for, ``spans`` (first word, words, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = "lang_pred string, score double" + ", spans array<struct<first:int,words:int,lang:string>>" * spans
    return map_texts(texts, lambda t: [r if spans else r[:2] for r in label(t, shared.value)], schema, most=AT_ONCE)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def sure_language(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is found with a score above ``sure``."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(row_of(docs, "text"), F.col("text").cast("string").alias("text"))
    scored = map_texts(packed, lambda t: [r[:2] for r in label(t, shared.value)], "lang_pred string, score double", keep=True, most=AT_ONCE)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") > sure)).select(*columns_of(docs, text=F.col("text")))
