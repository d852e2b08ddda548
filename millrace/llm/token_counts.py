"""Token counts by overlap resynchronisation.

A text longer than ``CHUNK`` characters is encoded in chunks that overlap, with the offsets
where tokens end. Two neighbours are spliced at a common border inside their overlap that is
proven stable. There are three kinds of proof:

- a character that is not white space followed by one that is: no alternative of the
  vocabulary's pattern reads from the one into the other;
- a border that the pattern makes in both chunks: the pattern never looks back, so from a true
  border on it reads the same whatever came before;
- inside one run that the pattern doesn't cut (unspaced writing, base64, blanks): a border
  between tokens that both chunks have, if the token left of it in the one and right of it in
  the other are compatible. Tokens that are compatible with their neighbours throughout are the
  encoding, so the splice is.

Where the overlap has no such border it is widened; beyond a whole chunk the text is encoded at
once. All of this takes time in proportion to the text.

Results for odd input: a null text counts as empty (0 bytes, 0 tokens); a null id stays
null; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_texts
from .bpe import KEY, SPACE, ByteBpe, byte_bpe, vocabulary
from .common import documents

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP, LIMIT = 16_384, 256, 1024
#: A run of so many characters is no contraction, which is all that a kind's run could be mistaken for.
SURE_RUN = 16


def spaces() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


_SPACES = spaces()


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in _SPACES and text[at - 1] not in _SPACES


class Chunk:
    """A part of a text: where its pieces end, and the tokens up to there."""

    def __init__(self, text: str, begin: int, end: int, bpe: ByteBpe):
        self.text, self.begin, self.end, self.bpe = text, begin, end, bpe
        self.ends: list[int] = []
        self.tokens: list[int] = []
        self._fine: dict[int, list[tuple[str, list[int]]]] = {}
        at, n = begin, 0
        pieces = bpe.pieces(text[begin:end])
        for k, piece in enumerate(pieces):
            if len(piece) > KEY and k in (0, len(pieces) - 1):
                self._fine[k] = bpe.tokens(piece)
                n += sum(len(ids) for _, ids in self._fine[k])
            else:
                n += bpe.counts[piece]
            at += len(piece)
            self.ends.append(at)
            self.tokens.append(n)

    def fine(self, k: int) -> list[tuple[str, list[int]]]:
        """The first (0) or last (-1) piece as the pattern cuts it, each part with its ids."""
        k %= len(self.ends)
        if k not in self._fine:
            self._fine[k] = self.bpe.tokens(self.text[self.ends[k - 1] if k else self.begin : self.ends[k]])
        return self._fine[k]


def _size(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def _inside(parts: list[tuple[str, list[int]]], bpe: ByteBpe) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """By their place in bytes: borders of the pattern with the tokens before, and of the tokens in
    the last part with the tokens before and the last one's id."""
    borders, inner, at, n = {}, {}, 0, 0
    for k, (part, ids) in enumerate(parts):
        if k == len(parts) - 1:
            place = at
            for i, token in enumerate(ids):
                place += len(bpe.text[token]) if token in bpe.text else 0
                inner[place] = (n + i + 1, token)
        at += _size(part)
        n += len(ids)
        borders[at] = n
    return borders, inner


def splice(left: Chunk, right: Chunk) -> tuple[int, int] | None:
    """The tokens of ``left`` before a common stable border, and those of ``right`` before it."""
    text, bpe = left.text, left.bpe
    first = bisect_right(left.ends, right.begin)
    if first < len(left.ends) - 1:
        known = dict(zip(right.ends, right.tokens))
        for e, n in zip(left.ends[first:-1], left.tokens[first:-1]):
            if e in known and stable(text, e):
                return n, known[e]
    # no such place: the overlap lies in the last piece of the one and the first of the other
    begins = left.ends[-2] if len(left.ends) > 1 else left.begin
    if begins > right.begin:
        return None
    before = left.tokens[-2] if len(left.ends) > 1 else 0
    parts, others = left.fine(-1), right.fine(0)
    shift = _size(text[begins : right.begin])
    borders, inner = _inside(parts, bpe)
    last = parts[-1][0]
    if left.end - len(last) < right.begin:
        # one run of the pattern over the whole overlap; what it holds is of one kind, so the
        # other chunk's first part is the rest of it
        if left.end - right.begin < SURE_RUN or last in bpe.special:
            return None
        at = 0
        for i, token in enumerate(others[0][1][:-1]):
            at += len(bpe.text[token])
            n, own = inner.get(shift + at, (0, -1))
            if own >= 0 and bpe.compatible[own << 20 | others[0][1][i + 1]]:
                return before + n, i + 1
        return None
    # a special string may begin where the chunk ends, and the last border is only the chunk's own
    sure = max(map(len, bpe.special), default=0) + 1
    whole = _size(text[begins : left.end])
    theirs, _ = _inside(others, bpe)
    for at in sorted(theirs):
        if at and shift + at in borders and shift + at <= whole - sure:
            return before + borders[shift + at], theirs[at]
    return None


def count_tokens(text: str, bpe: ByteBpe, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    n = len(text)
    if n <= chunk:
        return bpe.count(text)
    left = Chunk(text, 0, chunk, bpe)
    total, skip = 0, 0  # tokens before the border last spliced at, and those of ``left`` before it
    while left.end < n:
        width = overlap
        while True:
            if width >= chunk:
                return bpe.count(text)
            right = Chunk(text, left.end - width, min(n, left.end + chunk), bpe)
            met = splice(left, right)
            if met:
                break
            width *= 2
        total += met[0] - skip
        left, skip = right, met[1]
    return total + left.tokens[-1] - skip


def counted(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def setup():
        bpe = byte_bpe(path)

        def call(texts: list[str]) -> list[tuple]:
            short = iter(bpe.count_batch([t for t in texts if len(t) <= chunk]))
            return [(next(short) if len(t) <= chunk else count_tokens(t, bpe, chunk, overlap),) for t in texts]

        return call

    return map_texts(rows, None, "n_tokens long", setup=setup).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir), vocabulary(VOCABULARY))
