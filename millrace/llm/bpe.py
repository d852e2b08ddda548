"""Byte-pair encoding by backtracking, and decoding by an offset table.

A sequence of tokens is the merge result of its bytes exactly if each token is what its own
bytes merge to and each neighbouring pair is compatible, that is, no merge crosses their
border before both are complete. So the encoder takes the longest token match an
Aho-Corasick automaton finds, keeps it if it is compatible with the token before, else tries
the next shorter match, else steps back; a position that failed once is never tried again,
which bounds the work by the length.

``WordBpe`` is the encoding of a word-level vocabulary (lower case, word ends), ``ByteBpe``
that of a byte-level one. Both cut a text at white space, where no token crosses, and keep
what they found for recent pieces in a bounded cache.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

INF = 1 << 60
#: White space as the tokenizers' patterns have it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a piece cache before the older half goes, and characters of the longest key that
#: is kept: unspaced texts come as one piece, and together these bound what a cache holds.
CACHE, KEY = 250_000, 64
#: Stands for the word-end suffix inside this module.
END = "\0"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_BYTES = {b: c for b, c in enumerate(byte_chars())}


def as_symbols(text: str) -> str:
    if text.isascii() and (text.isalpha() or (text.isprintable() and " " not in text)):
        return text
    return text.encode("utf-8", "replace").decode("latin-1").translate(_BYTES)


class Recent(dict):
    """A mapping that computes missing values; beyond ``limit`` new entries the older
    generation is forgotten. Texts longer than ``KEY`` are computed each time."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if key.__class__ is int or len(key) <= KEY:
            if len(self) >= self.limit:
                self.age()
            self[key] = value
        return value

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


class Bpe:
    """Vocabulary, merges, pair compatibility, encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.ids: dict[str, int] = {self._inner(t): i for t, i in vocab.items()}
        self.text: dict[int, str] = {i: t for t, i in self.ids.items()}
        #: ranks, keyed like ``compatible``; and for each token the nodes at its right and left edge
        #: from the byte up, each followed by the rank of the merge that takes it in
        self.merge: dict[int, int] = {}
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        for s, i in self.ids.items():
            if len(s) == 1 or (len(s) == 2 and s[1] == END):
                self.right[i] = self.left[i] = (i, INF)
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = vocab[a], vocab[b]
            self.merge[x << 20 | y] = rank
            pairs.append((x, y, vocab[a + b], rank))
        for x, y, z, rank in pairs:
            if z not in self.right and x in self.right and y in self.left and not self._crossed(x, y, rank):
                self.right[z] = (*self.right[y][:-1], rank, z, INF)
                self.left[z] = (*self.left[x][:-1], rank, z, INF)
        self.automaton = ahocorasick.Automaton()
        self.usable: dict[str, int] = {s: i for s, i in self.ids.items() if i in self.right}
        for s, i in self.usable.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        #: keyed by the left id times 2 ** 20 plus the right id
        self.compatible = Recent(lambda pair: not self._crossed(pair >> 20, pair & 0xFFFFF))
        self.encode_symbols = self._encoder()
        # decoding: all token strings in one buffer, and where each begins
        strings = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        top = max(strings) + 1
        parts = [strings.get(i, "").encode() for i in range(top)]
        self.buffer = np.frombuffer(b"".join(parts) + b" ", np.uint8)
        self.offsets = np.cumsum([0, *map(len, parts)])

    def _inner(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return token[: -len(self.suffix)] + END
        return token

    def _crossed(self, a: int, b: int, before: int = INF) -> bool:
        """Whether a merge with a rank below ``before`` joins the end of ``a`` to the start of
        ``b``. Both grow at the border by merges of rising rank; of equal ranks the left one
        comes first."""
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            px, py = right[i + 1], left[j + 1]
            rank = self.merge.get(right[i] << 20 | left[j])
            if rank is not None and rank < before and rank < px and rank <= py:
                return True
            if px <= py:
                if px >= before:
                    return False
                i += 2
            else:
                if py >= before:
                    return False
                j += 2

    def _encoder(self):
        """The function from a piece, in the vocabulary's characters (and END where it has word
        ends), to its ids."""
        usable, compatible = self.usable, self.compatible
        iter_long = self.automaton.iter_long
        top = max(self.ids.values()) + 1
        size, shorter = [0] * top, [-1] * top
        for s, i in self.ids.items():
            size[i] = len(s)
            # the longest token that is a proper prefix of this one
            shorter[i] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)

        known, ends = compatible.get, {}  # ends: the longest token that begins a short rest of a piece
        # a search reads its whole string, so it gets a window; a match that begins in its first
        # part is not cut by its end
        trusted = 256
        window = trusted + max(map(len, usable))

        def encode(s: str) -> list[int]:
            whole = usable.get(s)
            if whole is not None:
                return [whole]
            out: list[int] = []
            pos, last, n, dead = 0, -1, len(s), set()
            while True:
                # follow the longest matches as long as they fit
                token, stop = -1, pos + trusted
                for _, (length, token) in iter_long(s if n <= window and not pos else s[pos : pos + window]):
                    if last >= 0:
                        fits = known(last << 20 | token)
                        if fits is None:
                            fits = compatible[last << 20 | token]
                        if not fits:
                            break
                    if dead and pos + length in dead:
                        break
                    out.append(token)
                    pos += length
                    last = token
                    if pos > stop and n > window:
                        token = -2
                        break
                else:
                    token = -1
                if pos == n:
                    return out
                if token == -2:
                    continue
                # ``out`` is compatible up to ``pos``; ``token`` is to be tried next
                while True:
                    while token >= 0:
                        end = pos + size[token]
                        if end not in dead:
                            if last < 0:
                                break
                            fits = known(last << 20 | token)
                            if fits is None:
                                fits = compatible[last << 20 | token]
                            if fits:
                                break
                        token = shorter[token]
                    if token >= 0:
                        out.append(token)
                        pos, last = end, token
                        if pos == n:
                            return out
                        if n - pos > 8:
                            break
                        rest = s[pos:]
                        token = ends.get(rest)
                        if token is None:
                            if len(ends) > 100_000:
                                ends.clear()
                            ends[rest] = token = longest(rest)
                    else:
                        if not out:
                            raise ValueError("a symbol is not in the vocabulary")
                        dead.add(pos)
                        token = out.pop()
                        pos -= size[token]
                        last = out[-1] if out else -1

        def longest(s: str) -> int:
            """The longest token that begins a text; -1: none."""
            for end, (length, token) in iter_long(s):
                return token if end + 1 == length else -1
            return -1

        return encode

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of the tokens with a space between any two, gathered through the offset table."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        size = self.offsets[ids + np.uint32(1)] - begin + 1
        end = np.cumsum(size)
        out = self.buffer[np.arange(end[-1]) + np.repeat(begin - end + size, size)]
        out[end - 1] = 32
        return out[:-1].tobytes()

    def split_special(self, text: str) -> list[str]:
        """The text cut at special strings; these are the odd items."""
        if "<|" not in text:
            return [text]
        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)


def _gather(table: np.ndarray, begin: np.ndarray, size: np.ndarray, items: pa.Array, offsets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of items, each standing for table[begin : begin + size], written out: the values of
    all lists one after another, and where each list begins and the last ends."""
    item = items.to_numpy()
    n = size[item]
    end = np.cumsum(n)
    at = np.repeat((begin[item] - end + n).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return table[at], np.concatenate([[0], end])[offsets.to_numpy()]


class WordBpe(Bpe):
    """Lower case, white space dropped, every word ends in a marked token."""

    _ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
    _words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|(?:(?![{SPACE}])[^\p{{L}}\p{{N}}])+")
    _spaces = re.compile(f"[{SPACE}]+")
    _odd = re.compile("[\x1c-\x1f]")
    #: A mark right behind a letter: words always end there, so a space may go between.
    _behind = re.compile(r"[!-/:-@\[-`{-~](?<=[^\W\d_].)")
    _wide = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        super().__init__(path)
        self.packed = [struct.pack("<I", i) for i in range(max(self.ids.values()) + 1)]
        self.chunks = Recent(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; its words are runs of their own."""
        if not chunk.isalpha():
            found = (self._ascii if chunk.isascii() else self._words).findall(chunk)
            if len(found) > 1:
                return b"".join(map(self.chunks.__getitem__, found))
        return b"".join(map(self.packed.__getitem__, self.encode_symbols(as_symbols(chunk) + END)))

    def _words_of(self, words: list[str]) -> list[bytes]:
        """``chunks`` of many distinct words; those that are not there are encoded in one loop."""
        chunks, encode, pack = self.chunks, self.encode_symbols, self.packed.__getitem__
        get, old = chunks.get, chunks.old.get
        out = []
        for w in words:
            ids = get(w)
            if ids is None:
                ids = old(w)
                if ids is None:
                    if w.isascii() and w.isalpha():
                        ids = b"".join(map(pack, encode(w + END)))
                    else:
                        ids = self._chunk(w) if w else b""
                if len(w) <= KEY:
                    chunks[w] = ids
            out.append(ids)
        if len(chunks) >= chunks.limit:
            chunks.age()
        return out

    def _normal(self, text: str) -> str:
        """Lower case, composed, and no white space outside ASCII."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self._wide.sub(" ", text) if self._wide.search(text) else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.split_special(text)):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            else:
                part = self._normal(part)
                out += map(self.chunks.__getitem__, [c for c in self._spaces.split(part) if c] if self._odd.search(part) else part.split())
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids. The runs of all texts are split and numbered at once, their distinct
        ones are split into words and numbered again, so a word that repeats in the batch is
        looked up once."""
        apart = {k: np.frombuffer(self.encode(t), "<u4") for k, t in enumerate(texts) if "<|" in t}
        plain = pa.array([self._normal(t) if k not in apart else "" for k, t in enumerate(texts)], pa.large_string())
        runs = pc.ascii_split_whitespace(plain)
        distinct = runs.values.dictionary_encode()
        marked = self._behind.sub(r" \g<0>", "\n".join(distinct.dictionary.to_pylist())).split("\n")
        words = pc.ascii_split_whitespace(pa.array(marked, pa.large_string()))
        numbered = words.values.dictionary_encode()
        found = self._words_of(numbered.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids, bounds = _gather(np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size, numbered.indices, words.offsets)
        ids, bounds = _gather(ids, bounds[:-1], np.diff(bounds), distinct.indices, runs.offsets)
        return [apart[k] if k in apart else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]

    def decode(self, ids: bytes) -> bytes:
        """The tokens as they stand in the vocabulary, with a space between any two, in UTF-8."""
        return self.joined(np.frombuffer(ids, "<u4"))


class ByteBpe(Bpe):
    """Byte-level pieces; a piece begins where white space follows something else."""

    _tokens = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?![{SPACE}])[^\p{{L}}\p{{N}}])+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    _pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    _uneven = re.compile(f" [{SPACE}]|[{SPACE}] ")

    def __init__(self, path: str):
        super().__init__(path)
        self.counts = Recent(self.count_piece)
        #: the same for pieces that follow a space, without it
        self.spaced = Recent(self._count_spaced)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.split_special(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                for w in self._tokens.findall(part):
                    out += self.encode_symbols(as_symbols(w))
        return out

    def _count_spaced(self, piece: str) -> int:
        if piece.isascii() and piece.isalpha():  # the pattern takes the space and all letters
            return len(self.encode_symbols(_BYTES[32] + piece))
        return self.count_piece(" " + piece)

    def count_piece(self, piece: str) -> int:
        n = 0
        for k, part in enumerate(self.split_special(piece)):
            if k % 2:
                n += 1
                continue
            found = self._tokens.findall(part)
            if len(found) == 1 and part == piece:
                return len(self.encode_symbols(as_symbols(part)))
            for w in found:
                n += self.spaced[w[1:]] if w[0] == " " and len(w) > 1 else self.counts[w]
        return n

    def count(self, text: str) -> int:
        """Tokens of a text that begins and ends at borders of pieces."""
        if self._uneven.search(text):
            return sum(map(self.counts.__getitem__, self._pieces.findall(text)))
        first, *rest = text.split(" ")
        return (self.counts[first] if first else 0) + sum(map(self.spaced.__getitem__, rest))

    def count_batch(self, texts: list[str]) -> list[int]:
        """``count`` of each; pieces that repeat in the batch are looked up once."""
        apart = {k: self.count(t) for k, t in enumerate(texts) if "<|" in t or self._uneven.search(t)}
        plain = pa.array([t if k not in apart else "" for k, t in enumerate(texts)], pa.large_string())
        pieces = pc.split_pattern(plain, " ")
        numbered = pieces.values.dictionary_encode()
        table = np.fromiter(map(self.spaced.__getitem__, numbered.dictionary.to_pylist()), np.int64, len(numbered.dictionary))
        upto = np.concatenate([[0], np.cumsum(table[numbered.indices.to_numpy()])])
        bounds = pieces.offsets.to_numpy()
        out = []
        for k, t in enumerate(texts):
            if k in apart:
                out.append(apart[k])
            else:  # the first piece has no space before it
                first = t.partition(" ")[0]
                out.append(int(upto[bounds[k + 1]] - upto[bounds[k] + 1]) + (self.counts[first] if first else 0))
        return out

    def pieces(self, text: str) -> list[str]:
        """The text cut where white space follows something else."""
        return self._pieces.findall(text)

    def tokens(self, text: str) -> list[tuple[str, list[int]]]:
        """What the vocabulary's pattern cuts a text into, special strings too, each with its ids."""
        out = []
        for k, part in enumerate(self.split_special(text)):
            out += [(part, [self.special[part]])] if k % 2 else [(w, self.encode_symbols(as_symbols(w))) for w in self._tokens.findall(part)]
        return out


@lru_cache(maxsize=4)
def word_bpe(path: str, cache: int = CACHE) -> WordBpe:
    """The encoder of this process; ``cache`` bounds the words it keeps."""
    bpe = WordBpe(path)
    bpe.chunks.limit = cache
    bpe.compatible.limit = min(cache, bpe.compatible.limit)
    return bpe


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
