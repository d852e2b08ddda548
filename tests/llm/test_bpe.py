import base64
import hashlib
import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, bpe_codec, token_counts
from millrace.llm.bpe import vocabulary

from .data import TEXTS, empty_documents, needs_vocabularies, odd_documents

pytestmark = needs_vocabularies
tokenizers = pytest.importorskip("tokenizers")


def paths():
    return vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


PIECES = st.sampled_from(["don't", "we'll", "'s", "the", " ", "  ", "\n", "\t\n", "antidisestablishment", "aaaaaaaaaaaa", "ababab", "<|endoftext|>", "<|startoftext|>", "<|", "É", "é", "ß", "İ", "ΣΑΣ", "中文", "한국", "😀", "\x1c", "\x85", "\xa0", " ", "12", "½", "!?", "##", "'", "’", "\0", "_"])
# code points that only newer Unicode versions know are letters to one library and not to the other
KNOWN = st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs", "Cn")), max_size=6)
TEXT = st.lists(st.one_of(PIECES, KNOWN), max_size=25).map("".join)


@pytest.fixture(scope="module")
def word():
    return bpe.word_bpe(paths()[0]), tokenizers.Tokenizer.from_file(paths()[0])


@pytest.fixture(scope="module")
def byte():
    return bpe.byte_bpe(paths()[1]), tokenizers.Tokenizer.from_file(paths()[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_word_level_ids_and_decoding(word, texts):
    own, library = word
    for text, ids in zip(texts, own.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want == list(struct.unpack(f"<{len(want)}I", own.encode(text)))
        assert own.joined(ids).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.integers(4, 40), st.integers(1, 8))
def test_byte_level_counts_whole_and_in_chunks(byte, texts, chunk, overlap):
    own, library = byte
    for text, n in zip(texts, own.count_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want and n == len(want)
        assert token_counts.count_tokens(text, own, chunk, overlap) == len(want)


def test_every_token_encodes_to_itself(word, byte):
    for own in (word[0], byte[0]):
        assert len(own.usable) == len(own.ids)
        assert all(own.encode_symbols(s) == [i] for s, i in list(own.usable.items())[::37])


def test_long_runs_take_linear_work(byte):
    own, library = byte
    for text in ("a" * 50_000, "ab" * 20_000, " " * 30_000, "x" * 20_000 + " " + "y" * 20_000):
        assert token_counts.count_tokens(text, own) == len(library.encode(text, add_special_tokens=False).ids)


UNSPACED = {
    "Han": lambda rng, n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
    "Thai": lambda rng, n: "".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(n)),
    "base64": lambda rng, n: base64.b64encode(rng.randbytes(n))[:n].decode(),
    "blanks": lambda rng, n: " " * n,
    "marks": lambda rng, n: "".join(rng.choice("'-!<|\\") for _ in range(n)),
}


@pytest.mark.parametrize("kind", UNSPACED)
def test_unspaced_texts_equal_the_library_and_take_linear_time(byte, word, kind):
    rng, took = random.Random(6), {}
    for n in (20_000, 40_000, 80_000, 160_000, 320_000):
        text = UNSPACED[kind](rng, n)
        began = time.thread_time()
        found = token_counts.count_tokens(text, byte[0])
        took[n] = time.thread_time() - began
        if n <= 80_000:
            assert found == byte[0].count(text) == len(byte[1].encode(text, add_special_tokens=False).ids)
            assert word[0].encode_batch([text])[0].tolist() == word[1].encode(text, add_special_tokens=False).ids
    # 2.5 times for twice the length, with room for a busy machine
    assert took[320_000] <= 2.5**4 * max(took[20_000], 0.01), took


@pytest.mark.parametrize("seed", range(4))
def test_splices_inside_runs_of_every_kind(byte, seed):
    own, library = byte
    rng, spliced = random.Random(seed), 0
    parts = [lambda n: UNSPACED["Han"](rng, n), lambda n: UNSPACED["Thai"](rng, n), lambda n: UNSPACED["base64"](rng, n), lambda n: UNSPACED["marks"](rng, n), lambda n: " " * n, lambda n: "\n \t"[: n % 4], lambda n: "<|endoftext|>", lambda n: "7" * n, lambda n: "don't's" * (n % 5)]
    for _ in range(150):
        text = "".join(rng.choice(parts)(rng.randrange(1, 120)) for _ in range(12))
        want = len(library.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((64, 20), (100, 32), (150, 17)):
            assert token_counts.count_tokens(text, own, chunk, overlap) == want
            if len(text) > chunk:
                left, right = token_counts.Chunk(text, 0, chunk, own), token_counts.Chunk(text, chunk - overlap, min(len(text), 2 * chunk), own)
                spliced += token_counts.splice(left, right) is not None
    assert spliced > 150


def test_caches_hold_no_long_pieces(byte, word):
    rng = random.Random(2)
    texts = [UNSPACED["Han"](rng, 4000) + " word" for _ in range(30)]
    byte[0].count_batch(texts), word[0].encode_batch(texts)
    for cache in (byte[0].counts, byte[0].spaced, word[0].chunks):
        assert max(map(len, [*cache, *cache.old]), default=0) <= bpe.KEY


def test_boundary_proof():
    assert token_counts.stable("ab cd", 2) and not token_counts.stable("ab cd", 3) and not token_counts.stable("ab", 2)
    assert not token_counts.stable("a\x1cb", 1)


def test_odd_rows(spark, word, byte):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.digests(odd_documents(spark), paths()[0]).collect())
    want = []
    for d, t in TEXTS:
        ids = word[1].encode(t or "", add_special_tokens=False).ids
        text = word[1].decode(ids, skip_special_tokens=False)
        want.append((str(d), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    full = {r["doc_id"]: r for r in bpe_codec.encoded(odd_documents(spark), paths()[0]).collect()}
    assert full[12]["ids"] == word[1].encode("a", add_special_tokens=False).ids and full[4]["decoded"] == ""
    counts = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.counted(odd_documents(spark), paths()[1]).collect())
    lengths = [(str(d), len((t or "").encode()), len(byte[1].encode(t or "", add_special_tokens=False).ids)) for d, t in TEXTS]
    assert counts == sorted((d, b, n, n > 1024) for d, b, n in lengths)


def test_empty_table(spark):
    assert bpe_codec.digests(empty_documents(spark), paths()[0]).count() == 0
    assert token_counts.counted(empty_documents(spark), paths()[1]).count() == 0


def test_the_piece_cache_forgets_but_stays_right():
    made = []
    cache = bpe.Recent(lambda k: made.append(k) or k * 2, limit=3)
    assert [cache[k] for k in (1, 2, 3, 4, 1, 5, 6, 7, 8)] == [2, 4, 6, 8, 2, 10, 12, 14, 16]
    assert made.count(1) == 1 and len(cache) <= 3
