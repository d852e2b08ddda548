import itertools
import math
import re
import zlib

import numpy as np
import pytest

from millrace.llm import langid

from .data import SF, TEXTS, empty_documents, needs_tables, odd_documents


def best_score(s, penalty):
    v = s[0].copy()
    for row in s[1:]:
        v = np.maximum(v, v.max() - penalty) + row
    return v.max()


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_exact_in_blocks(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 150, rng.integers(1, 9))
    scores = -rng.exponential(2, (lengths.sum(), 3)).astype(np.float32)
    path, at = langid.viterbi(scores, lengths, 4.0), 0
    for n in lengths:
        p, s = path[at : at + n], scores[at : at + n]
        assert abs(s[np.arange(n), p].sum() - 4.0 * (np.diff(p) != 0).sum() - best_score(s, 4.0)) < 1e-2
        at += n


def plain_label(text, model, switch, spans):
    """The whole operator once more, a word and a letter at a time. Of paths that are equally good
    the one in ``spans`` is taken."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0, []
    mask = (1 << 64) - 1
    names, scores, known = langid.SCRIPT_NAMES, [], []
    for w in words:
        s = [0.0] * len(model.languages)
        for a, b, c in zip("\n" + w, w, w[1:] + "\n"):
            h = (ord(a) * 0x9E3779B97F4A7C15 + ord(b) * 0xC2B2AE3D27D4EB4F + ord(c) * 0x165667B19E3779F9) & mask
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 48
            s = [x + float(y) for x, y in zip(s, model.weights[h])]
        can = [bool(x) for x in model.scripts[names.index(langid.script(w[0]))]]
        s = [x if ok else 4 * langid.FLOOR for x, ok in zip(s, can)] if any(can) else [0.0] * len(s)
        scores.append([x - max(s) for x in s])
        known.append(any(can) and any(c.isalpha() for c in w))
    best = [(v, [k]) for k, v in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max((((v - switch * (p[-1] != k)) + row[k], [*p, k]) for v, p in best), key=lambda x: x[0]) for k in range(len(row))]
    value, path = max(best, key=lambda x: x[0])
    own = [model.languages.index(lang) for _, n, lang in spans for _ in range(n)]
    if len(own) == len(path) and abs(sum(r[k] for r, k in zip(scores, own)) - switch * sum(a != b for a, b in zip(own, own[1:])) - value) < 1e-2:
        path = own
    letters = [sum(len(w) for w, p in zip(words, path) if p == k) for k in range(len(model.languages))]
    top = letters.index(max(letters))
    total = [sum(r[k] for r in scores) for k in range(len(letters))]
    gap = min(total[top] - t for k, t in enumerate(total) if k != top) * min(1, 8 / len(words))
    score = letters[top] / sum(letters) / (1 + math.exp(-max(-30, min(30, gap)))) if any(known) else 0.0
    spans, at = [], 0
    for k, run in itertools.groupby(path):
        n = len(list(run))
        spans.append((at, n, model.languages[k]))
        at += n
    return model.languages[top], score, spans


def test_labels_and_training_against_plain_rules(spark):
    model = langid.train(corpus(spark))
    rng = np.random.default_rng(7)
    pool = "the of house tree der und nicht baum zwischen дом окно который 中文 ελληνικό x qz m² ½ 12 window's don't Straße".split()
    texts = [" ".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(120)] + ["", "12 ½", "中文", "the " * 70 + "дом " * 50]
    for text, (lang, score, spans) in zip(texts, langid.label(texts, model)):
        want = plain_label(text, model, langid.SWITCH, spans)
        assert (lang, spans) == (want[0], want[2]), text
        assert abs(score - want[1]) < 1e-4
    # training: the counts of every bucket, from the rows that are learned from
    rows = [r for r in corpus(spark).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    counts = np.zeros((langid.BUCKETS, 3))
    for r in rows:
        for w in r["text"].split():
            for a, b, c in zip("\n" + w, w, w[1:] + "\n"):
                h = (ord(a) * 0x9E3779B97F4A7C15 + ord(b) * 0xC2B2AE3D27D4EB4F + ord(c) * 0x165667B19E3779F9) % 2**64
                counts[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> 48, model.languages.index(r["lang"])] += 1
    overall = (counts.sum(axis=1, keepdims=True) + 1) / (counts.sum() + langid.BUCKETS)
    w = np.log(counts / counts.sum(axis=0) + langid.SMOOTH * overall)
    assert np.allclose(model.weights, np.maximum(w - w.max(axis=1, keepdims=True), langid.FLOOR), atol=1e-5)


def corpus(spark):
    words = {"en": "the of and with that house tree from window", "de": "der die und mit nicht haus baum fenster zwischen", "ru": "дом дерево окно между который вместе город"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i, lang in enumerate(list(words) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_scripts_and_spans_of_mixed_text(spark):
    model = langid.train(corpus(spark))
    assert model.languages == ["de", "en", "ru"]
    lang, score, spans = langid.label(["the house and the tree from that window " * 2 + "der baum und nicht mit haus zwischen fenster " * 4], model)[0]
    assert lang == "de" and [s[2] for s in spans] == ["en", "de"] and spans[0][:2] == (0, 16) and 0 < score < 1
    assert langid.label(["дом между город"], model)[0][0] == "ru"
    assert langid.label(["", "123 ...", "中文"], model)[0][0] == "und"
    assert langid.script("a") == "Latin" and langid.script("ж") == "Cyrillic" and langid.script("中") == "Han"


def test_odd_rows_and_filter(spark):
    model = langid.train(corpus(spark))
    docs = odd_documents(spark)
    got = langid.identified(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 7, 15)] == ["und"] * 5
    kept = langid.sure_language(docs)
    assert kept.columns == docs.columns and not {4, 5, 6, 7} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in TEXTS)


def test_texts_in_no_learned_script_are_rejected(spark):
    learned = corpus(spark)
    foreign = ["中文 文本", "ελληνικό κείμενο", "½ 中文", "ไทย"]
    fine = ["中文 house", "qxzj", "ж", "the ελληνικό"]
    model = langid.train(learned)
    got = langid.label(foreign + fine, model)
    assert all(lang in model.languages for lang, _, _ in got)
    assert [score > 0 for _, score, _ in got] == [False] * len(foreign) + [True] * len(fine)
    docs = learned.union(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(foreign + fine)], learned.schema))
    kept = {r["doc_id"] for r in langid.sure_language(docs).collect()}
    assert kept == set(range(180)) | {1000 + len(foreign) + i for i in range(len(fine))}


def test_words_that_mix_letters_and_other_signs_have_letters(spark):
    learned = corpus(spark)
    texts = ["m²", "H₂O", "2 ½m", "²", "½ ² 3"]
    assert [lang != "und" for lang, _, _ in langid.label(texts, langid.train(learned))] == [any(map(str.isalpha, t)) for t in texts]
    docs = learned.union(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(texts)], learned.schema))
    assert {r["doc_id"] for r in langid.sure_language(docs).collect() if r["doc_id"] >= 1000} == {1000, 1001, 1002}


def test_nothing_to_learn_from(spark):
    empty = empty_documents(spark)
    assert langid.train(empty).languages == [] and langid.sure_language(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identified(odd_documents(spark).select("doc_id", "text"), langid.train(empty)).collect()} == {"und"}


@needs_tables
def test_held_out_accuracy(spark):
    found = langid.op1_language_id(spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
