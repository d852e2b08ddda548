import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm import toxicity as tox

from .data import SF, TEXTS, empty_documents, needs_tables, odd_documents


def clauses(text):
    f = tox.Scorer(tox.default_model()).features(text)
    return {k: round(float(np.expm1(v)), 6) for k, v in zip(tox.FEATURES, f) if v}


def test_the_grammar_scores_clauses():
    assert clauses("The cat sat. It rained.") == {}
    assert clauses("what an idiot") == {"insult": 3.0}
    assert clauses("you are an idiot") == {"aimed insult": 3.0}
    assert clauses("idiot, that is you") == {"aimed insult": 3.0}
    assert clauses("an idiot. you are here") == {"insult": 3.0}
    assert clauses("you are not an idiot") == {"negated": 3.0}
    assert clauses("not that it matters much but you idiot") == {"aimed insult": 3.0}
    assert clauses("she said the clown left") == {"reported": 3.0}
    assert clauses("I will kill you") == {"aimed threat": 1.0}
    assert clauses("kill the process") == {"threat": 1.0}
    assert clauses("an idiot and a moron, you know") == {"aimed insult": 6.0}


def test_all_that_came_before_a_target_is_aimed():
    for n in (3, 4, 5, 40):
        assert clauses("idiot " * n + "that is you") == {"aimed insult": 3.0 * n}
        assert clauses("idiot " * n + "kill " * n + "you moron") == {"aimed insult": 3.0 * (n + 1), "aimed threat": n}
        assert clauses("idiot " * n) == {"insult": 3.0 * n}


def test_scores_rank_as_they_should():
    scorer = tox.Scorer(tox.default_model())
    score = lambda t: scorer.score(scorer.features(t)[None])[0]
    assert score("you idiot") > score("an idiot") > score("he said idiot") > score("hello")
    assert score("") == score("hello") < 0.1


def test_reported_speech_past_colons_and_around_quotations():
    for text in ('he said: "you are an idiot"', 'he said: you are an idiot', '"you are an idiot", she said', "«you idiot» wrote the man", 'he said "one. you idiot. two"'):
        assert clauses(text) == {"reported": 3.0}, text
    for text in ('"you are an idiot". she left', '"you are an idiot" and then a little later she said', '"you idiot'):
        assert clauses(text) == {"aimed insult": 3.0}, text
    assert clauses("he said so. you idiot") == {"aimed insult": 3.0}
    assert clauses('"you idiot"\nshe said nothing') == {"aimed insult": 3.0}


def test_a_threat_strikes_a_target_near_behind_it():
    assert clauses("I beat the drum for you") == {"threat": 1.0}
    assert clauses("kill all of you") == {"aimed threat": 1.0}
    assert clauses("don't hurt them") == {"negated": 1.0}
    assert clauses("kill and burn you") == {"aimed threat": 2.0}


def by_plain_rules(tags):
    """The sums of a tag string, from the rules and not from the machines; every word weighs 1."""
    sums = dict.fromkeys(tox.FEATURES, 0)
    line = []
    for t in [*tags, tox.LINE]:
        if t != tox.LINE:
            line.append(t)
            continue
        word = [x in tox.WORDS for x in line]
        words_to = lambda i, j: sum(word[i + 1 : j + 1])  # noqa: E731, words behind i up to j
        quotes, at = [], None  # begin, end, whether it is said, where the words behind it may end
        said = [False] * (len(line) + 1)
        now = False
        for i, x in enumerate(line):
            inside = quotes[-1] if at is not None else None
            if x == tox.REPORT and not (inside and not inside[2]):
                now = True
            elif x == tox.STOP and not (inside and inside[2]):
                now = False
            elif x == tox.QUOTE:
                if at is None:
                    at = i
                    quotes.append([i, len(line), now])
                else:
                    quotes[-1][1], at = i, None
            said[i + 1] = now
        for i, x in enumerate(line):
            if x not in (tox.INSULT, tox.THREAT):
                continue
            ends = [j for j, y in enumerate(line) if y in (tox.STOP, tox.COLON)]
            if any(line[j] == tox.NEGATION and words_to(j, i) <= 3 and not any(j < e < i for e in ends) for j in range(i)):
                sums["negated"] += 1
                continue
            quote = next((q for q in quotes if q[0] < i < q[1]), None)
            heard = said[i] or bool(quote and quote[2])
            if quote and not quote[2] and quote[1] < len(line):
                c = quote[1]
                for r in range(c + 1, len(line)):
                    if line[r] in (tox.STOP, tox.QUOTE) or words_to(c, r) > 3:
                        break
                    if line[r] == tox.REPORT:
                        heard = True
                        break
            if heard:
                sums["reported"] += 1
                continue
            cuts = [j for j, y in enumerate(line) if y in (tox.STOP, tox.COLON, tox.QUOTE)]
            low = max((j for j in cuts if j < i), default=-1)
            high = min((j for j in cuts if j > i), default=len(line))
            if x == tox.INSULT:
                aimed = tox.TARGET in line[low + 1 : high]
            else:
                aimed, last = False, i
                for j in range(i + 1, high):
                    if words_to(last, j) > 3:
                        break
                    if line[j] == tox.THREAT:
                        last = j
                    elif line[j] == tox.TARGET:
                        aimed = not said[j]
                        break
            sums[("aimed " if aimed else "") + x] += 1
        line = []
    return sums


def test_features_and_scores_of_texts_against_plain_rules():
    rng = np.random.default_rng(11)
    shown = {tox.INSULT: ["idiot", "Scum"], tox.THREAT: ["kill", "burn"], tox.TARGET: ["you", "THEM"], tox.NEGATION: ["not", "don't"], tox.REPORT: ["said", "wrote"], tox.OTHER: ["house", "été", "x"], tox.STOP: [".", "?!"[:1]], tox.COLON: [":"], tox.QUOTE: ['"', "“"], tox.LINE: ["\n"]}
    scorer = tox.Scorer(tox.Model(dict.fromkeys(tox.SEEDS, 1.0), {}, np.append(tox.PRIOR, tox.BIAS)))
    for _ in range(2000):
        tags = [tox.TAGS[i] for i in rng.integers(0, len(tox.TAGS), rng.integers(0, 30))]
        text = " 7, ".join(str(rng.choice(shown[t])) for t in tags)
        plain = by_plain_rules(tags)
        f = scorer.features(text)
        assert np.allclose(f, [math.log1p(plain[k]) for k in tox.FEATURES]), text
        z = sum(w * math.log1p(plain[k]) for w, k in zip(tox.PRIOR, tox.FEATURES)) + tox.BIAS
        assert abs(scorer.score(f[None])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_the_lexicon_against_plain_counts(spark):
    docs, labels = labelled(spark)
    rows = docs.join(labels.where("toxic is not null"), "doc_id").select("toxic", "text")
    words, stems = tox.lexicon(rows)
    texts = [(r["toxic"], {w for w in re.split(r"[^a-z]+", r["text"].lower()) if len(w) >= 3}) for r in rows.collect()]
    n = [sum(y == k for y, _ in texts) for k in (0, 1)]
    found = {0: {}, 1: {}}
    forms = {(w, 0) for _, ws in texts for w in ws} | {(w[:k], 1) for _, ws in texts for w in ws for k in (4, 5, 6) if len(w) > k}
    for form, stem in forms:
        hits = [sum(sum(w.startswith(form) and len(w) > len(form) if stem else w == form for w in ws) for y, ws in texts if y == k) for k in (0, 1)]
        if hits[1] >= 4 and hits[1] >= 3 * hits[0] and tox.chance(hits[1], sum(hits), n[1] / sum(n)) < tox.ALPHA:
            odds = math.log((hits[1] + 0.5) / (n[1] + 1)) - math.log((hits[0] + 0.5) / (n[0] + 1))
            if odds > 1.5:
                found[stem][form] = odds
    for got, want in ((words, found[0]), (stems, found[1])):
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert words or stems


def by_the_table(tags):
    state, sums = 0, {}
    for t in tags:
        state, out = tox.GRAMMAR.arcs[state][t]
        tox.apply(out, 1, sums)
    tox.apply(tox.GRAMMAR.final[state], 0, sums)
    assert set(k for k, v in sums.items() if v) <= set(tox.FEATURES)
    return {k: sums.get(k, 0) for k in tox.FEATURES}


def test_the_table_equals_plain_rules():
    short = [tox.INSULT, tox.THREAT, tox.TARGET, tox.NEGATION, tox.REPORT, tox.OTHER, tox.QUOTE]
    for n in range(7):
        for tags in itertools.product(short, repeat=n):
            if n < 6 or tox.INSULT in tags or tox.THREAT in tags:
                assert by_the_table(tags) == by_plain_rules(tags), tags
    for n in range(5):
        for tags in itertools.product(tox.TAGS, repeat=n):
            assert by_the_table(tags) == by_plain_rules(tags), tags
    rng = np.random.default_rng(2)
    for _ in range(20_000):
        tags = [tox.TAGS[i] for i in rng.integers(0, len(tox.TAGS), rng.integers(5, 16))]
        assert by_the_table(tags) == by_plain_rules(tags), tags


def test_composition_equals_running_one_after_the_other():
    rng = np.random.default_rng(2)
    machines = [tox.insult(), tox.threat(), tox.negation(), tox.reported(), tox.target()]
    for _ in range(300):
        tags = [tox.TAGS[i] for i in rng.integers(0, len(tox.TAGS), rng.integers(0, 12))]
        symbols, want = list(tags), []
        for m in machines:
            state, out = m.start, []
            for x in symbols:
                if x[0] in ("add", "move"):
                    out.append(x)
                else:
                    state, made = m.step(state, x)
                    out += made
            symbols = out + list(m.final(state))
        want = symbols
        state, got = 0, []
        for t in tags:
            state, out = tox.GRAMMAR.arcs[state][t]
            got += out
        assert got + list(tox.GRAMMAR.final[state]) == want


def test_threat_weights_and_the_bound_of_chance_are_learned_from_the_sample(spark):
    odd = lambda i: " ".join(f"{chr(97 + (i * k) % 26)}{chr(97 + i % 23)}{chr(97 + k)}" for k in range(1, 9))
    rows = [(1, f"kill {odd(i)}") for i in range(30)] + [(0, f"word {odd(i)}") for i in range(30, 330)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(rows)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    assert model.threats["kill"] > tox.THREAT_WEIGHT and model.threats["burn"] == tox.THREAT_WEIGHT and "kill" not in model.insults


def test_a_sample_is_full_for_any_number_of_rows(spark):
    for n in (10**4, 10**10, 4 * 10**18):
        bound = common.hash_bounds({"x": n}, 3000)["x"]
        share = (bound + 2**63) / 2**64
        assert 3000 < share * n < 3400
    assert common.hash_bounds({"x": 3000}, 3000) == {"x": None}
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("c"), F.lit(1).alias("same"))
    counts = {"a": 4000, "b": 16_000}
    got = common.least_hashed(rows, "c", counts, 50, ["id"], "t").collect()
    want = rows.withColumn("h", F.xxhash64("id")).collect()
    for c in "ab":
        assert {r["id"] for r in got if r["c"] == c} == {r["id"] for r in sorted((r for r in want if r["c"] == c), key=lambda r: r["h"])[:50]}
    # rows that all share a hash, and counts that are far too high
    assert common.least_hashed(rows, "c", counts, 50, ["same"], "t").count() == 100
    assert common.least_hashed(rows, "c", {k: 10**10 for k in counts}, 50, ["id"], "t").count() == 100


def labelled(spark):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    bad = ["grumfle", "grumfled", "blorkish"]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 40))
        if i % 8 == 0:
            for w in rng.choice(bad, 2):
                text.insert(int(rng.integers(0, 40)), w)
        rows.append((i, " ".join(text), int(i % 8 == 0)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")


def test_insults_are_learned(spark):
    docs, labels = labelled(spark)
    model = tox.train(docs, labels)
    assert any(w.startswith("grum") for w in (*model.insults, *model.stems))
    got = {r["doc_id"]: r for r in tox.scored(docs, model).collect()}
    right = [got[i]["predicted"] == (i % 8 == 0) for i in range(400)]
    assert np.mean(right) > 0.97


def test_odd_rows_and_nothing_to_learn_from(spark):
    docs, labels = labelled(spark)
    model = tox.train(empty_documents(spark), labels.limit(0))
    rows = tox.scored(odd_documents(spark).select("doc_id", "text"), model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert tox.train(odd_documents(spark), labels).weights.shape == (len(tox.FEATURES) + 1,)
    assert tox.scored(empty_documents(spark).select("doc_id", "text"), model).count() == 0


@needs_tables
def test_held_out(spark):
    rows = tox.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit >= 0.6 * sum(r["toxic"] for r in rows) and hit >= 0.8 * sum(r["predicted"] for r in rows)
