"""Toxicity by a weighted finite-state pattern grammar.

A document is read as tags of its words and marks: insult, threat, target, negation, reported
speech, other; stop, colon, quote, line. The insults are learned: words, and stems of four
letters and more, that labelled toxic documents hold far more often than the others than chance
allows, together with a short list of fixed ones; an insult's weight is its log-odds, and so is
a threat's where the sample tells. Five transducers read the tags, each what the one before
puts out, and are composed into one table when the module is loaded:

- *insult* marks insults;
- *threat* marks threats, and strikes one when a target follows within three words ("kill you",
  not "beat the drum for you"); later than that it lapses;
- *negation* takes marks at most three words behind a negation out as negated;
- *reported speech* takes marks out as reported behind a verb of saying in the sentence, also
  past a colon, and in a quotation that such a verb stands before or, within three words,
  behind; a quotation that nobody is said to say counts as if it stood without quotes;
- *target* raises the insults of a clause that names a target to aimed ones.

What the table puts out adds a word's weight to a sum or moves one sum into another, so a few
sums stand beside the state however long the text is. A line ends everything. The score is a
logistic function of the logarithms of the sums; its weights are fitted on the sample, drawn
towards fixed ones.

``SAMPLE`` labelled rows of each class are learned from (all where it has fewer), those with the
least hashes of doc_id; near copies among them count once. What reaches the driver are the
forms that may pass the test of chance, and a few numbers for each sampled row.

Results for odd input: a null or wordless text scores like one without a match; rows with a
null doc_id or label are not learned from; of several labels of one document any may count;
without labels the fixed list and weights hold; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_texts
from .bpe import Recent
from .common import documents, least_hashed, sized, written
from .langid import held_out

SAMPLE, ALPHA, STEM_MIN, STEM_MAX, THRESHOLD = 6000, 1e-6, 4, 6, 0.3
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Words, and the marks that the grammar reads.
TOKEN = re.compile(WORD.pattern + r"|[.!?;:\n\"“”„«»]")

# Words of the grammar, by tag.
SEEDS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb bastard imbecile".split()
THREATS = "kill hurt destroy beat shoot stab burn murder crush".split()
TARGETS = "you your yours yourself they them he him she her these those du ihr dich vous tu te ustedes tú".split()
NEGATIONS = "not no never nobody don't doesn't isn't aren't wasn't won't can't kein keine nicht nie pas jamais nunca ningún".split()
REPORTS = "said says say told tells wrote writes quoted claims claimed reported alleged called sagte schrieb disait écrit dijo escribió".split()
SEED_WEIGHT, THREAT_WEIGHT = 3.0, 1.0

TAGS = INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, STOP, COLON, QUOTE, LINE = "insult", "threat", "target", "negation", "report", "other", "stop", "colon", "quote", "line"
MARKS = dict.fromkeys(".!?;", STOP) | {":": COLON, "\n": LINE} | dict.fromkeys('"“”„«»', QUOTE)
WORDS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
#: How many words a negation, a threat or the end of a quotation looks ahead.
REACH = 3
#: The sums of a document, and the weights that the fit is drawn to.
FEATURES = ("insult", "aimed insult", "threat", "aimed threat", "negated", "reported")
PRIOR = np.array([1.0, 1.3, 0.1, 1.0, 0.3, 0.2])
BIAS, RIDGE = -3.0, 0.5

# Symbols between the machines: a tag as it came; ("mark", kind) for an insult or a threat word,
# ("mark", kind, "quoted") inside a quotation; ("strike",) and ("lapse",), also "quoted", for the
# threats before; and what the last machine puts out, ("add", sum) and ("move", from, to).


@dataclass
class Fst:
    """A deterministic transducer: ``step(state, symbol)`` is the next state and what is put out,
    ``final(state)`` what is put out at the end."""

    start: object
    step: Callable[[object, object], tuple[object, tuple]]
    final: Callable[[object], tuple] = lambda state: ()


def insult() -> Fst:
    return Fst(0, lambda state, tag: (0, (("mark", INSULT),) if tag == INSULT else (tag,)))


def threat(reach: int = REACH) -> Fst:
    """State: words in which a target still strikes the threats before."""

    def step(left: int, symbol):
        if symbol == THREAT:
            return reach, (("mark", THREAT),)
        if symbol == TARGET:
            return 0, (("strike",), TARGET) if left else (TARGET,)
        if symbol in (STOP, COLON, LINE):
            return 0, (("lapse",), symbol) if left else (symbol,)
        if symbol == QUOTE or not left:
            return left, (symbol,)
        return left - 1, (symbol,) if left > 1 else (symbol, ("lapse",))

    return Fst(0, step, lambda left: (("lapse",),) if left else ())


def is_word(symbol) -> bool:
    return symbol in WORDS or symbol[0] == "mark"


def negation(reach: int = REACH) -> Fst:
    """State: words that a negation still reaches."""

    def step(left: int, symbol):
        if symbol == NEGATION:
            return reach, (symbol,)
        if symbol in (STOP, COLON, LINE):
            return 0, (symbol,)
        if not is_word(symbol):
            return left, (symbol,)
        negated = left and symbol[0] == "mark"
        return max(0, left - 1), (("add", "negated"), OTHER) if negated else (symbol,)

    return Fst(0, step)


#: What becomes of a quotation's sums when nobody is found to say it, and when someone is.
QUOTED = ("insult", "aimed insult", "threat", "aimed threat")
PENDING = (("clause quoted insult", "insult"), ("clause quoted threat", "threat"))
SETTLED = (*((("move", a, b)) for a, b in PENDING), *(("move", "quoted " + f, f) for f in QUOTED))
ATTRIBUTED = (*((("move", a, "reported")) for a, _ in PENDING), *(("move", "quoted " + f, "reported") for f in QUOTED))


def reported(reach: int = REACH) -> Fst:
    """State: whether a verb of saying stands before in the sentence; the quotation: none, one that
    is said (2) or one that may be (1); words left behind it to say so."""

    def step(state, symbol):
        said, quote, left = state
        if symbol == LINE:
            return (False, 0, 0), ((*SETTLED, LINE) if quote == 1 or left else (LINE,))
        if symbol == QUOTE:
            if quote:
                return (said, 0, reach if quote == 1 else 0), (STOP,)
            return (said, 2 if said else 1, 0), ((*SETTLED, STOP) if left else (STOP,))
        if symbol == STOP:
            return (said and quote == 2, quote, 0), ((*SETTLED, STOP) if left else (STOP,))
        if symbol == REPORT and quote != 1:
            return (True, quote, 0), ((*ATTRIBUTED, OTHER) if left else (OTHER,))
        if symbol[0] in ("mark", "strike", "lapse"):
            if quote == 2 or said:
                out = (("add", "reported"), OTHER) if symbol[0] == "mark" else ()
            else:
                out = ((*symbol, "quoted"),) if quote == 1 else (symbol,)
        else:
            out = (symbol,)
        if left and is_word(symbol):
            left -= 1
            out = (*out, *SETTLED) if not left else out
        return (said, quote, left), out

    return Fst((False, 0, 0), step, lambda state: SETTLED if state[1] == 1 or state[2] else ())


def target() -> Fst:
    """State: whether the clause has named a target, and what of it still waits for one."""

    def step(aimed: bool, symbol):
        if symbol == TARGET:
            return True, (("move", "clause insult", "aimed insult"), ("move", "clause quoted insult", "quoted aimed insult"))
        if symbol in (STOP, COLON, LINE):
            return False, tuple(("move", f"clause {q}{kind}", q + kind) for q in ("", "quoted ") for kind in (INSULT, THREAT))
        q = "quoted " if symbol[-1] == "quoted" else ""
        if symbol[0] == "mark":
            return aimed, (("add", f"{q}aimed insult" if aimed and symbol[1] == INSULT else f"clause {q}{symbol[1]}"),)
        if symbol[0] == "strike":
            return aimed, (("move", f"clause {q}threat", f"{q}aimed threat"),)
        if symbol[0] == "lapse":
            return aimed, (("move", f"clause {q}threat", f"{q}threat"),)
        return aimed, (symbol,) if symbol[0] in ("add", "move") else ()

    return Fst(False, step, lambda aimed: step(aimed, STOP)[1])


def compose(a: Fst, b: Fst) -> Fst:
    """What ``a`` puts out read by ``b``."""

    def read(state, symbols) -> tuple[object, tuple]:
        out = ()
        for symbol in symbols:
            if symbol[0] in ("add", "move"):
                more = (symbol,)
            else:
                state, more = b.step(state, symbol)
            out += more
        return state, out

    def step(state, symbol):
        p, made = a.step(state[0], symbol)
        q, out = read(state[1], made)
        return (p, q), out

    def final(state):
        q, out = read(state[1], a.final(state[0]))
        return out + b.final(q)

    return Fst((a.start, b.start), step, final)


@dataclass
class Table:
    """A transducer over ``TAGS`` written out: numbered states, what each puts out by tag and at the end."""

    arcs: list[dict[str, tuple[int, tuple]]] = field(default_factory=list)
    final: list[tuple] = field(default_factory=list)


def table(machine: Fst) -> Table:
    t, number, todo = Table(), {machine.start: 0}, [machine.start]
    for state in todo:
        row = {}
        for tag in TAGS:
            after, out = machine.step(state, tag)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row[tag] = number[after], out
        t.arcs.append(row)
        t.final.append(machine.final(state))
    return t


MACHINE = compose(compose(compose(compose(insult(), threat()), negation()), reported()), target())
GRAMMAR = table(MACHINE)


def apply(out: tuple, weight: float, sums: dict[str, float]) -> None:
    """Carry out what the table puts out for a word of that weight."""
    for name, *at in out:
        if name == "add":
            sums[at[0]] = sums.get(at[0], 0.0) + weight
        elif moved := sums.pop(at[0], 0.0):
            sums[at[1]] = sums.get(at[1], 0.0) + moved


@dataclass
class Model:
    insults: dict[str, float]  # words
    stems: dict[str, float]
    weights: np.ndarray  # of FEATURES, then the bias
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, THREAT_WEIGHT))


def default_model() -> Model:
    return Model(dict.fromkeys(SEEDS, SEED_WEIGHT), {}, np.append(PRIOR, BIAS))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        fixed = {w: (tag, 1.0) for words, tag in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
        fixed |= {mark: (tag, 0.0) for mark, tag in MARKS.items()} | {w: (THREAT, weight) for w, weight in model.threats.items()}

        def tag(word: str) -> tuple[str, float]:
            if word in fixed:
                return fixed[word]
            weight = model.insults.get(word, 0.0)
            for n in range(STEM_MIN, min(STEM_MAX, len(word)) + 1):
                weight = max(weight, model.stems.get(word[:n], 0.0))
            return (INSULT, weight) if weight else (OTHER, 1.0)

        self.tag = Recent(tag)
        self.marks = Recent(lambda word: self.tag[word][0] in (INSULT, THREAT))

    def features(self, text: str) -> np.ndarray:
        sums: dict[str, float] = {}
        lower = text.lower()
        if any(map(self.marks.__getitem__, WORD.findall(lower))):
            # a line starts anew, so lines without an insult or a threat put out nothing
            for line in lower.split("\n"):
                tags = [self.tag[w] for w in TOKEN.findall(line)]
                if any(t[0] in (INSULT, THREAT) for t in tags):
                    state, arcs = 0, GRAMMAR.arcs
                    for tag, weight in tags:
                        state, out = arcs[state][tag]
                        if out:
                            apply(out, weight, sums)
                    apply(GRAMMAR.final[state], 0.0, sums)
        return np.log1p(np.array([sums.get(k, 0.0) for k in FEATURES]))

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.model.weights[:-1] + self.model.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chance(hits: int, n: int, p: float) -> float:
    """The probability of at least so many hits in n draws."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(hits, n + 1))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, toxic, text`` of labelled rows that are not held out, near copies once."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = least_hashed(rows, "toxic", n, sample, ["doc_id"], "toxicity-taken")
    ids = written(taken.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = written(texts.join(sized(ids), "doc_id"), "toxicity-sample")
    # near copies share the least hash of their runs of five words, mostly; two such hashes name them
    words = found.select("doc_id", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5)))
    keyed = words.withColumn("h", runs).select("doc_id", F.array_min("h").alias("a"), F.array_min(F.transform("h", lambda x: F.xxhash64(x))).alias("b"))
    one = keyed.groupBy("a").agg(F.min("doc_id").alias("doc_id"), F.min_by("b", "doc_id").alias("b")).groupBy("b").agg(F.min("doc_id").alias("doc_id"))
    return found.join(sized(written(one.select("doc_id"), "toxicity-once")), "doc_id", "left_semi")


def lexicon(rows: DataFrame, alpha: float = ALPHA) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log-odds, from ``toxic, text``. The driver gets those only that may
    pass the test of chance."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}, {}
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where(F.length("word") >= 3)
    forms = [F.struct(F.col("word").alias("form"), F.lit(0).alias("stem"))]
    forms += [F.when(F.length("word") > k, F.struct(F.substring("word", 1, k).alias("form"), F.lit(k).alias("stem"))) for k in range(STEM_MIN, STEM_MAX + 1)]
    # words that no toxic row holds need no counting; a stem is counted once for each word of a row
    counted = words.select("toxic", F.explode(F.array_compact(F.array(*forms))).alias("f")).select("toxic", "f.form", "f.stem").groupBy("form", "stem")
    counted = counted.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad >= 4 and bad >= 3 * good")
    share = bad / (bad + good)
    # a bound below the probability of so many hits: what exceeds alpha by it can't pass the test
    n, k = F.col("bad") + F.col("good"), F.col("bad")
    part = lambda x, p: F.when(x > 0, x * F.log(x / n / p)).otherwise(0.0)
    least = F.exp(-part(k, share) - part(n - k, 1 - share)) / F.sqrt(F.greatest(F.lit(1.0), 8 * k * (n - k) / n))
    words_found, stems_found = {}, {}
    for r in counted.where(least < alpha).collect():
        if chance(r["bad"], r["bad"] + r["good"], share) < alpha:
            odds = math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1))
            if odds > 1.5:
                (stems_found if r["stem"] else words_found)[r["form"]] = odds
    return words_found, stems_found


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, drawn towards PRIOR and BIAS."""
    prior = np.append(PRIOR, BIAS)
    x, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    ridge = np.diag([RIDGE] * len(PRIOR) + [0.01])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = written(sampled(docs, labels, sample).select("toxic", "text"), "toxicity-train")
    words, stems = lexicon(rows)
    threats = {w: words.pop(w, THREAT_WEIGHT) for w in THREATS}
    model = Model(dict.fromkeys(SEEDS, SEED_WEIGHT) | words, stems, np.append(PRIOR, BIAS), threats)

    def setup():
        scorer = Scorer(model)
        return lambda texts: [(scorer.features(t).tolist(),) for t in texts]

    measured = map_texts(rows.select("toxic", "text"), None, "f array<double>", setup=setup).toPandas()
    if len(measured):
        model.weights = fit(np.array(measured["f"].tolist()).reshape(-1, len(FEATURES)), measured["toxic"].to_numpy(np.float64))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, matches``: ``matches`` has the features, as logarithms of 1 + weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        scorer = Scorer(shared.value)

        def call(texts: list[str]) -> list[tuple]:
            f = np.array([scorer.features(t) for t in texts])
            return list(zip(scorer.score(f).tolist(), f.tolist()))

        return call

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = map_texts(texts, None, "score double, matches array<double>", setup=setup)
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"))
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
