"""Toxicity by a weighted finite-state grammar over clauses.

Words are classed by weighted acceptors (a stem list walked as an automaton):
insult, threat, target, negation, reported speech. Four small transducers read
the class sequence of a clause: the target transducer strengthens insults that
have an addressee and lets threats through only with one, the negation and
report transducers weaken what they have in scope. They are composed once into a
single table (state, class) -> (state, factor); the sum of weight * factor along
a clause is its score. A document's score is a logistic function of its matched
clauses' scores, so an isolated word counts only through its clause.

Insult stems and their weights are learned beside a fixed public list: terms
(whole words, or their beginnings) whose log-odds between labelled documents are
high. Learning takes about `train_docs` labelled documents, drawn by a hash of
their ids, whole; no more than that reaches the driver, as word statistics that
passed a support threshold and as four numbers a document. Scoring covers all of
every text.

Defined results: null and empty texts have no clause and get the score of such;
a null doc_id is scored, not held out and not learned from; several labels of
one id count as toxic if one does; null labels are ignored; with no label at all
the fixed list and fixed coefficients are used; equal texts score equally; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C

LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:,\n]")

# Closed word classes in four languages, lower case.
INSULT = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "filthy", "vermin",
    "coward", "liar",
)
THREAT = (
    "kill", "hurt", "beat", "destroy", "shoot", "stab", "strangle", "töten", "umbringen", "tuer", "frapper", "matar", "golpear",
)
TARGET = (
    "you", "your", "yours", "u", "ur", "he", "she", "they", "them", "this", "these", "those", "that", "du", "dich", "dein", "ihr", "euch", "tu", "te",
    "toi", "vous", "votre", "tú", "usted", "ustedes",
)
NEGATION = (
    "not", "no", "never", "nobody", "isn't", "aren't", "wasn't", "don't", "doesn't", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun",
    "nunca", "jamás", "tampoco",
)
REPORT = (
    "said", "says", "say", "told", "claimed", "claims", "wrote", "reported", "according", "quoted", "alleged", "sagte", "schrieb", "laut",
    "behauptete", "dit", "écrit", "selon", "prétend", "dijo", "según", "escribió", "afirma",
)

OTHER, IS_INSULT, IS_THREAT, IS_TARGET, IS_NEGATION, IS_REPORT = range(6)


@dataclass(frozen=True)
class Toxicity:
    train_docs: int = 8000
    min_stem: int = 4
    max_stem: int = 8
    min_support: int = 5  # toxic documents with the term
    min_support_share: float = 0.01  # of the toxic documents drawn
    min_log_odds: float = 2.0
    prior_weight: float = 1.0
    folds: int = 5
    held: int = 0
    seed: int = 3
    #: Without labels: intercept, and per log1p(sum), strongest clause, clauses per 100 words.
    default: tuple[float, ...] = (-3.0, 2.0, 3.0, 0.0)


# ---- transducers ---------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """(state, class) -> (state, factor); state 0 is first. Absent arcs stay and pass 1."""

    states: int
    arcs: dict = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same class; states pair up and factors multiply."""
    arcs = {}
    for s in range(a.states):
        for t in range(b.states):
            for symbol in range(6):
                (s2, x), (t2, y) = a.step(s, symbol), b.step(t, symbol)
                arcs[s * b.states + t, symbol] = (s2 * b.states + t2, x * y)
    return Transducer(a.states * b.states, arcs)


def target_transducer() -> Transducer:
    return Transducer(2, {(0, IS_TARGET): (1, 0.0), (1, IS_TARGET): (1, 0.0), (1, IS_INSULT): (1, 1.5), (0, IS_THREAT): (0, 0.0), (1, IS_THREAT): (1, 1.5)})


def negation_transducer(reach: int = 3, factor: float = 0.5) -> Transducer:
    """In scope for `reach` words after the negation; a second negation inside the scope ends it."""
    arcs = {(0, IS_NEGATION): (reach, 0.0)}
    for left in range(1, reach + 1):
        arcs |= {(left, c): (left - 1, 1.0) for c in (OTHER, IS_TARGET, IS_REPORT)}
        arcs |= {(left, c): (0, factor) for c in (IS_INSULT, IS_THREAT)}
        arcs[left, IS_NEGATION] = (0, 0.0)
    return Transducer(reach + 1, arcs)


def report_transducer(factor: float = 0.6) -> Transducer:
    return Transducer(2, {(0, IS_REPORT): (1, 0.0), (1, IS_INSULT): (1, factor), (1, IS_THREAT): (1, factor)})


def emission() -> Transducer:
    """Lets insults and threats out, nothing else."""
    return Transducer(1, {(0, c): (0, 0.0) for c in (OTHER, IS_TARGET, IS_NEGATION, IS_REPORT)})


def grammar() -> Transducer:
    return compose(compose(target_transducer(), negation_transducer()), compose(report_transducer(), emission()))


class Scorer:
    """Features of a text under learned stems: plain data, rebuilt in each worker."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.table = grammar()
        self.fixed = {w: c for c, group in ((IS_REPORT, REPORT), (IS_NEGATION, NEGATION), (IS_TARGET, TARGET), (IS_THREAT, THREAT)) for w in group}
        self.sizes = sorted({len(s) for s in stems})
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def weight(self, word: str) -> float:
        got = self.words.get(word, 0.0)
        for n in self.sizes:
            if n > len(word):
                break
            got = max(got, self.stems.get(word[:n], 0.0))
        return got

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        for word in LETTERS.findall(text):
            symbol, weight = self.fixed.get(word, OTHER), 1.0
            insult = self.weight(word)
            if insult > 0:
                symbol, weight = IS_INSULT, insult
            state, factor = self.table.step(state, symbol)
            total += weight * factor
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """log1p of the sum of the matched clauses' scores, the strongest, matched clauses per 100 words."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *THREAT}:
                self.automaton.add_word(w, len(w))
            self.automaton.make_automaton()
        low = text.lower()
        done, scores = -1, []
        for end, n in self.automaton.iter(low):
            at = end - n + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            # the clause begins behind the last mark before the match; the one that ended the clause before may be it
            floor = max(done, 0)
            begin = max(floor, max(low.rfind(c, floor, at) for c in ".!?;:,\n") + 1)
            stop = CLAUSE_END.search(low, at)
            done = stop.start() if stop else len(low)
            score = self.clause(low[begin:done])
            if score > 0:
                scores.append(score)
        if not scores:
            return 0.0, 0.0, 0.0
        return float(np.log1p(sum(scores))), max(scores), 100.0 * len(scores) / (low.count(" ") + low.count("\n") + 1)


@dataclass
class Model:
    scorer: Scorer
    coefficients: np.ndarray


def fold_of(how: Toxicity):
    return F.crc32(F.col("doc_id").cast("string")) % how.folds


def training_rows(docs: DataFrame, labels: DataFrame, how: Toxicity) -> DataFrame:
    """text, toxic of about train_docs labelled rows outside the held-out fold."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(fold_of(how) != how.held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = ids.count()
    drawn = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(how.seed)), 11) / F.lit(float(1 << 53)) < F.lit(how.train_docs / max(n, 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id")  # about train_docs rows of two numbers


def learn_terms(rows: DataFrame, how: Toxicity) -> tuple[dict[str, float], dict[str, float]]:
    """(word: weight), (stem: weight): terms much likelier in toxic documents."""
    low, high = how.min_stem, how.max_stem

    def terms(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            got: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen = set()
                for w in set(LETTERS.findall(text.lower())):
                    if len(w) >= 3:
                        seen.add("=" + w)
                    for n in range(low, min(high, len(w)) + 1):
                        seen.add("^" + w[:n])
                got[toxic > 0].update(seen)
                got[toxic > 0]["#"] += 1
            keys = [(k, t) for t in (True, False) for k in got[t]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([got[t][k] if t else 0 for k, t in keys], pa.int64()), pa.array([0 if t else got[t][k] for k, t in keys], pa.int64())], ["term", "pos", "neg"])

    counted = rows.select("text", "toxic").mapInArrow(terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where((F.col("pos") >= how.min_support) | (F.col("term") == "#"))
    counted = C.materialise(counted, "toxic-terms")
    whole = counted.where("term = '#'").first()
    if whole is None or not whole["pos"] or not whole["neg"]:
        return {}, {}
    support = max(how.min_support, how.min_support_share * whole["pos"])
    odds = F.log((F.col("pos") + 0.5) / (F.lit(whole["pos"]) + 1.0)) - F.log((F.col("neg") + 0.5) / (F.lit(whole["neg"]) + 1.0))
    # two standard errors less: among many candidates some look toxic by chance
    odds = odds - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    found = counted.where((F.col("term") != "#") & (F.col("pos") >= support)).withColumn("odds", odds).where(F.col("odds") >= how.min_log_odds).collect()  # at most words per document / min_support_share terms
    words = {r["term"][1:]: r["odds"] for r in found if r["term"][0] == "="}
    stems = {r["term"][1:]: r["odds"] for r in found if r["term"][0] == "^"}
    # a stem speaks for its extensions unless one is clearly purer
    kept: dict[str, float] = {}
    for s in sorted(stems, key=len):
        if not any(s.startswith(k) and stems[s] < kept[k] + 1.0 for k in kept):
            kept[s] = stems[s]
    scale = lambda x: float(min(x, 6.0) / 4.0)
    return {w: scale(x) for w, x in words.items()}, {s: scale(x) for s, x in kept.items()}


def with_features(rows: DataFrame, scorer: Scorer, keep: str) -> DataFrame:
    C.small_batches(rows.sparkSession)
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, _, off in C.sub_batches(b.column("text"), 1 << 21):
                part = b.slice(i, len(off) - 1)
                got = np.array([scorer.features(t) if t else (0.0, 0.0, 0.0) for t in part.column("text").to_pylist()], float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(got[:, k]) for k in range(3))], [*names, "f0", "f1", "f2"])

    return rows.select(*names, "text").mapInArrow(run, f"{keep}, f0 double, f1 double, f2 double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept."""
    x = np.hstack((np.ones((len(x), 1)), x))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> Model:
    rows = C.materialise(training_rows(docs, labels, how), "toxic-train")
    words, stems = learn_terms(rows, how)
    scorer = Scorer({w: how.prior_weight for w in INSULT} | words, stems)
    got = with_features(rows, scorer, "toxic int").collect()  # about train_docs rows
    y = np.array([float(r["toxic"] > 0) for r in got])
    if len(y) == 0 or y.min() == y.max():
        return Model(scorer, np.array(how.default))
    return Model(scorer, logistic(np.array([[r["f0"], r["f1"], r["f2"]] for r in got]), y))


def score(docs: DataFrame, model: Model, how: Toxicity = Toxicity()) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(how) == how.held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    b = [float(v) for v in model.coefficients]
    z = F.lit(b[0]) + F.col("f0") * b[1] + F.col("f1") * b[2] + F.col("f2") * b[3]
    p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    got = with_features(rows, model.scorer, "doc_id long, held_out boolean").withColumn("score", p)
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> DataFrame:
    return score(docs, train(docs, labels, how), how)
