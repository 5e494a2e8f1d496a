"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public
vocabulary. A word (a run of letters, lower case, with the vocabulary's mark of
a word's start) may be segmented in many ways; the forward algorithm sums the
probabilities of all of them, and a text's score is the sum over its words of
the logarithms. Piece probabilities are fitted by expectation maximisation over
the same sums.

Bound, a parameter: training takes about `train_docs` documents of each
language, drawn by a hash of their ids, whole. Everything else covers all of
every text and all of the vocabulary's pieces of letters. Words of `long_word`
characters or more, whose probabilities are too small for floating point, are
summed in logarithms, in training as in scoring.

Defined results: a null text, or one without a letter, is `und` with score 0;
so is any text when no language could be learned. A null lang or doc_id is not
learned from, and a null doc_id is not held out. Equal texts get equal
predictions. An empty table gives an empty result. Columns beside doc_id, text
and lang are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


@dataclass(frozen=True)
class LangId:
    train_docs: int = 400
    long_word: int = 24
    vocabulary: str = "piece_bpe_32k.model"
    iterations: int = 3
    smoothing: float = 0.01
    unknown: float = 1e-7  # of a character that is no piece
    folds: int = 4
    held: int = 2
    seed: int = 6


def pieces_of(how: LangId) -> list[str]:
    import os

    import sentencepiece

    path = how.vocabulary
    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p.lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for p in [sp.id_to_piece(i)]}
    return sorted(p for p in kept if p and (LETTERS.fullmatch(p.lstrip(MARK)) or p == MARK))


def _code(words: list[str], width: int) -> np.ndarray:
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.uint64)


class Lattice:
    """All pieces at all places of a list of words of at most `width` characters, and sums over their paths."""

    def __init__(self, keys: np.ndarray, odd: np.ndarray, words: list[str], max_piece: int):
        self.size = np.array([len(w) for w in words], np.int64)
        width = int(self.size.max()) if len(words) else 0
        code = _code(words, width)
        self.width, self.arcs = width, []
        for i in range(width):
            h = np.zeros(len(words), np.uint64)
            for n in range(1, min(max_piece, width - i) + 1):
                h = h + code[:, i + n - 1] * odd[n - 1]
                alive = np.flatnonzero(self.size >= i + n)
                if not len(alive):
                    break
                want = C.mix(h[alive] + np.uint64(n))
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                if n == 1:  # every character can be passed, as a piece or as unknown
                    self.arcs.append((i, n, alive, np.where(hit, at, len(keys))))
                elif hit.any():
                    self.arcs.append((i, n, alive[hit], at[hit]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: probability of each piece, the unknown character last, a column for each language. Probability of every prefix."""
        a = np.zeros((self.width + 1, len(self.size), p.shape[1]))
        a[0] = 1
        for i, n, rows, piece in self.arcs:
            a[i + n, rows] += a[i, rows] * p[piece]
        return a

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.forward(p)[self.size, np.arange(len(self.size))], 1e-300))

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used, words weighted; p has one column."""
        a = self.forward(p)[:, :, 0]
        b = np.zeros((self.width + 1, len(self.size)))
        b[self.size, np.arange(len(self.size))] = 1
        for i, n, rows, piece in reversed(self.arcs):
            b[i, rows] += b[i + n, rows] * p[piece, 0]
        total = np.maximum(a[self.size, np.arange(len(self.size))], 1e-300)
        out = np.zeros(len(p))
        for i, n, rows, piece in self.arcs:
            out += np.bincount(piece, a[i, rows] * p[piece, 0] * b[i + n, rows] * weight[rows] / total[rows], len(p))
        return out


class LongLattice:
    """The same sums in logarithms, for words of any length. Pieces are looked up again in each pass, so that memory is one number for each character."""

    def __init__(self, keys: np.ndarray, odd: np.ndarray, words: list[str], max_piece: int):
        self.keys, self.odd, self.max_piece = keys, odd, max_piece
        self.size = np.array([len(w) for w in words], np.int64)
        self.width = int(self.size.max()) if len(words) else 0
        self.code = _code(words, self.width)

    def arcs(self, i: int):
        """(length, words, piece) of what may stand at character i."""
        alive = np.flatnonzero(self.size > i)
        h = np.zeros(len(alive), np.uint64)
        for n in range(1, min(self.max_piece, self.width - i) + 1):
            fits = self.size[alive] >= i + n
            alive, h = alive[fits], h[fits]
            if not len(alive):
                return
            h = h + self.code[alive, i + n - 1] * self.odd[n - 1]
            want = C.mix(h + np.uint64(n))
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            if n == 1:
                yield n, alive, np.where(hit, at, len(self.keys))
            elif hit.any():
                yield n, alive[hit], at[hit]

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        log_p, ring = np.log(p), self.max_piece + 1
        a = np.full((ring, len(self.size), p.shape[1]), -np.inf)
        a[0] = 0
        out = np.zeros((len(self.size), p.shape[1]))
        for i in range(self.width):
            here = a[i % ring].copy()
            a[i % ring] = -np.inf
            for n, rows, piece in self.arcs(i):
                a[(i + n) % ring, rows] = np.logaddexp(a[(i + n) % ring, rows], here[rows] + log_p[piece])
            done = self.size == i + 1
            out[done] = a[(i + 1) % ring, done]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        log_p = np.log(p[:, 0])
        a = np.full((self.width + 1, len(self.size)), -np.inf)
        a[0] = 0
        for i in range(self.width):
            for n, rows, piece in self.arcs(i):
                a[i + n, rows] = np.logaddexp(a[i + n, rows], a[i, rows] + log_p[piece])
        every = np.arange(len(self.size))
        total = a[self.size, every]
        ring = self.max_piece + 1
        b = np.full((ring, len(self.size)), -np.inf)
        out = np.zeros(len(p))
        for i in range(self.width, -1, -1):
            here = np.where(self.size == i, 0.0, -np.inf)
            for n, rows, piece in self.arcs(i):
                rest = log_p[piece] + b[(i + n) % ring, rows]
                here[rows] = np.logaddexp(here[rows], rest)
                np.add.at(out, piece, np.exp(a[i, rows] + rest - total[rows]) * weight[rows])
            b[i % ring] = here
        return out


def _like_lengths(sizes: np.ndarray, cells: int = 1 << 20):
    """Numbers of words in groups of like size, each of about `cells` characters at most when all are as long as its longest."""
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * sizes[order[j]] <= cells:
            j += 1
        yield order[i:j]
        i = j


class Model:
    def __init__(self, how: LangId, languages: list[str], pieces: list[str]):
        self.how, self.languages = how, languages
        self.max_piece = max((len(p) for p in pieces), default=1)
        self.odd = C.powers(self.max_piece + 1, 0xC2B2AE3D27D4EB4F)
        code = _code(pieces, self.max_piece)
        size = np.array([len(p) for p in pieces], np.uint64)
        key = C.mix((code * self.odd[: self.max_piece]).sum(axis=1, dtype=np.uint64) + size)
        self.keys = np.unique(key)
        self.p = np.zeros((len(self.keys) + 1, len(languages)))

    def _lattices(self, words: list[str]):
        """(numbers of words, their lattice)."""
        sizes = np.array([len(w) for w in words], np.int64)
        for long, kind in ((False, Lattice), (True, LongLattice)):
            chosen = np.flatnonzero((sizes >= self.how.long_word) == long)
            for part in _like_lengths(sizes[chosen] + 1, 1 << 20 if long else 100_000):
                part = chosen[part]
                yield part, kind(self.keys, self.odd, [MARK + words[k] for k in part], self.max_piece)

    def fit(self, column: int, counts: dict[str, int]) -> None:
        words = sorted(counts)
        weight = np.array([counts[w] for w in words], float)
        n = len(self.keys)
        p = np.full((n + 1, 1), 1.0 / n)
        p[n] = self.how.unknown
        for _ in range(self.how.iterations):
            used = np.zeros(n + 1)
            for part, lattice in self._lattices(words):
                used += lattice.expected(p, weight[part])
            p = ((1 - self.how.smoothing) * used[:n] / max(used[:n].sum(), 1e-9) + self.how.smoothing / n)[:, None]
            p = np.vstack((p, [[self.how.unknown]]))
        self.p[:, column] = p[:, 0]

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for part, lattice in self._lattices(words):
            out[part] = lattice.log_likelihood(self.p)
        return out


def fold_of(how: LangId):
    return F.crc32(F.col("doc_id").cast("string")) % how.folds


def train(docs: DataFrame, how: LangId = LangId()) -> Model:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(how) != how.held))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(count)
    model = Model(how, languages, pieces_of(how))
    if not languages:
        return model
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(how.train_docs / count[k]))])
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(how.seed)), 11) / F.lit(float(1 << 53)) < F.element_at(share, F.col("lang")))

    def words(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            got: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w, n in Counter(LETTERS.findall(text.lower())).items():
                    got[lang, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {k: {} for k in languages}
    for r in drawn.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():  # words of the drawn documents only
        counts[r["lang"]][r["word"]] = r["n"]
    for i, k in enumerate(languages):
        model.fit(i, counts[k])
    return model


def predict(docs: DataFrame, model: Model, how: LangId = LangId(), carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, or with carry: those columns of docs, __kw_lang and __kw_score."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)))
        for b in batches:
            for i, _, off in C.sub_batches(b.column("text"), 1 << 21):
                part = b.slice(i, len(off) - 1)
                ids, ends, fresh = [], [], []
                if len(known) > 300_000:
                    known.clear()
                    table = table[:0]
                for text in part.column("text").to_pylist():
                    found = LETTERS.findall(text.lower()) if text else []
                    if found and not any(c.isalpha() for w in found for c in w):
                        found = []
                    for w in found:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = len(known)
                            fresh.append(w)
                        ids.append(k)
                    ends.append(len(ids))
                if fresh and model.languages:
                    table = np.vstack((table, model.score_words(fresh)))
                langs, scores, at = [], [], 0
                ids_a = np.array(ids, np.int64)
                for e in ends:
                    if e == at or not model.languages:
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        total = table[ids_a[at:e]].sum(axis=0)
                        best = int(total.argmax())
                        langs.append(model.languages[best])
                        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                    at = e
                columns = [c for c in part.schema.names if carry or c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "__kw_lang", "__kw_score"])

    if carry:
        rows = docs.select(*carry)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "__kw_lang string", "__kw_score double"])
        return rows.mapInArrow(run, schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold_of(how) == how.held, F.lit(False)).alias("held_out"))
    got = rows.mapInArrow(run, "doc_id long, held_out boolean, __kw_lang string, __kw_score double")
    return got.select("doc_id", "held_out", F.col("__kw_lang").alias("lang_pred"), F.col("__kw_score").alias("score"))


def identify(docs: DataFrame, how: LangId = LangId()) -> DataFrame:
    return predict(docs, train(docs, how), how)


def keep_identified(docs: DataFrame, how: LangId = LangId(), min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a probability of min_score at least."""
    got = predict(docs, train(docs, how), how, carry=docs.columns)
    return got.where((F.col("__kw_lang") != "und") & (F.col("__kw_score") >= min_score)).select(*docs.columns)
