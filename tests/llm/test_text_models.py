import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import same, words_of
from pyspark.sql import functions as F

from kinweave.llm import entropy, langid, line_rules, toxicity


def brute_counts(t):
    t = t or ""
    w = words_of(t)
    lines = [x for x in t.split("\n") if words_of(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_line_rules(spark, docs, corpus, clashing, nothing):
    r = random.Random(2)
    junk = "\n".join([*["same line again here."] * 6, "", " ", "Home | About | Contact | More", "All rights reserved."] + ["the cat sat on a mat and ran off now. " * 3] * 2)
    more = [(1000 + i, t, None, None, None) for i, t in enumerate([junk, "x\n\n\ny", "a b c d e f g h a b c d e f g h", "".join(r.choice("ab \n\t|#é") for _ in range(3000))])]
    rows = [*corpus, *more]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = line_rules.clean_lines(df)
    want = sorted(((c[0], *brute_counts(c[1])) for c in rows), key=str)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str) == want
    for x in got.collect():
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
        assert not (x.kept and x.base_failed)
    bad = {x.doc_id: x for x in got.where("doc_id >= 1000").collect()}
    assert "Home" not in bad[1000].clean_text and "rights" not in bad[1000].clean_text and bad[1000].n_lines_removed >= 7
    assert same(line_rules.clean_lines(docs), line_rules.clean_lines(clashing))
    assert line_rules.clean_lines(nothing).count() == 0


def test_lines_and_words_are_told_apart_by_bytes(spark, monkeypatch):
    """Two lines that a polynomial modulo 2^64 can't tell apart; and hashes that nearly all collide."""
    thue = "a"
    for _ in range(12):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    r = random.Random(5)
    texts = [thue + "\n" + other, thue + "\n" + thue, *("\n".join(" ".join(r.choice("abc") * r.randint(1, 2) for _ in range(r.randint(0, 12))) for _ in range(20)) for _ in range(5))]
    body, off = line_rules.C.utf8(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [brute_counts(t) for t in texts]
    assert want[0][3] == 0 and want[1][3] == 1
    real = line_rules.C.segment_hash
    for bad in (real, lambda *x: real(*x) % np.uint64(3)):
        monkeypatch.setattr(line_rules.C, "segment_hash", bad)
        got = line_rules.judge(body, off, line_rules.Rules(), False)
        assert [tuple(int(got[c][i]) for c in names) for i in range(len(texts))] == want
    monkeypatch.setattr(line_rules.C, "segment_hash", real)
    mix = line_rules.C.mix
    monkeypatch.setattr(line_rules.C, "mix", lambda x: mix(x) % np.uint64(2))
    got = line_rules.judge(body, off, line_rules.Rules(), False)
    assert [int(x) for x in got["n_repeat_words"]] == [w[4] for w in want]


def test_line_cleaning_keeps_prose(spark):
    r = random.Random(1)
    prose = "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(14)) + "." for i in range(6))
    df = spark.createDataFrame([(1, prose + "\nLicensed under the Apache License, Version 2.0."), (2, "a | b | c | d\n" * 30)], "doc_id long, text string")
    a, b = line_rules.clean_lines(df).orderBy("doc_id").collect()
    assert a.kept and a.clean_text == prose and not b.kept


def language_rows(n=160, seed=1):
    r = random.Random(seed)
    sounds = {"en": ["th", "ing", "er", "ou", "st"], "fr": ["eau", "oi", "qu", "elle", "é"], "de": ["sch", "ung", "ei", "ch", "ü"]}
    rows = []
    for i in range(n):
        k = r.choice(sorted(sounds))
        rows.append((i, " ".join("".join(r.choice(sounds[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))), k, "s", 0))
    return rows


def test_language(spark, docs, corpus, clashing, nothing):
    rows = language_rows()
    extra = [(900, None, "en", "s", 0), (901, "12 -- ½ ²", "en", "s", 0), (902, "sch" * 50, "de", "s", 0), (None, "eau quelle", "fr", "s", 0)]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].held_out for r in held)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de" and not got[None].held_out
    assert langid.keep_identified(df).columns == df.columns and langid.keep_identified(df).where("doc_id in (900, 901)").count() == 0
    assert same(langid.identify(docs), langid.identify(clashing))
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def segmentations(text):
    for n in range(len(text)):
        for cuts in combinations(range(1, len(text)), n):
            yield [text[i:j] for i, j in zip((0, *cuts), (*cuts, len(text)), strict=True)]


def brute_piece(p, piece):
    return p[piece] if piece in p else p[None] if len(piece) == 1 else 0.0


def brute_fit(counts, pieces, how):
    """Expectation maximisation over written-out segmentations; None is the unknown character."""
    p = dict.fromkeys(pieces, 1 / len(pieces)) | {None: how.unknown}
    for _ in range(how.iterations):
        used = dict.fromkeys(pieces, 0.0)
        for w, n in counts.items():
            ways = [(math.prod(brute_piece(p, x) for x in s), s) for s in segmentations("▁" + w)]
            total = sum(x for x, _ in ways)
            for x, s in ways:
                for piece in s:
                    if piece in used:
                        used[piece] += n * x / total
        whole = sum(used.values())
        p = {k: (1 - how.smoothing) * v / whole + how.smoothing / len(pieces) for k, v in used.items()} | {None: how.unknown}
    return p


PIECES = ["a", "b", "c", "ab", "ba", "aba", "bcb", "▁", "▁a", "▁ab", "abcabc"]


@pytest.mark.parametrize("long_word", [2, 5, 24])
def test_predictions_against_brute_force(spark, monkeypatch, long_word):
    """Fitted and scored over all segmentations, written out; short and long words take different ways to the same sums."""
    monkeypatch.setattr(langid, "pieces_of", lambda how: PIECES)
    how = langid.LangId(long_word=long_word)
    r = random.Random(6)
    rows = []
    for i in range(40):
        k = r.choice(["x", "y"])
        rows.append((i, " ".join("".join(r.choice("aabc" if k == "x" else "bbcaz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))), k, "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    learned = {k: Counter(w for d, t, g, *_ in rows if g == k and zlib.crc32(str(d).encode()) % 4 != 2 for w in t.split()) for k in "xy"}
    models = {k: brute_fit(learned[k], PIECES, how) for k in "xy"}
    got = {x.doc_id: x for x in langid.identify(df, how).collect()}
    for d, t, *_ in rows:
        logs = {k: sum(math.log(sum(math.prod(brute_piece(m, x) for x in s) for s in segmentations("▁" + w))) for w in t.split()) for k, m in models.items()}
        best = max(logs, key=logs.get)
        assert got[d].lang_pred == best and got[d].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel=1e-6)


def test_languages_of_long_words(spark):
    """Runs of 30 letters teach their language as others do."""
    r = random.Random(7)
    letters = {"long": "abcde", "short": "aeiou"}
    rows = []
    for i in range(120):
        k = r.choice(sorted(letters))
        rows.append((i, " ".join("".join(r.choice(letters[k]) for _ in range(30 if k == "long" else 5)) for _ in range(8)), k, "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.lang_pred for x in langid.identify(df).where("held_out").collect()}
    assert got and all(got[d] == k for d, _, k, *_ in rows if d in got)


def test_very_long_word():
    m = langid.Model(langid.LangId(), ["x"], ["a", "b"])
    m.p[:] = 1e-3
    assert m.score_words(["ab" * 4000])[0, 0] == pytest.approx(8001 * math.log(1e-3))
    m.fit(0, {"ab" * 4000: 2, "a": 1})
    assert m.p[:2, 0].sum() == pytest.approx(1)


def toxic_rows(n=400):
    r = random.Random(8)
    neutral = ["river", "stone", "lamp", "wander", "quiet", "table", "green", "seven"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(neutral) for _ in range(r.randint(8, 60))]
        bad = r.random() < 0.3
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["idiot", "grobbelfang", "grobbelzap"]))
        rows.append((i, " ".join(w) + ".", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, docs, clashing, nothing):
    rows, labels = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i, _, _ in held)
    assert sum(got[i].predicted == t for i, _, t in held) >= 0.95 * len(held)
    odd = lab.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], lab.schema))
    a = toxicity.toxicity(docs, odd)
    assert a.count() == docs.count() and a.where("score < 0 or score > 1 or score is null").count() == 0
    assert same(a, toxicity.toxicity(clashing, odd))
    assert toxicity.toxicity(nothing, lab.limit(0)).count() == 0 and toxicity.toxicity(docs, lab.limit(0)).count() == docs.count()


def test_grammar():
    s = toxicity.Scorer({w: 1.0 for w in toxicity.INSULT}, {})
    c = s.clause
    assert c("you idiot") == pytest.approx(1.5) and c("an idiot") == pytest.approx(1.0)
    assert c("you are not an idiot") == pytest.approx(0.75) and c("not not an idiot") == pytest.approx(1.0)
    assert c("he said you idiot") == pytest.approx(0.9)
    assert c("kill the light") == 0 and c("kill you") == 0 and c("i will hurt them") == 0 and c("you i will kill") == pytest.approx(1.5)
    assert s.features("a quiet river. you idiot, now")[1] == pytest.approx(1.5)
    assert s.features("idiotic is no match") == (0.0, 0.0, 0.0)
    g = toxicity.grammar()
    assert g.states == 2 * 4 * 2


def brute_clauses(text, weights, weight=None):
    """Scores above 0 of a text's clauses, rule by rule; weights of beginnings of words, or weight of a word."""
    import re

    T, out = toxicity, []
    weight = weight or (lambda word: max((w for s, w in weights.items() if word.startswith(s)), default=0))
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        target = report = False
        scope = total = 0
        for word in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause):
            insult = weight(word)
            if insult or word in T.THREAT and word not in T.TARGET + T.NEGATION + T.REPORT:
                factor = insult * (1.5 if target else 1) if insult else 1.5 * target
                total += factor * (0.5 if scope else 1) * (0.6 if report else 1)
                scope = 0
            elif word in T.NEGATION:
                scope = 0 if scope else 3
            else:
                target, report, scope = target or word in T.TARGET, report or word in T.REPORT, max(scope - 1, 0)
        if total > 0:
            out.append(total)
    return out


def test_clauses_against_brute_force():
    r = random.Random(3)
    weights = {"idiot": 1.0, "grob": 0.7, "grobel": 1.3}
    scorer = toxicity.Scorer({}, weights)
    pool = ["idiot", "Idiots", "grobfang", "grobelzap", "kill", "skill", "you", "not", "said", "river", "isn't", "1idiot", "stone", "İx"]
    for _ in range(400):
        text = "".join(r.choice(pool) + r.choice([" "] * 8 + [". ", ", ", "\n", "!"]) for _ in range(r.randint(0, 40)))
        want = brute_clauses(text, weights)
        got = scorer.features(text)
        assert got[:2] == pytest.approx((np.log1p(sum(want)), max(want, default=0.0))), text
        assert (got[2] > 0) == bool(want)


def brute_toxicity(rows, labels):
    """doc_id -> score: terms learned by counting sets, stems pruned, clauses scored rule by rule, a logistic fit by least squares."""
    import math
    import re

    how, label, learned = toxicity.Toxicity(), {}, []
    for d, _, t in labels:
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % how.folds != how.held:
            label[d] = max(label.get(d, 0), t)
    for d, text, *_ in rows:
        if d in label:
            words = set(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", (text or "").lower()))
            learned.append(({"=" + w for w in words if len(w) >= 3} | {"^" + w[:n] for w in words for n in range(how.min_stem, min(how.max_stem, len(w)) + 1)}, label[d] > 0, text or ""))
    n = {t: sum(1 for x in learned if x[1] is t) for t in (True, False)}
    odds = {}
    for term in set().union(*(x[0] for x in learned)):
        a, b = (sum(1 for x in learned if x[1] is t and term in x[0]) for t in (True, False))
        z = math.log((a + 0.5) / (n[True] + 1)) - math.log((b + 0.5) / (n[False] + 1)) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= max(how.min_support, how.min_support_share * n[True]) and z >= how.min_log_odds:
            odds[term] = z
    exact = dict.fromkeys(toxicity.INSULT, how.prior_weight) | {t[1:]: min(z, 6) / 4 for t, z in odds.items() if t[0] == "="}
    stems = {}
    for stem in sorted((t[1:] for t in odds if t[0] == "^"), key=len):
        if all(not stem.startswith(k) or odds["^" + stem] >= odds["^" + k] + 1 for k in stems):
            stems[stem] = min(odds["^" + stem], 6) / 4
    weight = lambda word: max([exact.get(word, 0), *(w for s, w in stems.items() if word.startswith(s))])

    def features(text):
        got = brute_clauses(text, {}, weight) if text else []
        return [1.0, math.log1p(sum(got)), max(got), 100 * len(got) / (text.count(" ") + text.count("\n") + 1)] if got else [1.0, 0.0, 0.0, 0.0]

    x, y, b = np.array([features(t) for *_, t in learned]), np.array([float(t) for _, t, _ in learned]), np.zeros(4)
    ridge = np.diag(np.sqrt([1e-6, 1, 1, 1]))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ b)))
        w = np.sqrt(p * (1 - p))
        b = np.linalg.lstsq(np.vstack((x * w[:, None], ridge)), np.concatenate(((x @ b) * w + (y - p) / w, np.zeros(4))), rcond=None)[0]
    return {d: 1 / (1 + math.exp(-float(np.dot(b, features(t))))) for d, t, *_ in rows}


def test_whole_toxicity_against_brute_force(spark):
    """Terms, stems, weights, clauses, fit and scores, all together."""
    rows, labels = toxic_rows(500)
    r = random.Random(5)
    odd = ["You {}, stop", "she said {} again", "not {} at all", "you are not {}! Kill you", "{}. {}\n{}", "THEM {}s; fine"]
    rows = [(d, t + " " + (r.choice(odd).replace("{}", r.choice(["grobbelfang", "river", "idiot", "grobbelzap", "lamp"])) if r.random() < 0.5 else ""), *x) for d, t, *x in rows]
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "grobbelfangs you grobbelfang", "en", "s", 0)]
    labels += [(3, None, 1), (4, None, None), (9000, 1, 0), (77777, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {x.doc_id: x for x in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute_toxicity(rows, labels)
    assert len({round(v, 6) for v in want.values()}) > 20
    for d, p in want.items():
        assert got[d].score == pytest.approx(p, abs=1e-6), d
        assert got[d].predicted == int(got[d].score >= 0.5)


@pytest.mark.parametrize("n", [3, 300, 500, 20_000])
def test_clause_of_any_length(n):
    s = toxicity.Scorer({"idiot": 1.0}, {})
    assert s.features("a. you " + "word " * n + "idiot " + "word " * n + "idiot, fine")[1] == pytest.approx(3.0)


def test_entropy(spark, docs, clashing, nothing):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 2
        w = [f"{'g' if good else 'b'}{r.randrange(40)}" for _ in range(40)]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, good, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in entropy.cross_entropy_difference(df, lab).collect()}
    unseen = [i for i in range(300) if i % 3 == 0]
    assert max(got[i] for i in unseen if i % 2) < min(got[i] for i in unseen if not i % 2)
    out = entropy.cross_entropy_difference(docs, lab)
    assert out.count() == docs.count() and out.where("n_words = 0 and score is not null or n_words > 0 and score is null").count() == 0
    assert same(out, entropy.cross_entropy_difference(clashing, lab))
    assert entropy.cross_entropy_difference(nothing, lab).count() == 0 and entropy.cross_entropy_difference(docs, lab.limit(0)).count() == docs.count()


def test_entropy_counts_real_words_and_bigrams(spark):
    """As by models of the other texts alone, made with dictionaries, however small the parameters: no word or bigram shares a count with another."""
    r = random.Random(9)
    how = entropy.Entropy(16, 8)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, own boolean").repartition(3)
    words = [t.split() for t in texts]
    size = len({w for t in words for w in t})
    got = {x.doc_id: x for x in entropy.scores(df, entropy.fit(entropy.counts(df, how), how), how).collect()}

    def loss(i, rest):
        total = sum(map(len, rest))
        one, two, first = Counter(), Counter(), Counter()
        for t in rest:
            one.update(t), two.update(zip(t, t[1:])), first.update(t[:-1])  # noqa: B905
        out = []
        for j, w in enumerate(words[i]):
            p = one[w] / total
            before = words[i][j - 1] if j else None
            out.append(-math.log(0.4 * p + 0.5 * (two[before, w] / first[before] if first[before] else p) + 0.1 / size))
        return sum(out) / len(out)

    for i in range(60):
        target, background = [t for j, t in enumerate(words) if j % 3 == 0 and j != i], [t for j, t in enumerate(words) if j != i]
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx((loss(i, target), loss(i, background)))
    assert same(entropy.flagged(df.drop("own"), df.selectExpr("doc_id", "cast(own as int) as quality")), entropy.flagged(df.drop("own"), df.selectExpr("doc_id", "cast(own as int) as quality"), entropy.Entropy(sent_ids=1)))
