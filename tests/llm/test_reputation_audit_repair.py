import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import same, words_of
from pyspark.sql import functions as F

from kinweave.llm import conversation_repair as repair
from kinweave.llm import filter_audit as audit
from kinweave.llm import host_reputation as rep

# ---- host reputation -----------------------------------------------------------

PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def pages():
    r = random.Random(3)
    hosts = ["a.good.com", "b.good.com", "WWW.Example.com", "example.com", "x.example.com", "spam.bad.net", "ham.bad.net", "deep.er.bad.net", "shop.co.uk", "my.shop.co.uk", "10.0.0.1", "localhost", "u:p@site.org:8080", "notexample.com", "net", "[::1]:80"]
    paths = ["", "/", "/en/1", "/en", "/es/2?x=/en/", "/fr/", "/de/a#b", "/EN/", "?q=://x", "#/en/"]
    rows = [(i, f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}{r.choice(paths)}", "") for i in range(400)]
    rows += [(i, f"http://spam.bad.net/p{i}", None) for i in range(400, 600)]  # a third of all pages
    rows += [(600, None, "x"), (601, "", "x"), (602, "no scheme.com/en/", "x"), (603, "://", None), (604, "a://b://c.com/", ""), (None, "http://example.com/en/", ""), (None, None, None), (5, rows[5][1], "again"), (605, "http://" + "h" * 100_000 + ".com/" + "p" * 100_000, "")]
    return rows


@pytest.fixture(scope="module")
def page_labels(pages):
    r = random.Random(4)
    out = [(p[0], r.choice([0, 1, 1, 1]), 0) for p in pages if p[0] is not None and r.random() < 0.4]
    out += [(i, 0, r.choice([0, 1])) for i in range(400, 560)]
    return out + [(None, 0, 1), (7, None, None), (8, 1, None), (8, None, 1), (99999, 0, 0)]


def brute_places(host):
    name = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))
    labels = name.split(".")
    if re.fullmatch(r"[0-9.]+", name) or name.startswith("[") or len(labels) < 2:
        return name, name, ""
    k = 2 if ".".join(labels[-2:]) in rep.Reputation().suffixes else 1
    return name, ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def brute_judged(pages, labels):
    how, out, seen = rep.Reputation(), [], {}
    for d, q, t in labels:
        if d is not None and (q is not None or t is not None):
            seen[d] = seen.get(d, False) or q == 0 or t == 1
    counts, domain, suffix = {}, {}, {}
    parsed = []
    for i, url, _ in pages:
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        parsed.append((i, host, path))
        name, d, s = brute_places(host)
        domain[name], suffix[d] = d, s
        n, k = counts.get(name, (0, 0))
        counts[name] = (n + (i in seen), k + bool(seen.get(i)))

    def up(children, parent):
        total = {}
        for c, (n, k) in children.items():
            a, b = total.get(parent[c], (0, 0))
            total[parent[c]] = (a + n, b + k)
        return total

    def weight(children, parent):
        excess = most = 0.0
        for p, (n, k) in up(children, parent).items():
            own = [children[c] for c in children if parent[c] == p and children[c][0]]
            if n:
                m = k / n
                v = m * (1 - m)
                excess += sum(x * (y / x - m) ** 2 for x, y in own) - v * (len(own) - 1)
                most += v * (n - sum(x * x for x, _ in own) / n - (len(own) - 1))
        rho = min(max(excess / most if most > 1e-12 else how.rho_unknown, how.rho_least), how.rho_most)
        return (1 - rho) / rho

    domains = up(counts, domain)
    suffixes = up(domains, suffix)
    n, k = map(sum, zip(*suffixes.values(), strict=True))
    rate = (k + how.base_weight * how.base_rate) / (n + how.base_weight)
    shrink = lambda prior, w, c: (w * prior + c[1]) / (w + c[0])
    ws, wd, wh = weight(suffixes, dict.fromkeys(suffixes, 0)), weight(domains, suffix), weight(counts, domain)
    sr = {s: shrink(rate, ws, c) for s, c in suffixes.items()}
    dr = {d: shrink(sr[suffix[d]], wd, c) for d, c in domains.items()}
    post = {h: (wh * dr[domain[h]] + k, wh * (1 - dr[domain[h]]) + n - k) for h, (n, k) in counts.items()}
    for i, host, path in parsed:
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rep.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        a, b = post[brute_places(host)[0]]
        low = exact_low(a, b)
        out.append((i, host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "block" if low > how.max_bad else "allow"))
    return out, post


def exact_low(a, b):
    """The 5 % quantile of a beta distribution, by summing its density."""
    x = (np.arange(200_000) + 0.5) / 200_000
    logs = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    c = np.cumsum(np.exp(logs - logs.max()))
    return float(x[np.searchsorted(c, 0.05 * c[-1])])


@pytest.mark.parametrize("share", [1e-5, 0.2, 1.0])
def test_judge(spark, pages, page_labels, share):
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    labels = spark.createDataFrame(page_labels, LABELS)
    want, post = brute_judged(pages, page_labels)
    got = rep.judge(df, labels, rep.Reputation(share=share))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {"block", "allow"} == {w[4] for w in want if w[3] is None}  # the method does both
    more = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("host", "path", "name", "n", "k", "bad", "blocked", "__kw_key"))])
    assert same(rep.judge(more, labels, rep.Reputation(share=share)), got)
    if share == 1e-5:
        parsed = df.select("page_id", rep.split_url(F.col("url"))[0].alias("host"))
        for r in rep.reputations(parsed, rep.outcomes(labels)).collect():
            assert (r.a, r.b) == pytest.approx(post[r.name])


def test_judge_without_rows_or_labels(spark, pages):
    none = spark.createDataFrame([], LABELS)
    assert rep.judge(spark.createDataFrame([], PAGES), none).count() == 0
    got = rep.judge(spark.createDataFrame(pages, PAGES), none).collect()
    assert len(got) == len(pages) and all(r.verdict == "allow" for r in got if r.rule is None)


def test_bound(spark):
    pairs = [(0.3, 0.7), (1.0, 1.0), (2.5, 20.0), (20.0, 2.5), (50.0, 50.0), (300.0, 900.0)]
    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", rep.lower_bound(F.col("a"), F.col("b"), rep.Reputation().z).alias("low"), rep.digamma(F.col("a")).alias("d"))
    for r in df.collect():
        assert r.low == pytest.approx(exact_low(r.a, r.b), abs=0.025), (r.a, r.b)
        step = 1e-5
        assert r.d == pytest.approx((math.lgamma(r.a + step) - math.lgamma(r.a - step)) / (2 * step), abs=1e-5)


# ---- filter audit --------------------------------------------------------------


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, text, lang, *_ in docs:
        t = text or ""
        w = words_of(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        rows.append((lang or "", d, {f for f in fails if fails[f]}))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for i, f in enumerate(order):
                here = [r for r in left if f in r[2]]
                redundant = sum(1 for r in own if f in r[2] and r[2] & set(order[:i]))
                left = [r for r in left if f not in r[2]]
                total[f] += len(here)
                out[part, order, i + 1] = [len(left), len(here), redundant, sum(1 for r in own if r[2] == {f}), sum(1 for r in here if r[1] in good), sum(1 for r in here if r[1] in toxic)]
        for (p, order, i), x in out.items():
            if p == part:
                x.append(total[order[i - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audited(corpus):
    r = random.Random(6)
    more = [(1000 + i, r.choice(["A" * 30, "price $5 | off", "Word " * 120, "same text", corpus[0][1], None, ""]), r.choice(["en", "", None, "xx"]), "s", 1) for i in range(60)]
    return corpus + more + [more[0], more[0], (None, "same text", "en", "s", 1), (None, "same text", "xx", "s", 1), (-1, "never seen Elsewhere", "en", "s", 1), (2000, "W1 w2 " * 50_000, "en", "s", 1)]


def test_audit(spark, audited, nothing):
    labels = [(i, i % 2, i % 3) for i in range(0, 1100, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (77777, 1, 1)]
    given = spark.createDataFrame(labels, LABELS)
    df = spark.createDataFrame(audited, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = brute_audit(audited, labels)
    got = audit.filter_audit(df, given)
    rows = got.collect()
    assert len(rows) == 600 * len({a[2] or "" for a in audited})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == want
    assert got.columns[3:] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    more = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("part", "mask", "good", "toxic", "digest", "id", "least", "n", "spread"))])
    assert same(audit.filter_audit(more, given), got)
    assert audit.filter_audit(nothing, given).count() == 0
    assert audit.filter_audit(df, given.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_transform_is_inverted(spark):
    r = random.Random(1)
    rows = [(p, r.random() < 0.5, r.random() < 0.5, r.randrange(8), r.randrange(1, 1 << 40)) for p in "ab" for _ in range(30)]
    df = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long")
    for x in audit.cells(audit.parity_sums(df, 3), 3).collect():
        for label, keep in (("all", lambda t: True), ("good", lambda t: t[1]), ("toxic", lambda t: t[2])):
            assert x[label] == [sum(t[4] for t in rows if t[0] == x.part and t[3] == m and keep(t)) for m in range(8)]


# ---- conversation repair -------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
END = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_report(rows):
    """rows of one conversation, in any order: a report by trying every edit of every turn, and up to two insertions before each and at the end."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        real = END.findall(text)
        faults.append("b" if not real else "d" if (role, text) in seen else "" if real[-1] in ".!?" else "t")
        seen.add((role, text))
    fits = re.compile(r"(s?(ua)+)?\Z")
    best = {"": (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for key, (c, a, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    put(states, key + role[0], (c + 5, a + "I", (*lines, role + ":")))

    def put(states, initials, value):
        # only beginnings of (s?(ua)+)? matter, and of those what may follow
        if not re.fullmatch(r"(s?(ua)*u?)", initials):
            return
        short = initials if len(initials) < 2 else ("u" if initials[-1] == "u" else "ua")
        if short not in states or value[:2] < states[short][:2]:
            states[short] = value

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        inserted(best)
        new = {}
        for key, (c, a, lines) in best.items():
            put(new, key, (c + 2, a + "D", lines))
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                put(new, key + role[:1] if role[:1] else key + "?", (c + more, a + "K", (*lines, f"{role}:{text}")))
                for x in ("user", "assistant"):
                    put(new, key + x[0], (c + 1 + more, a + "R", (*lines, f"{x}:{text}")))
        best = new
    inserted(best)
    cost, edits, lines = min((v for k, v in best.items() if fits.match(k) and k not in ("s", "u")), key=lambda v: v[:2])
    numbers = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_repairs(rows, faults):
    """(cost, audit) of every repair with at most two insertions in a place: the definition itself, for very short conversations."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    edits = []
    for (_, _, role, _), fault in zip(rows, faults, strict=True):
        more = 5 if fault == "t" else 0
        edits.append([(2, "D", "")] + ([] if fault in ("b", "d") else [(more, "K", role[:1] or "?"), (1 + more, "R", "u"), (1 + more, "R", "a")]))
    for chosen in itertools.product(*edits):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            initials = "".join("".join(g) + e[2] for g, e in zip(ins, [*chosen, (0, "", "")], strict=True))
            if re.fullmatch(r"(s?(ua)+)?", initials):
                yield 5 * sum(map(len, ins)) + sum(e[0] for e in chosen), "".join("I" * len(g) + e[1] for g, e in zip(ins, [*chosen, (0, "", "")], strict=True))


@pytest.fixture(scope="module")
def turns():
    r = random.Random(8)
    texts = ["Yes.", "No!", "and then", "", " \n", "What?", "Done. ", "é…", None, "ok", "a\n\tb."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "uncle"]
    rows = []
    for c in range(120):
        n = r.choice([1, 2, 3, 4, 6, 9])
        rows += [(c, t if r.random() < 0.9 else r.choice([None, 1, t + 3]), r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"word{r.random()}.") for t in range(n)]
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(1500)]  # many blocks
    rows += [(501, 7, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)] + [(502, None, "user", f"T {t}") for t in range(40)]  # one number, no number
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (503, -5, "assistant", "x" * 200_000 + "."), (503, 10_000, "user", "y.")]
    return rows + rows[:3] + rows[:2]


def test_repair(spark, turns):
    df = spark.createDataFrame(turns, TURNS).repartition(4)
    want = {}
    for c in {t[0] for t in turns}:
        want[c] = brute_report([x for x in brute_damage(turns) if x[0] == c])
    got = repair.damage_and_repair(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    small, lines = repair.repair(repair.damaged(df), block_turns=3)  # blocks make no difference
    assert same(small, got)
    text = {}
    for x in sorted(lines.collect(), key=lambda x: (x.block, x.part)):
        text.setdefault(x.conv, []).extend(x.lines)
    for r in rows:
        assert hashlib.sha256("\n".join(text.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        initials = "".join(x[:1] for x in text.get(r.conv_id, []))
        assert re.fullmatch(r"(s?(ua)+)?", initials)
    more = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("conv", "block", "part", "turns", "audit", "digest", "at", "lost", "kind"))])
    assert same(repair.damage_and_repair(more), got)
    assert repair.damage_and_repair(df.limit(0)).count() == 0


def test_cheapest_of_all_repairs(spark):
    r = random.Random(9)
    rows = []
    for c in range(60):
        rows += [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", "No.", "cut", "", f"w{t}."])) for t in range(r.choice([1, 2, 3]))]
    got = {x.conv_id: x for x in repair.repair(repair.as_given(spark.createDataFrame(rows, TURNS)))[0].collect()}
    for c in range(60):
        own, seen, faults = [x for x in rows if x[0] == c], set(), []
        for x in own:
            faults.append("b" if not x[3] else "d" if x[2:] in seen else "t" if x[3] == "cut" else "")
            seen.add(x[2:])
        assert (got[c].cost, got[c].audit) == min(all_repairs(own, faults)), own


def test_all_turns_lost(spark):
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair.damage_and_repair(spark.createDataFrame(gone, TURNS)).collect()
    assert len(got) == len(gone) > 5
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
