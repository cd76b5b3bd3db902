"""Line dedup, fingerprints and quality rules against plain Python."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm.fingerprint import edited_fingerprints, fingerprints
from gridloom.llm.lines import apply_line_marks, line_marks
from gridloom.llm.rules import RULES, binomial_cdf, calibrate, certified, quality_rules, text_statistics

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, n_words int, h1 string, first string, pos int"


def sample(n=80, seed=3):
    rng = random.Random(seed)
    lines = ["The same line here", " the SAME line here\t", "short", "", "ÉCOLE publique du nord", "École publique du nord", "x" * 30] + ["own line %d of many" % i for i in range(40)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in rng.sample(range(1000), n)]
    docs += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "The same line here\n" * 300), (None, "The same line here"), (None, None), (2004, "a b c a b c a b c"), (2005, "ａ\xa0Ｂ  c 😀")]
    docs += [docs[0], docs[0], (docs[1][0], "another text\nThe same line here")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in docs], SCHEMA)


def plain_lines(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    first = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = x.strip(WS).translate(low)
            if i is not None and len(k) >= 10:
                first.setdefault(k, set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(first.get(k := x.strip(WS).translate(low), ())) < 2 or min(first[k]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return Counter(out)


@pytest.mark.parametrize("heavy", [1000, 10])
def test_line_dedup(spark, monkeypatch, heavy):
    monkeypatch.setattr("gridloom.llm.lines.HEAVY", heavy)
    docs = sample()
    df = frame(spark, docs)
    got = Counter(map(tuple, apply_line_marks(df, line_marks(df)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()))
    assert got == plain_lines(docs)


def test_line_dedup_empty(spark):
    df = frame(spark, [])
    assert apply_line_marks(df, line_marks(df)).count() == 0


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"[\s\x85  ]+", " ", t).strip(" ")


def test_fingerprints(spark):
    docs = sample() + [(3000, "Ａ Straße"), (3001, "a STRASSE "), (3002, "été"), (3003, "ÉTÉ")]
    got = fingerprints(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    byid = {}
    for r in got:
        byid.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert byid[3000] == byid[3001] and byid[3002] == byid[3003] and byid[2000] == byid[2001]
    assert len({r["fingerprint"] for r in got}) == len({canon(t) for _, t in docs})


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr("gridloom.llm.fingerprint.wide_hash", lambda c: (F.char_length(c).cast("bigint"), F.lit(1).cast("bigint")))
    docs = [(1, "abc"), (2, "ABC"), (3, "abd"), (4, "x")]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(frame(spark, docs)).collect()}
    assert got[1] == got[2] != got[3] and len(set(got.values())) == 3


def test_edited_texts(spark):
    docs = [d for d in sample() if d[0] is not None]
    docs = list({i: (i, t) for i, t in docs}.values()) + [(5000, "é😀x"), (5001, "é"), (5002, "ab" * 4000)]
    want = {}
    order = sorted(docs)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + after[:h]
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(after) == canon(t)))
    got = edited_fingerprints(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got} == want
    assert len(got) == len(docs)
    assert edited_fingerprints(frame(spark, [])).count() == 0
    assert edited_fingerprints(frame(spark, [(1, "abcd")])).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert edited_fingerprints(frame(spark, sample())).count() == len(sample())


def test_edited_texts_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr("gridloom.llm.fingerprint.wide_hash", lambda c: (F.char_length(c).cast("bigint"), F.lit(1).cast("bigint")))
    docs = [(1, "abcd"), (2, "xyzw"), (3, "abxy"), (4, "pqrstu"), (5, "pqrstu"), (None, "nothing"), (None, None), (6, "lone text here")]
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = {}
    for k, (_, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want[k] = (t, e, float(e == t), float(after == t))
    got = edited_fingerprints(frame(spark, docs)).collect()
    sha = lambda e: hashlib.sha256(e.encode()).hexdigest()
    assert Counter((r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == Counter((sha(e), a, b) for _, e, a, b in want.values())
    own = {r["doc_id"]: r["fingerprint"] for r in got}
    edited = {r["doc_id"]: r["edited_fingerprint"] for r in got}
    assert edited[1] == own[3] != own[1] and own[4] == own[5] != own[6] and edited[4] != own[4] and len({own[k] for k in (1, 2, 3)}) == 3
    assert len({*own.values(), *edited.values()} - {own[None], edited[None]}) == len({x for (i, _), (t, e, _, _) in zip(order, want.values(), strict=True) if i is not None for x in (t, e)})


def plain_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if x.strip(WS):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


@pytest.mark.parametrize("bits", [21, 3])
def test_statistics(spark, monkeypatch, bits):
    monkeypatch.setattr("gridloom.llm.rules._BITS", bits)
    monkeypatch.setattr("gridloom.llm.rules._MASK", (1 << bits) - 1)
    rng = random.Random(5)
    docs = sample() + [(6000 + k, " ".join(rng.choice("ab|cd é#") for _ in range(rng.randint(0, 60)))) for k in range(40)]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r["doc_id"], *(r[c] for c in cols)) for r in text_statistics(frame(spark, docs)).collect())
    assert got == Counter((i, *plain_stats(t)) for i, t in docs)


def test_colliding_windows(spark, monkeypatch):
    # no bits of hash are left, so all windows collide and are told apart by their words
    monkeypatch.setattr("gridloom.llm.rules._BITS", 62)
    monkeypatch.setattr("gridloom.llm.rules._MASK", (1 << 62) - 1)
    texts = ["a b c d a b c", "a b c d e f g", "a a a a", "q w e r t y q w e z w e r"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in text_statistics(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {k: plain_stats(t)[4] for k, t in enumerate(texts)}


def test_binomial_bound():
    from math import comb

    rng = random.Random(5)
    for n in (1, 2, 7, 40, 300, 900):
        for x in sorted({0, 1, n // 3, n - 1, n, rng.randint(0, n)}):
            for p in (0.001, 0.02, 0.3, 0.77):
                want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
                assert binomial_cdf(x, n, p) == pytest.approx(want, rel=1e-9, abs=1e-12), (x, n, p)
    assert certified(0, 203, 0.02, 0.05 / 3) and not certified(0, 202, 0.02, 0.05 / 3)
    assert not certified(0, 0, 0.02, 0.05) and certified(10**7, 10**9, 0.02, 0.01) and not certified(3 * 10**7, 10**9, 0.02, 0.01)


def plain_cutoffs(rows, quality, risk, delta, price):
    """The cutoffs, with one document at a time and the bound by bisection of whole sums."""
    from math import comb

    value = {
        "symbols": lambda r: r["n_symbols"] / max(r["word_chars"], 1),
        "upper": lambda r: r["n_upper"] / max(r["word_chars"], 1),
        "marks": lambda r: r["n_marks"] / max(r["n_words"], 1),
        "doubled_words": lambda r: r["n_doubled"] / max(r["n_words"], 1),
        "repeated_words": lambda r: r["n_repeat_words"] / max(r["n_words"], 1),
        "repeated_lines": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1),
        "long_words": lambda r: r["word_chars"] / max(r["n_words"], 1),
    }
    out = {}
    for stratum in range(3):
        docs = [
            r for r in rows
            if quality.get(r["doc_id"]) is not None and not (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            and stratum == (r["n_words"] >= 200) + (r["n_words"] >= 1000)
        ]
        held = [r for r in docs if zlib.crc32(f"rules{r['doc_id']}".encode()) % 4]
        rest = [r for r in docs if not zlib.crc32(f"rules{r['doc_id']}".encode()) % 4]
        chosen = {}
        while True:
            best = None
            for name, (_, cuts) in RULES.items():
                for k, c in enumerate(cuts):
                    gain = sum((1 if quality[r["doc_id"]] == 0 else -price) for r in rest if value[name](r) > c)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, name, k)
            if best is None:
                break
            _, name, k = best
            chosen[name] = k
            rest = [r for r in rest if not value[name](r) > RULES[name][1][k]]
            good = [r for r in held if quality[r["doc_id"]] == 1]
            lost = sum(any(value[m](r) > RULES[m][1][j] for m, j in chosen.items()) for r in good)
            n = len(good)
            if n == 0 or lost > risk * n or sum(comb(n, x) * risk**x * (1 - risk) ** (n - x) for x in range(lost + 1)) > delta / 3:
                del chosen[name]
                if (stratum, name) in out:
                    chosen[name] = out[stratum, name]
                break
            out |= {(stratum, m): j for m, j in chosen.items()}
    return {key: RULES[key[1]][1][j] for key, j in out.items()}


@pytest.mark.parametrize("seed, risk", [(1, 0.05), (2, 0.1), (3, 0.02)])
def test_cutoffs_are_those_of_the_plain_search(spark, seed, risk):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        bad, n = rng.random() < 0.3, rng.choice([60, 150, 400, 1500])
        much = lambda p: int(n * rng.random() ** 3 * (0.6 if bad and rng.random() < p else 0.05))  # noqa: E731, B023
        rows.append((i, n, n * rng.randint(3, 9), much(0.5), rng.randint(0, 4), min(much(0.3), n // 3), rng.randint(4, 9), much(0.2), much(0.4), much(0.3), int(bad)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_doubled", "bad"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))
    labels = df.where("doc_id % 7 <> 0").selectExpr("doc_id", "CAST(1 - bad AS INT) AS quality")
    found = calibrate(df.drop("bad"), labels, risk).by
    assert found == plain_cutoffs([dict(zip(names, r, strict=True)) for r in rows], {r[0]: 1 - r[-1] for r in rows if r[0] % 7}, risk, 0.05, 20.0)
    assert found


def test_rules_are_certified(spark):
    rng = random.Random(1)
    good = [(i, " ".join("w%d" % rng.randint(0, 10**6) for _ in range(80))) for i in range(2500)]
    bad = [(i, " ".join("w%d***" % rng.randint(0, 10**6) for _ in range(80))) for i in range(2500, 2700)]
    df = frame(spark, good + bad + [(9999, None), (None, "x")])
    labels = spark.createDataFrame([(i, int(i < 2500)) for i in range(2700)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(df, labels).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad) and not got[9999]
    few = labels.where("doc_id % 100 = 0")
    assert not calibrate(text_statistics(df), few).by
    assert quality_rules(frame(spark, []), labels).count() == 0
    assert quality_rules(df, labels.limit(0)).where("kept").count() == 2700
