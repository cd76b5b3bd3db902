"""Language identification: held-out accuracy and a plain version."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import language
from gridloom.llm.language import buckets_for, fit, gram_counts, identify, pieces, windows

SCHEMA = "doc_id bigint, text string, lang string, score string, held_out int"
SYLLABLES = {"aa": "ka to mi ru sen do ki ra ne", "bb": "sch ung ver ein cht der pf keit", "cc": "tion eau oue ment que ré ç"}


def made(rng, n=900):
    rows = []
    for i in range(n):
        lang = ("aa", "aa", "bb", "cc")[i % 4]
        s = SYLLABLES[lang].split()
        rows.append((i, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 60))), lang, "x", 1))
    return rows


def test_held_out_accuracy(spark):
    rows = made(random.Random(1))
    truth = {r[0]: r[2] for r in rows}
    got = identify(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len(out) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)
    # Languages of held-out rows are never looked at.
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, x, y) for i, t, lang, x, y in rows]
    again = identify(spark.createDataFrame(other, SCHEMA)).collect()
    assert {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in again} == {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got}


def grams(text, bits):
    """Buckets of the 1-, 2- and 3-grams of a text with two blanks before and after, each place by itself."""
    s = "\0\0" + text.lower() + "\0\0"
    out = Counter()
    for i in range(len(s) - 2):
        for h in windows(np.array([ord(c) for c in s[i : i + 3]], np.uint32), bits):
            out[int(h[0])] += 1
    return out


@pytest.mark.parametrize("step", [1 << 19, 300])
def test_equals_plain_bayes(spark, monkeypatch, step):
    rng = random.Random(2)
    rows = made(rng, 60) + [(1000, "ka " * 900, "aa", "x", 1), (1001, "", "bb", "x", 1), (1002, "İŞ\U0001f600 x", "cc", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit(df.select("text", "lang"))
    bits = model.bits
    totals, docs = {}, Counter(r[2] for r in rows)
    for r in rows:
        totals.setdefault(r[2], Counter()).update(grams(r[1], bits))
    for k, lang in enumerate(model.languages):
        n = sum(totals[lang].values()) + 0.5 * 2**bits
        want = np.log(np.array([totals[lang][b] + 0.5 for b in range(2**bits)]) / n)
        assert np.allclose(model.log_prob[:, k], want)
    monkeypatch.setattr(language, "WINDOWS", step)
    p = model.posterior([r[1] for r in rows])
    for k, r in enumerate(rows):
        logs = np.array([np.log(docs[x] / len(rows)) for x in model.languages]) + sum(n * model.log_prob[b] for b, n in grams(r[1], bits).items())
        want = np.exp(logs - logs.max())
        assert np.allclose(p[k], want / want.sum(), atol=1e-7)


def test_pieces_cover_each_place_once():
    texts = ["abc", None, "", "x" * 1000, "\U0001f600é", "y" * 50]
    for most in (4, 37, 300, 5000):
        seen = Counter()
        for points, rows, starts in pieces(texts, most):
            for r, lo, hi in zip(rows, starts, [*starts[1:], len(points) - 2]):
                seen[int(r)] += int(hi - lo)
        assert seen == {k: len(t or "") + 2 for k, t in enumerate(texts)}


def test_edge_cases(spark):
    rows = [(1, None, "aa", "x", 1), (2, "12 !? \n", "aa", "x", 1), (3, "", "aa", "x", 1), (None, "ka to mi", "bb", "x", 1), (None, None, None, None, None)]
    rows += made(random.Random(3), 40) + made(random.Random(3), 40) + [(7, "ka " * 200_000, "aa", "x", 1), (8, "ka", None, "x", 1)]
    got = identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["held_out"] is False
    by = Counter(r["lang_pred"] for r in got if r["score"] == 0.0)
    assert by == {"und": 4}
    alone = identify(spark.createDataFrame([(None, "abc", "aa", "x", 1), (1, "abc", None, "x", 1)], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("und", 0.0)}
    assert identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_languages_have_fewer_buckets(spark):
    assert buckets_for(4) == 16 and buckets_for(1000) == 15 and buckets_for(10**9) == 6
    rows = [(i, f"word{i} {i}", f"l{i % 90}", "x", 1) for i in range(300)]
    got = gram_counts(spark.createDataFrame(rows, SCHEMA).select("text", "lang"), 8, most_languages=7)
    want = {}
    for r in rows:
        want.setdefault(r[2], Counter()).update(grams(r[1], 8))
    assert {(r["lang"], r["bucket"]): r["n"] for r in got.collect()} == {(lang, b): n for lang, c in want.items() for b, n in c.items()}
