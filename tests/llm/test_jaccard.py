"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import jaccard
from gridloom.llm.jaccard import Shingles, _near, bitmap, components, jaccard_groups, least_shared, merged, most_shared, prefix_keys, token_counts

SCHEMA = "doc_id bigint, text string, key string, node int, n int"


def plain(docs, k=5, percent=75):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    # rows that repeat an id are joined by what their texts link to, not by the id
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(sets[a]), least[find(a)] if i is not None else None) for a, (i, _) in enumerate(docs))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 3000)
    passage = [word() for _ in range(25)]
    docs, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))]
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word().upper()
            docs.append((n, "\t ".join(w) if rng.random() < 0.5 else " ".join(w)))
            n += rng.randint(1, 5)
    docs += [(9000 + k, " ".join(passage + [word() for _ in range(rng.randint(4, 12))])) for k in range(25)]
    rng.shuffle(docs)
    return docs + [(8000, None), (8001, ""), (8002, " \n"), (8003, "A b"), (8004, "a B"), (8005, "a b c"), (None, "a b"), (None, None), docs[0], (docs[1][0], "quite another text that is here alone")]


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"frequent_from": 4, "short": 3}), (3, {"frequent_from": 2, "short": 2}), (4, {"frequent_from": 3, "short": 1}), (5, {"frequent_from": 1})])
def test_groups(spark, seed, settings):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(3)
    got = Counter(map(tuple, jaccard_groups(df, **settings).collect()))
    want = plain(docs)
    assert got == want
    assert jaccard_groups(df.limit(0)).count() == 0


def test_prefixes_meet():
    rng = np.random.default_rng(0)
    for trial in range(4000):
        n = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        drop = rng.random(len(b)) > rng.uniform(0.8, 1)
        b = np.unique(np.concatenate([b[~drop], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if not len(b) or 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        assert shared >= max(least_shared(len(a), 75), least_shared(len(b), 75))
        frequent = np.sort(rng.permutation(np.union1d(a, b))[: int(rng.integers(0, 90))])
        keys = []
        for s in (a, b):
            counts = np.isin(s, frequent) * (8 + (s % np.uint64(500)).astype(np.int64))
            k, often, most, rare = prefix_keys(s, counts, 75)
            assert len(k) == len(often) == len(most) and len(k) <= 4 * len(s) + 8
            meta = (often.astype(np.int64) << 61) | (rare << 31) | len(s)
            keys.append(dict(zip(k.tolist(), meta.tolist())))
        both = keys[0].keys() & keys[1].keys()
        assert any(_near(np.array([keys[0][k]]), np.array([keys[1][k]]), 75)[0] for k in both), trial


def test_labels_are_merged(spark):
    rng = random.Random(8)
    old = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)]
    new = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(15)]
    links = lambda e: spark.createDataFrame([p for p in e if p[0] != p[1]], "a bigint, b bigint")
    pairs = lambda d: {r["node"]: r["label"] for r in d.collect()}
    got = pairs(merged(spark, components(spark, links(old)), links(new)))
    want = pairs(components(spark, links(old + new)))
    assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["label"] for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 2**20, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(2654435761)) for _ in range(2))
        b = np.union1d(b, a[: int(rng.integers(0, len(a) + 1))])
        assert most_shared(len(a), len(b), bitmap(a), bitmap(b)) >= len(np.intersect1d(a, b))


def test_windows_are_those_of_each_text_alone():
    texts = [b"", b"a b c d e f g", b"x", b"A b c d e", b" \n", b"p q r s", b"a b a b a b a b", b"u v w x y z"]
    together = Shingles().sets(texts)
    for t, s in zip(texts, together, strict=True):
        w = t.lower().split()
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1))
        assert np.array_equal(s, Shingles().sets([t])[0])


def test_counts_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUFFER", 50)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["k l m n o p"]
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(3)
    got = sorted(r["n"] for r in token_counts(rows, 5, 0, 4, 3).collect())
    want = Counter(tuple(w[i : i + min(5, len(w))]) for w in map(str.split, texts) for i in range(max(len(w) - 4, min(len(w), 1))))
    assert got == sorted(n for n in want.values() if n >= 3)


def test_split_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 5)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "PROBES_LINK", 0)
    monkeypatch.setattr(jaccard, "PAIRS_A_LIST", 4)
    docs = corpus(6)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(3)
    assert Counter(map(tuple, jaccard_groups(df, frequent_from=3, short=2).collect())) == plain(docs)


def test_a_very_long_text_and_many_copies(spark):
    rng = random.Random(3)
    long = " ".join("w%d" % rng.randint(0, 10**6) for _ in range(150_000))
    docs = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, long[: len(long) // 2])] + [(k, "one and the same text of several words") for k in range(10, 400)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4} | dict.fromkeys(range(10, 400), 10)


def test_leaders_meet_lists_and_not_each_group_of_them(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sets = {n: np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for n in range(50)}
    sets[50] = np.append(sets[7][:-1], np.uint64(5))  # the one pair that may link
    entries = [(key, n, len(s)) for key in range(6) for n, s in sets.items()]
    long = spark.createDataFrame(entries, "key bigint, node bigint, meta bigint")
    small = spark.createDataFrame([(n, len(s).to_bytes(8, "little") + bitmap(s)) for n, s in sets.items()], "node bigint, small binary")
    labels = spark.createDataFrame([(3, 2), (2, 2), (4, 2)], "node bigint, label bigint")
    sent, real = [], jaccard.met_in_blocks
    monkeypatch.setattr(jaccard, "met_in_blocks", lambda a, b, *rest: sent.append(a.count() + b.count()) or real(a, b, *rest))
    pairs, left = jaccard._residual(long, labels, small, 75, 0)
    assert [tuple(r) for r in pairs.collect()] == [(7, 50)]
    assert left.count() == 6 * 3  # all but the largest group have led
    assert sent[0] <= 3 * len(entries)  # before: a row for each leader and group that it shares a list with


def test_words_are_hashed_as_arrays(monkeypatch):
    one_by_one, real = [], jaccard.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", lambda word, seed: one_by_one.append(word) or real(word, seed))
    rng = random.Random(5)
    word = lambda n: bytes(rng.choice(b"aZ\x00\x08\x0e\x1f\x7f\x85\xa0\xff") for _ in range(n))
    words = [word(n) for n in (1, 2, 7, 8, 9, 15, 16, 17, 24, 63, 64, 65, 200) for _ in range(20)]
    texts = [b"".join(rng.choice(words) + rng.choice([b" ", b"\n", b"\t\x0b", b"\r\x0c "]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [b"", b" \n", b"A", b" b"]
    jaccard.Shingles().sets(texts)
    assert {len(w) for w in one_by_one} == {65, 200}  # before: every word
    h, n = jaccard.word_hashes(texts, 3)
    split = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in split]
    known = {}
    for w, x in zip((w for t in split for w in t), h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    assert not set(known.values()) & set(jaccard.word_hashes(texts, 4)[0].tolist())
    assert jaccard.word_hashes([], 0)[0].tolist() == []
