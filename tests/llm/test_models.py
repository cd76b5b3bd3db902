"""The quality classifier and sequence packing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm.classifier import FEATURES, features, fit, quality_scores
from gridloom.llm.packing import WordEncoder, _blocked, _places, _Search, best_fit, bin_completion, pack_documents

SCHEMA = "doc_id bigint, text string, quality int, length int, n_words string"


def docs_and_labels(spark, n=900):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 200))]
        bad = i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x + "***" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad)))
    frame = spark.createDataFrame([(i, t, 0, 1, "x") for i, t in docs], SCHEMA)
    return frame, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_classifier_on_held_out_rows(spark):
    df, labels = docs_and_labels(spark)
    got = quality_scores(df, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len(out) > 100 and sum(r["predicted"] == r["quality"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_classifier_density_is_gaussian(spark):
    df, labels = docs_and_labels(spark, 200)
    rows = features(df).join(labels, "doc_id").cache()
    model = fit(rows)
    data = rows.toPandas()
    x = data[list(FEATURES)].to_numpy()
    logs = []
    for k in range(2):
        mine = x[data["quality"] == k]
        pooled = sum(np.cov(x[data["quality"] == j].T, ddof=0) * (data["quality"] == j).mean() for j in range(2))
        cov = 0.9 * (np.cov(mine.T, ddof=0) + 1e-9 * np.eye(len(FEATURES))) + 0.1 * np.diag(np.diag(pooled) + 1e-9 + 1e-4)
        d = x - mine.mean(0)
        logs.append(np.log(len(mine)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))
    got = rows.select("doc_id", model.score().alias("score")).toPandas().set_index("doc_id").loc[data["doc_id"], "score"]
    assert np.allclose(got, want, atol=1e-6)


def test_classifier_edge_cases(spark):
    df, labels = docs_and_labels(spark, 100)
    odd = spark.createDataFrame([(None, "x", 1, 1, ""), (5000, None, 1, 1, ""), (5001, "", 1, 1, ""), (5002, "word " * 50000, 1, 1, ""), (5001, "", 1, 1, "")], SCHEMA)
    got = quality_scores(df.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id bigint, quality int"))).collect()
    assert len(got) == 105 and all(r["score"] is not None and r["held_out"] is not None for r in got)
    assert {r["score"] for r in quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_scores(df, labels.where("quality = 1")).collect()} == {1.0}
    assert quality_scores(df.limit(0), labels).count() == 0


def fewest(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, size - items[i]])

    go(0, [])
    return best[0]


def test_plan_is_least():
    rng = random.Random(7)
    for _ in range(150):
        size = rng.choice([20, 50, 100])
        items = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 11)))
        plan, got = bin_completion(items, size), Counter()
        for pattern, n in plan:
            assert sum(pattern) <= size
            for x in pattern:
                got[x] += n
        assert got == items
        assert sum(n for _, n in plan) == fewest(list(items.elements()), size)
        assert sum(n for _, n in best_fit(items, size)) >= sum(n for _, n in plan)
    assert bin_completion({}, 9) == []


def test_plan_of_many():
    lengths = np.minimum(2047, np.random.default_rng(1).lognormal(6.5, 1, 200_000).astype(int) + 1)
    plan = bin_completion(Counter(lengths.tolist()), 2048)
    assert sum(n for _, n in plan) <= 1.001 * lengths.sum() / 2048 and len(plan) < 10_000


def test_places_by_blocks_of_ranks():
    rng = random.Random(9)
    plan = [((100, *[7] * rng.randint(1, 5)), rng.choice([1, 1, 1, 400])) for _ in range(300)]
    places = _places(plan)
    width, blocked = _blocked(places)
    for length in (100, 7):
        n = max(p[2] for p in places if p[0] == length)
        compared, of = 0, [b for b in blocked if b[0] == length]
        for rank in range(0, n, 97):
            assert sum(b[1] == rank // width[length] and b[2] <= rank < b[3] for b in of) == 1
        for block in {b[1] for b in of}:
            compared += sum(b[1] == block for b in of) * min(width[length], n - block * width[length])
        assert compared <= 3 * n and len(of) <= 2 * sum(p[0] == length for p in places)
    assert _blocked([]) == ({}, [])


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(spark, size):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rng = random.Random(3)
    al = "abc THE the 'sll're \t\n\r\x0b\x1c\x85\xa0 éñß漢😀0123.,!?<|endoftext|>_́Σς"
    docs = [(i, "".join(rng.choice(al) for _ in range(rng.randint(0, 400)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "word <|startoftext|> " * 3000), (None, "a b"), docs[0], docs[0]]
    df = spark.createDataFrame([(i, t, 0, 1, "x") for i, t in docs], SCHEMA)
    got = pack_documents(df, path, size=size, keep_ids=True).collect()
    want = Counter()
    for i, t in docs:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), size)):
            part = ids[s : s + size]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // size) + max(2, 0.02 * total / size)
    assert pack_documents(df.limit(0), path).count() == 0


def test_triplets_fill_their_bins():
    """Lengths made as 20 triples that fill a bin exactly: 20 bins are enough, best fit needs more."""
    rng = random.Random(3)
    best, solved = 0, 0
    for _ in range(25):
        items = Counter()
        for _ in range(20):
            a = rng.randint(380, 490)
            b = rng.randint(250, (1000 - a) // 2)
            items.update([a, b, 1000 - a - b])
        plan, got = bin_completion(items, 1000), Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 1000
            got.update(list(pattern) * n)
        assert got == items
        best += sum(n for _, n in best_fit(items, 1000)) > 20
        solved += sum(n for _, n in plan) == 20
    assert best == 25 and solved >= 24, (best, solved)


def test_a_search_that_ends_by_itself_is_optimal():
    rng = random.Random(11)
    ended = 0
    for _ in range(150):
        size = rng.randint(10, 40)
        items = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 12)))
        search = _Search(items, size, 100_000, 10_000_000)
        bins = sum(n for _, n in search.run())
        ended += not search.cut
        assert search.cut or bins == fewest(list(items.elements()), size)
    assert ended == 150


def test_word_encoder_merges_plain_chunks_as_the_library_does(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    signs = [chr(c) for c in [*range(33, 127), *range(0xA0, 0x250), 0x301, 0x3B1, 0x660, 0x2028, 0x212A, 0]] + ["'s", "'ll", "<|endoftext|>", "<|", "</w>"]
    plain = ["".join(rng.choice("abcdeinorst\xe9\xdf") for _ in range(rng.randint(1, 60))) + rng.choice(["", ".", ",&&", "7", "'s"]) for _ in range(400)]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    texts = [" ".join(x[k::20]) for x in (plain, odd) for k in range(20)]
    ours, library, asked = WordEncoder(path), Tokenizer.from_file(path), []
    known = ours._library
    monkeypatch.setattr(ours, "_library", lambda chunks: asked.extend(chunks) or known(chunks))
    for _ in range(2):
        got = ours.encode_batch([t.encode() for t in texts])
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 2000 and not set(plain) & set(asked)
