"""N-gram Jaccard join with token-combination prefixes, and the groups it links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import blocks
from gridloom.llm.common import TEXTS_A_BATCH, written

#: At most so many tokens are called frequent, whatever the corpus (24 MB to broadcast).
MOST_FREQUENT = 1 << 21
#: A list of a frequent key that may hold more rows is split, each part having a leader of its own.
SPLIT = 200_000
#: Leaders of a long list in its first round (four times as many in each that follows), and pairs that a list may make in a round besides.
LEADERS = 32
PAIRS_A_LIST = 1 << 14
#: Probes end with the round that links at most so many pairs.
PROBES_LINK = 100
#: Tokens that a task counts before it sends them, and tokens that it counts at once.
BUFFER = 1 << 21
#: Leaders of a block that meets a block of four times as many members in one task: 4 MB of bitmaps where sets have hundreds of tokens, 64 MB at most.
BLOCK = 1 << 12
#: Pairs of leaders and members that a task lists before it tests them.
PAIRS_AT_ONCE = 1 << 19
#: Above so many ids, texts to verify are found by a shuffle and not a broadcast.
BROADCAST_ROWS = 1_000_000

#: Parts of a posting's meta.
SIZE, RARE = (1 << 31) - 1, (1 << 30) - 1

_MULTIPLIERS = np.array([2 * k + 1 for k in (0x4F1BBCDCBFA53E0A, 0x3C6EF372FE94F82B, 0x61C8864680B583EB, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: The bytes that a word's tail has in its last eight.
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 64


def word_hashes(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of ``texts`` in one array, and how many words each text has.

    Words are cut and hashed as arrays, eight bytes of each at a time; those
    of up to eight bytes have different hashes for sure, but for NUL bytes.
    """
    data = b"".join([b"\n", b"\n".join(texts).lower(), b"\n", bytes(8)])
    chars = np.frombuffer(data, np.uint8)[:-8]
    space = (chars == 32) | (chars - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    length = ends - starts
    n = np.diff(np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts]])))
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))  # the eight bytes from each place on
    h = eight[starts] & _TAILS[np.minimum(length, 8)]
    h = _mixed(h + length.astype(np.uint64) * _MULTIPLIERS[0] + np.uint64(seed * int(_MULTIPLIERS[1]) & 2**64 - 1))
    more = np.flatnonzero(length > 8)
    for done in range(8, LONG_WORD, 8):
        if not len(more):
            break
        h[more] = _mixed(h[more] * _MULTIPLIERS[2] + (eight[starts[more] + done] & _TAILS[np.minimum(length[more] - done, 8)]))
        more = more[length[more] > done + 8]
    for k in more.tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], seed)
    return h, n


class Shingles:
    """Sets of hashed ``k``-word shingles, sorted; A-Z fold to a-z and ASCII white space separates words.

    A text of fewer words is one shingle, one without words has none.
    """

    def __init__(self, k: int = 5, seed: int = 0):
        self.k, self.seed = k, seed

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all shingles of ``texts``, repeated ones too, in one array, and where each text's begin (and the end)."""
        h, n = word_hashes(texts, self.seed)
        ends = np.cumsum(n)
        k, total = self.k, len(h)
        wide = np.full(max(total - k + 1, 0), k, dtype=np.uint64)
        for i in range(k if total >= k else 0):
            wide += h[i : total - k + 1 + i] * _MULTIPLIERS[i]
        # windows that run over the end of their text are no shingles; a text of fewer words has one of its own
        whole = np.ones(len(wide), dtype=bool)
        for i in range(1, k):
            at = ends - i
            whole[at[(at >= 0) & (at < len(wide))]] = False
        starts = np.append(0, np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1))))
        few = np.flatnonzero((n > 0) & (n < k))
        out = wide[whole]
        if len(few):
            long = np.ones(starts[-1], dtype=bool)
            long[starts[few]] = False
            wide, out = out, np.zeros(starts[-1], dtype=np.uint64)
            out[long] = wide
        for at in few:
            own = h[ends[at] - n[at] : ends[at]]
            out[starts[at]] = (own * _MULTIPLIERS[: len(own)]).sum(dtype=np.uint64) + n[at : at + 1].astype(np.uint64)[0]
        return _mixed(out), starts

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        found, starts = self.windows(texts)
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            s = np.sort(found[lo:hi])
            out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
        return out


def _digest(s: np.ndarray, seed: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


def least_shared(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set that it links to."""
    return -(-n * percent // 100)


class Frequent:
    """Tokens called frequent, with their counts. A token stands as its part of the ``parts`` (a power of two) and 32 further bits."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, parts: int):
        self.codes, self.counts, self.parts = codes, counts, parts

    @staticmethod
    def code(s: np.ndarray, parts: int) -> np.ndarray:
        return (s & np.uint64(parts - 1)) << np.uint64(32) | s >> np.uint64(32)

    def of(self, s: np.ndarray) -> np.ndarray:
        """The count of each token of ``s``; 0 if it is rare."""
        if not len(self.codes):
            return np.zeros(len(s), dtype=np.int64)
        c = self.code(s, self.parts)
        at = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
        return np.where(self.codes[at] == c, self.counts[at], 0)


def prefix_keys(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Index keys of a set, which of them are of frequent tokens, the most sets that each of those may be in, and the number of rare tokens.

    Tokens are ordered rare ones first, by hash, then frequent ones by the power
    of two of their count and by hash, so that very common ones are seldom in a
    prefix. Let ``least`` be the least
    overlap of linked sets. They share one of the first p = n - least + 1 tokens
    of each, and g + 1 of the first p + g. If one of the tokens that they share
    is rare, the first such is in both prefixes, and rare tokens of a prefix are
    keys by themselves. If all are frequent, g + 1 of them are in both prefixes
    extended by g; dealt into g buckets by hash, two meet in one bucket. So the
    pairs of frequent tokens within a bucket are keys: about as many as a set
    has tokens, at any length of the prefix. ``g`` must be equal for both
    sets, so it follows from the size's power of two, and a set whose least
    partner is of the power below is indexed for that one too. A set that can
    share one token only has that as its key.
    """
    n = len(s)
    least = least_shared(n, percent)
    p = n - least + 1
    common = counts > 0
    rare, often, counts = s[~common], s[common], counts[common]
    rising = np.argsort(np.frexp(counts)[1], kind="stable")
    often, counts = often[rising], counts[rising]
    first = rare[:p]
    keys, most = [first], [np.zeros(len(first), dtype=np.int64)]
    if len(rare) < p:
        for level in sorted({n.bit_length() - 1, max(least, 1).bit_length() - 1}):
            g = min((1 << level) // 4 or 1, least_shared(1 << level, percent) - 1)
            if g < 1:
                keys.append(_mixed(often[: p - len(rare)] * _MULTIPLIERS[2] + np.uint64(level)))
                most.append(counts[: p - len(rare)])
                continue
            wide = often[: p + g - len(rare)]
            c = counts[: len(wide)]
            bucket = wide % np.uint64(g)
            order = np.argsort(bucket, kind="stable")
            wide, c, bucket = wide[order], c[order], bucket[order]
            # pairs at a distance of 1, 2, ... as long as they are in one bucket
            for d in range(1, len(wide)):
                same = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not len(same):
                    break
                keys.append(_mixed(wide[same] * _MULTIPLIERS[0] + wide[same + d] * _MULTIPLIERS[1] + np.uint64(level)))
                most.append(np.minimum(c[same], c[same + d]))
    all_ = np.concatenate(keys)
    return all_, np.arange(len(all_)) >= len(first), np.concatenate(most), len(rare)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"))


def _scan(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set) of each row."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k, seed)
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                sets = shingles.sets(texts)
                digests = [_digest(s, seed) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, len(texts)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "d1": pa.array([d[0] for d in digests], pa.int64()),
                        "d2": pa.array([d[1] for d in digests], pa.int64()),
                    }
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, d1 bigint, d2 bigint")


def _counted(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))[: len(codes)]
    return codes[starts], np.add.reduceat(weights[order], starts) if len(codes) else weights


def token_counts(rows: DataFrame, k: int, seed: int, parts: int, least: int) -> DataFrame:
    """code, n: all tokens that occur ``least`` times or more in the corpus.

    Tasks count some millions of tokens at a time and send them by part of
    the token's hash, 4 bytes for one that occurred once and 8 for others;
    a part is counted by itself. Tokens of equal parts and 32 further bits
    count as one, which costs work and no link.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, waiting = Shingles(k, seed), [], 0

        def flush() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))[: len(codes)]
            n = np.diff(np.append(starts, len(codes))).astype(np.uint32)
            codes = codes[starts]
            part, low = (codes >> np.uint64(32)).astype(np.int64), codes.astype(np.uint32)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
            once, more, which = [], [], []
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True):
                again = n[lo:hi] > 1
                once.append(low[lo:hi][~again].tobytes())
                more.append(low[lo:hi][again].tobytes() + n[lo:hi][again].tobytes())
                which.append(int(part[lo]))
            return pa.RecordBatch.from_pydict({"part": pa.array(which, pa.int64()), "once": pa.array(once, pa.binary()), "more": pa.array(more, pa.binary())})

        for batch in batches:
            for _, texts in blocks(batch.column("text")):
                found = Frequent.code(shingles.windows(texts)[0], parts)
                held.append(found)
                waiting += len(found)
                if waiting >= BUFFER:
                    yield flush()
                    held, waiting = [], 0
        if waiting:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, weights, waiting = None, [], [], 0

        def fold() -> None:
            nonlocal codes, weights, waiting
            c, n = _counted(np.concatenate(codes), np.concatenate(weights))
            codes, weights, waiting = [c], [n], 0

        def total() -> pa.RecordBatch:
            fold()
            fine = weights[0] >= least
            return pa.RecordBatch.from_pydict({"code": codes[0][fine].astype(np.int64) | (part << 32), "n": weights[0][fine]})

        for batch in batches:
            for p, once, more in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "more")), strict=True):
                if p != part:
                    if part is not None:
                        yield total()
                    part, codes, weights, waiting = p, [], [], 0
                half = len(more) // 2
                codes += [np.frombuffer(once, np.uint32), np.frombuffer(more[:half], np.uint32)]
                weights += [np.ones(len(once) // 4, np.int64), np.frombuffer(more[half:], np.uint32).astype(np.int64)]
                waiting += (len(once) + half) // 4
                if waiting > 2 * BUFFER:
                    fold()
        if part is not None:
            yield total()

    sent = rows.select("text").mapInArrow(send, "part bigint, once binary, more binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "code bigint, n bigint")


def frequent_tokens(rows: DataFrame, k: int, seed: int, tokens: int, frequent_from: int) -> Frequent:
    """The tokens of ``frequent_from`` occurrences or more; where they are over MOST_FREQUENT, those above the least power of two that keeps the bound."""
    parts = 1 << max(0, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUFFER)) - 1).bit_length()
    counts = written(token_counts(rows, k, seed, parts, frequent_from), "tokens", TEXTS_A_BATCH)
    classes = sorted(counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["c"])
    floor, room = frequent_from, MOST_FREQUENT
    for r in classes:
        room -= r["m"]
        if room < 0:
            floor = max(frequent_from, 2 << r["c"])
            break
    kept = counts.where(F.col("n") >= floor).toArrow()  # at most MOST_FREQUENT rows
    codes, n = kept.column("code").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    order = np.argsort(codes)
    return Frequent(codes[order], np.minimum(n[order], 2**31 - 1).astype(np.int32), parts)


def _postings(rows: DataFrame, frequent: Frequent, k: int, seed: int, percent: int) -> DataFrame:
    """key, salt, node, meta: the index. ``node`` is a set's digest; ``meta`` packs (list split, a key of frequent tokens, rare tokens, size)."""
    shared = rows.sparkSession.sparkContext.broadcast((frequent.codes, frequent.counts, frequent.parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, often = Shingles(k, seed), set(), Frequent(*shared.value)
        for batch in batches:
            for _, texts in blocks(batch.column("text")):
                keys, nodes, metas, salts = [], [], [], []
                sets = shingles.sets(texts)
                counts = often.of(np.concatenate([*sets, np.zeros(0, np.uint64)]))
                at = 0
                for s in sets:
                    node, c = _digest(s, seed)[0], counts[at : at + len(s)]
                    at += len(s)
                    if not len(s) or node in seen:  # equal sets of a task are indexed once
                        continue
                    seen.add(node)
                    key, pairs, most, rare = prefix_keys(s, c, percent)
                    split = most > SPLIT
                    keys.append(key)
                    nodes.append(np.full(len(key), node, dtype=np.int64))
                    salts.append(np.where(split, (node & 2**31 - 1) % (most // SPLIT + 1), 0))
                    metas.append((split.astype(np.int64) << 62) | (pairs.astype(np.int64) << 61) | (rare << 31) | len(s))
                if len(seen) > 1_000_000:
                    seen.clear()
                if keys:
                    yield pa.RecordBatch.from_pydict(
                        {"key": np.concatenate(keys).view(np.int64), "salt": np.concatenate(salts).astype(np.int32), "node": np.concatenate(nodes), "meta": np.concatenate(metas)}
                    )

    return rows.mapInArrow(run, "key bigint, salt int, node bigint, meta bigint")


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these metas may link on one list, by size.

    Sets on a key of frequent tokens have all their rare tokens as keys: a
    pair that shares one of those meets there, so here a pair shares frequent
    tokens alone, and those must be enough.
    """
    x, y = a & SIZE, b & SIZE
    ok = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    often = np.minimum(x - (a >> 31 & RARE), y - (b >> 31 & RARE))
    return ok & ((a >> 61 & 1 == 0) | (b >> 61 & 1 == 0) | ((100 + percent) * often >= percent * (x + y)))


def _candidates(postings: DataFrame, percent: int, short: int, flush_rows: int = 300_000) -> DataFrame:
    """Streams down the sorted index.

    kind 0: a pair of nodes, the first of a list with each other. kind 1: (list,
    node, meta) of lists of three or more, whose other pairs come later if
    their members are not in one group by then. Lists of up to ``short`` members
    are named by their members, so that those of many keys are one list. A list
    that is split over tasks has a leader in each part and is named by its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(0, np.int64)] * 3
        held, more, leader = nothing, [], None  # leader: key, node, meta of a long list that goes on

        def made(kind: int, a: np.ndarray, b: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": np.full(len(a), kind, np.int32), "a": a, "b": b, "meta": meta})

        def pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = _near(x, y, percent) & (a != b)
            return np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], 1)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, more, leader
            key, node, meta = (np.concatenate(x) for x in zip(held, *more, strict=True))
            held, more = nothing, []
            if not len(key):
                return
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, meta = key[fresh], node[fresh], meta[fresh]
            found = []
            if leader and key[0] == leader[0]:
                end = int(np.searchsorted(np.cumsum(key != leader[0]), 1))
                found.append(pairs(np.full(end, leader[1]), node[:end], np.full(end, leader[2]), meta[:end]))
                yield made(1, key[:end], node[:end], meta[:end])
                key, node, meta = key[end:], node[end:], meta[end:]
            if len(key):
                leader = None
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                sizes = np.diff(np.append(starts, len(key)))
                if not last and sizes[-1] <= short:  # the last list may go on
                    held = [x[starts[-1] :] for x in (key, node, meta)]
                    key, node, meta = (x[: starts[-1]] for x in (key, node, meta))
                    starts, sizes = starts[:-1], sizes[:-1]
                elif sizes[-1] > short:
                    leader = tuple(int(x[starts[-1]]) for x in (key, node, meta))
                split = meta[starts] >> 62 > 0  # a part of a list, named by its key
                at = np.repeat(starts, sizes)
                other = np.arange(len(key)) != at
                at = at[other]
                found.append(pairs(node[at], node[other], meta[at], meta[other]))
                if len(starts):
                    # lists of equal members count as one only with equal rights to skip pairs
                    flags = (meta >> 61).view(np.uint64)
                    name = np.add.reduceat(_mixed(node.view(np.uint64) + flags * _MULTIPLIERS[4]), starts).view(np.int64)
                    small = ~split & (sizes > 2) & (sizes <= short)
                    kept = np.flatnonzero(small)
                    _, first = np.unique(name[kept], return_index=True)
                    once = np.zeros(len(starts), dtype=bool)
                    once[kept[first]] = True
                    name = np.where(split | (sizes > short), key[starts], name)
                    keep = np.repeat((small & once) | split | (sizes > short), sizes)
                    if keep.any():
                        yield made(1, np.repeat(name, sizes)[keep], node[keep], meta[keep])
            if found and len(all_ := np.concatenate(found)):
                all_ = np.unique(all_, axis=0)
                yield made(0, all_[:, 0].copy(), all_[:, 1].copy(), np.zeros(len(all_), np.int64))

        waiting = 0
        for batch in batches:
            more.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "meta")])
            waiting += batch.num_rows
            if waiting >= flush_rows:
                yield from flush(False)
                waiting = 0
        yield from flush(True)

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "meta", "node").select("key", "node", "meta")
    return ordered.mapInArrow(run, "kind int, a bigint, b bigint, meta bigint")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, label (the least node that it reaches) of all nodes in ``links`` (a, b).

    Least labels spread along links and are followed to their own labels;
    each round is written, so lineage stays short. Minima are taken by partial
    aggregation; no node's links are gathered. It ends when no label changes.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        near = labels.join(seen, labels["node"] == seen["a"], "left").select("node", "label", F.least("label", "least").alias("new"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = near.join(up, near["new"] == up["_n"], "left").select("node", F.least("new", "_l").alias("label"), (F.least("new", "_l") < F.col("label")).alias("changed"))
        labels = written(jumped, "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


class _Verifier:
    """Checks candidate pairs against whole sets, each pair once."""

    def __init__(self, rows: DataFrame, reps: DataFrame, k: int, seed: int, percent: int):
        self.rows, self.reps, self.k, self.seed, self.percent = rows, reps, k, seed, percent

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """node, text of the sets named in column ``d1`` of ``nodes``."""
        wanted = written(nodes.join(self.reps, "d1").select(F.col("rep").alias("doc_id"), F.col("d1").alias("node")), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        # whole texts move, not sets of hashes, which do not compress
        return self.rows.join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "text")

    def bitmaps(self, nodes: DataFrame) -> DataFrame:
        """node, small (size and bitmap) of the sets named in column ``d1``."""
        k, seed = self.k, self.seed

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(k, seed)
            for batch in batches:
                named = batch.column("node").to_pylist()
                for lo, block in blocks(batch.column("text")):
                    sets = shingles.sets(block)
                    # rows that repeat an id may have another text than the set's
                    right = [i for i, s in enumerate(sets) if _digest(s, seed)[0] == named[lo + i]]
                    small = [len(sets[i]).to_bytes(8, "little") + bitmap(sets[i]) for i in right]
                    yield pa.RecordBatch.from_pydict({"node": pa.array([named[lo + i] for i in right], pa.int64()), "small": pa.array(small, pa.binary())})

        return written(self._texts(nodes).mapInArrow(build, "node bigint, small binary"), "bitmaps", TEXTS_A_BATCH)

    def links(self, pairs: DataFrame, small: DataFrame | None = None, tested: bool = False) -> DataFrame:
        """The pairs (a, b) that link. ``small``: bitmaps of the sets if there are any yet; ``tested``: the pairs have passed them."""
        k, seed, percent = self.k, self.seed, self.percent
        nodes = pairs.select(F.col("a").alias("d1")).unionByName(pairs.select(F.col("b").alias("d1"))).distinct()
        if small is None and not tested:
            small = self.bitmaps(nodes)

        def checked(pairs: DataFrame, sides: DataFrame, column: str, test) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                judge = test()
                for batch in batches:
                    cols = [batch.column(c).to_pylist() for c in ("a", "b", "x", "y")]
                    ok = [judge(*row) for row in zip(*cols, strict=True)]
                    yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())})

            first = sides.select(F.col("node").alias("a"), F.col(column).alias("x"))
            second = sides.select(F.col("node").alias("b"), F.col(column).alias("y"))
            both = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
            return written(both.mapInArrow(run, "a bigint, b bigint, ok boolean").where("ok").select("a", "b").distinct(), "checked", TEXTS_A_BATCH // 2)

        def may_link():
            def judge(a: int, b: int, x: bytes, y: bytes) -> bool:
                m, n = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
                most = most_shared(m, n, x[8:], y[8:])
                return 100 * most >= percent * (m + n - most)

            return judge

        def do_link():
            shingles, known = Shingles(k, seed), {}

            def set_of(node: int, text: bytes) -> np.ndarray | None:
                if node not in known:
                    if len(known) > 2000:
                        known.clear()
                    found = shingles.sets([text])[0]
                    # rows that repeat an id may have another text than the set's
                    known[node] = found if _digest(found, seed)[0] == node else None
                return known[node]

            def judge(a: int, b: int, x: bytes, y: bytes) -> bool:
                s, t = set_of(a, x), set_of(b, y)
                if s is None or t is None:
                    known.pop(a, None), known.pop(b, None)
                    return False
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                return 100 * shared >= percent * (len(s) + len(t) - shared)

            return judge

        if not tested:
            pairs = checked(pairs, small, "small", may_link)
            nodes = pairs.select(F.col("a").alias("d1")).unionByName(pairs.select(F.col("b").alias("d1"))).distinct()
        return checked(pairs, self._texts(nodes), "text", do_link)


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each token, by its hash; four bits of room a token or more, a power of two, 4 kB at most."""
    bits = 1 << min(15, max(6, (4 * max(len(s), 1) - 1).bit_length()))
    out = np.zeros(bits, dtype=bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def most_shared(m: int, n: int, x: bytes, y: bytes) -> int:
    """The most tokens that sets of ``m`` and ``n`` can share, by their bitmaps: a bit of one alone is a token of it alone."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(m - int(np.bitwise_count(a & ~b).sum()), n - int(np.bitwise_count(b & ~a).sum()))


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class _Bitmaps:
    """Sized bitmaps by their sets' names, and the tests of their pairs many at a time."""

    #: Pairs that are tested at once, by words of their bitmaps.
    WORDS = 1 << 20

    def __init__(self, percent: int):
        self.percent, self.place, self.small, self.stack = percent, {}, [], None

    def __len__(self) -> int:
        return len(self.small)

    def add(self, nodes: list[int], small: list[bytes]) -> np.ndarray:
        """Where the bitmaps of ``nodes`` stand."""
        out = np.empty(len(nodes), np.int64)
        for k, node in enumerate(nodes):
            at = self.place.setdefault(node, len(self.small))
            if at == len(self.small):
                self.small.append(small[k])
                self.stack = None
            out[k] = at
        return out

    def _stacked(self) -> None:
        words = np.array([(len(x) - 8) // 8 for x in self.small])
        self.words, self.row, self.stack = words, np.empty(len(words), np.int64), {}
        self.n = np.array([int.from_bytes(x[:8], "little") for x in self.small])
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            self.row[at] = np.arange(len(at))
            bits = np.frombuffer(b"".join(self.small[i][8:] for i in at), np.uint64).reshape(len(at), w)
            # a quarter of the bits first: it tells most pairs of different sets apart
            self.stack[w] = (_folded(bits, max(1, w // 4)), bits)

    def _passing(self, a: np.ndarray, b: np.ndarray, fine: int) -> np.ndarray:
        ok = np.zeros(len(a), bool)
        kinds = self.words[a] << 32 | self.words[b]
        for kind in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == kind)
            x, y = self.stack[kind >> 32][fine], self.stack[kind & 2**32 - 1][fine]
            w = min(x.shape[1], y.shape[1])
            step = max(1, self.WORDS // max(x.shape[1], y.shape[1]))
            for lo in range(0, len(mine), step):
                at = mine[lo : lo + step]
                p, q = a[at], b[at]
                u, v = _folded(x[self.row[p]], w), _folded(y[self.row[q]], w)
                m, n = self.n[p], self.n[q]
                both = np.bitwise_count(u & v).sum(axis=1, dtype=np.int64)
                most = np.minimum(m - np.bitwise_count(u).sum(axis=1, dtype=np.int64), n - np.bitwise_count(v).sum(axis=1, dtype=np.int64)) + both
                ok[at] = 100 * most >= self.percent * (m + n - most)
        return ok

    def possible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of places that may link, by :func:`most_shared`."""
        if self.stack is None:
            self._stacked()
        for fine in (0, 1):
            ok = self._passing(a, b, fine)
            a, b = a[ok], b[ok]
        return a, b


def met_in_blocks(leaders: DataFrame, members: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of ``leaders`` and ``members`` (group, node, label) of a group, of different labels, that may link by their bitmaps.

    Both are dealt into blocks (BLOCK); a block of leaders meets a
    block of members in one task, as arrays, and only pairs that pass become
    rows. A row is sent once for each block that it meets. Pairs of small
    groups are tested together.
    """
    n_leaders = leaders.groupBy("group").agg(F.count("*").alias("leaders"))
    n_members = members.groupBy("group").agg(F.count("*").alias("members"))
    sizes = n_leaders.join(n_members, "group").select("group", F.ceil(F.col("leaders") / BLOCK).cast("int").alias("nl"), F.ceil(F.col("members") / (4 * BLOCK)).cast("int").alias("nm"))
    sizes = written(sizes, "blocks")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lead = leaders.join(sizes, "group").select("group", own(F.col("nl")).alias("l"), every(F.col("nm")).alias("m"), F.lit(0).alias("side"), "node", "label")
    rest = members.join(sizes, "group").select("group", every(F.col("nl")).alias("l"), own(F.col("nm")).alias("m"), F.lit(1).alias("side"), "node", "label")
    rows = lead.unionByName(rest).join(small, "node").select("group", "l", "m", "side", "node", "label", "small")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "group", "l", "m").sortWithinPartitions("group", "l", "m", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, block, held, waiting, count = _Bitmaps(percent), None, ([], [], [], [], [], []), [], 0
        size = lambda small: np.array([int.from_bytes(x[:8], "little") for x in small], np.int64)

        def tested() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, count
            if count:
                names = np.fromiter(store.place, np.int64, len(store))
                x, y = store.possible(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
                p, q = names[x], names[y]
                found = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1)[p != q], axis=0)
                if len(found):
                    yield pa.RecordBatch.from_pydict({"a": found[:, 0].copy(), "b": found[:, 1].copy()})
            waiting, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:  # held: nodes, labels and bitmaps of leaders, then of members
            nonlocal store, count
            if not held[0] or not held[3]:
                return
            x, y = store.add(held[0], held[2]), store.add(held[3], held[5])
            label, other = np.array(held[1], np.int64), np.array(held[4], np.int64)
            n, m = size(held[2]), size(held[5])
            for lo in range(0, len(x), max(1, PAIRS_AT_ONCE // len(y))):
                part = slice(lo, lo + max(1, PAIRS_AT_ONCE // len(y)))
                one = n[part, None]
                i, j = np.nonzero((label[part, None] != other) & (100 * np.minimum(one, m) >= percent * np.maximum(one, m)))
                waiting.append((x[part][i], y[j]))
                count += len(i)
                if count >= PAIRS_AT_ONCE:
                    yield from tested()
            if len(store) > BLOCK:
                yield from tested()
                store = _Bitmaps(percent)

        for batch in batches:
            for g, left, m, side, node, label, bits in zip(*(batch.column(c).to_pylist() for c in ("group", "l", "m", "side", "node", "label", "small")), strict=True):
                if (g, left, m) != block:
                    yield from flush()
                    block, held = (g, left, m), ([], [], [], [], [], [])
                elif side and len(held[3]) >= 8 * BLOCK:  # hashes deal unevenly, and a block may be larger than meant
                    yield from flush()
                    held = (*held[:3], [], [], [])
                for column, value in zip(held[3 * side : 3 * side + 3], (node, label, bits), strict=True):
                    column.append(value)
        yield from flush()
        yield from tested()

    return rows.mapInArrow(run, "a bigint, b bigint")


def merged(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``links`` (a, b): only the labels at their ends are joined anew."""
    at = lambda name, label: labels.select(F.col("node").alias(name), F.col("label").alias(label))
    ends = links.select("a", "b").join(at("a", "la"), "a", "left").join(at("b", "lb"), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "ends")
    new = components(spark, ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b"))
    nodes = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("e")).select("e.*")
    all_ = labels.unionByName(nodes).distinct()
    new = new.select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return written(all_.join(new, "label", "left").select("node", F.coalesce("_new", "label").alias("label")), "labels")


def _fits(meta: str, other: str, percent: int):
    """Whether two postings on a list may link, as :func:`_near` has it."""
    x, y = F.col(meta).bitwiseAND(SIZE), F.col(other).bitwiseAND(SIZE)
    often = F.least(x - F.shiftright(meta, 31).bitwiseAND(RARE), y - F.shiftright(other, 31).bitwiseAND(RARE))
    plain = (F.shiftright(meta, 61) % 2 == 0) | (F.shiftright(other, 61) % 2 == 0)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (plain | ((100 + percent) * often >= percent * (x + y)))


def _probes(long: DataFrame, labels: DataFrame, percent: int, turn: int, pivots: int = 8) -> DataFrame:
    """Pairs of each set with up to ``pivots`` members of other groups on one of its lists that hold several groups.

    The list and the members are drawn by hashes of the turn: at most
    ``pivots`` pairs a set, however long its lists are. They join most of what
    belongs together before any leader meets whole lists.
    """
    named = long.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("key").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("key")
    named = written(named.join(open_, "key"), "open")
    drawn = F.xxhash64("node", "key", F.lit(turn))
    of_list = named.groupBy("key", F.pmod(drawn, F.lit(pivots)).alias("slot")).agg(F.min(F.struct(drawn.alias("d"), "node", "meta", "label")).alias("p"))
    of_list = of_list.select("key", F.col("p.node").alias("pivot"), F.col("p.meta").alias("pivot_meta"), F.col("p.label").alias("pivot_label"))
    chosen = named.groupBy("node").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("d"), "key", "meta", "label")).alias("c")).select("node", "c.key", "c.meta", "c.label")
    met = chosen.join(of_list, (chosen["key"] == of_list["key"]) & (F.col("label") != F.col("pivot_label")) & _fits("meta", "pivot_meta", percent))
    return written(met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "probes")


def _residual(long: DataFrame, labels: DataFrame, small: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame] | None:
    """Of long lists that still hold several groups: pairs of leaders with members of other groups, and the lists without those leaders.

    Members outside a list's largest group lead, LEADERS of a list in the first
    turn and four times as many in each that follows (all of them where that
    makes few pairs); a leader's pairs on the list are settled for good.
    """
    named = written(long.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "members")
    groups = written(named.groupBy("key", "label").agg(F.count("*").alias("members")), "groups")
    lists = groups.groupBy("key").agg(F.sum("members").alias("m"), F.max(F.struct("members", "label")).alias("top"), F.count("*").alias("groups"))
    open_ = lists.where("groups > 1").select("key", "m", "groups", F.col("top.label").alias("top"), F.col("top.members").alias("most"), (F.col("m") - F.col("top.members")).alias("others"))
    open_ = written(open_, "open")
    if open_.isEmpty():
        return None
    share = F.ceil(F.col("others") / F.greatest(F.lit(LEADERS << 2 * min(turn, 12)), F.lit(PAIRS_A_LIST) / F.col("m")))
    met = named.join(open_, "key").withColumn("leads", (F.col("label") != F.col("top")) & (F.pmod(F.xxhash64("node", F.lit(turn)), share) == 0))
    met = written(met.select("key", "node", "meta", "label", "top", "most", "groups", "leads"), "met")
    lead = met.where("leads")
    # a leader that would meet a group more often, as the largest of its lists, than the group has members meets each of them once instead
    nodes = written(met.select("node", "label").distinct(), "nodes")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"))
    ways = lead.groupBy("node", "label", "top").agg(F.sum("most").alias("rows"))
    ways = written(ways.join(sizes.withColumnRenamed("label", "top"), "top").withColumn("whole", F.col("rows") > F.col("size")), "ways")
    hashed = lambda kind, column: F.xxhash64(F.lit(kind), F.col(column)).alias("group")
    listed = lead.join(ways.where("NOT whole").select("node", "top"), ["node", "top"], "left_semi")
    leaders = [ways.where("whole").select(hashed(0, "top"), "node", "label"), listed.select(hashed(1, "key"), "node", "label"), lead.where("groups > 2").select(hashed(2, "key"), "node", "label")]
    leaders = [written(x, "leaders") for x in leaders]
    # all of a group, the largest group of a list, and the others of a list, which meet as one
    members = [nodes.select(hashed(0, "label"), "node", "label"), met.where("label = top").select(hashed(1, "key"), "node", "label"), met.where("label <> top AND groups > 2").select(hashed(2, "key"), "node", "label")]
    members = [x.join(y.select("group").distinct(), "group", "left_semi") for x, y in zip(members, leaders, strict=True)]
    both = [reduce(DataFrame.unionByName, x) for x in (leaders, members)]
    pairs = met_in_blocks(both[0], written(both[1], "members"), small, percent)
    return written(pairs.distinct(), "pairs"), met.where("NOT leads").select("key", "node", "meta")


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, frequent_from: int = 8, short: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Two documents link if 100 * intersection >= percent * union of their sets
    of ``k``-word shingles; ``component_id`` is the smallest doc_id reachable by
    links. Equal sets link by their digests. Different sets meet in an index
    of prefix keys (see :func:`prefix_keys`), exact at any data: the members of
    a key's list are verified against leaders until all members are in one
    group or all pairs across groups are settled, so copies never make all
    their pairs. A token is frequent if it occurs ``frequent_from`` times or
    more in the corpus (more still where over MOST_FREQUENT would be); lists of
    up to ``short`` members are told apart by their members. These two change
    the work and not the result.

    A text without words (or null) has no shingles and is its own component.
    Rows with a null id get a null component and link nothing. Rows that repeat
    an id count by their texts. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = df.sparkSession
    rows = _texts(df, id_col, text_col).where("doc_id IS NOT NULL")
    for seed in range(8):  # a digest's first half names a set; should two sets share it, another seed parts them
        scan = written(_scan(rows, k, seed), "scan", TEXTS_A_BATCH)
        reps = written(scan.where("n > 0").groupBy("d1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("d2").alias("lo"), F.max("d2").alias("hi")), "reps")
        if reps.where("lo <> hi").isEmpty():
            break
    total = scan.agg(F.sum("n"), F.count("*")).first()
    frequent = frequent_tokens(rows, k, seed, total[0] or 0, frequent_from)

    found = written(_candidates(_postings(rows, frequent, k, seed, percent), percent, short), "candidates", TEXTS_A_BATCH)
    verifier = _Verifier(rows, reps, k, seed, percent)
    pairs = written(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    long = written(found.where("kind = 1").groupBy(F.col("a").alias("key"), F.col("b").alias("node")).agg(F.min("meta").alias("meta")), "lists")
    ends = [pairs.select(F.col(c).alias("d1")) for c in ("a", "b")]
    small = verifier.bitmaps(ends[0].unionByName(ends[1]).unionByName(long.select(F.col("node").alias("d1"))).distinct())
    links = verifier.links(pairs, small)
    labels = components(spark, links)
    if not long.isEmpty():
        settled = pairs

        def tested(pairs: DataFrame, passed: bool = False) -> int:
            """Verifies the pairs that are not settled yet; returns how many of them link. ``passed``: their bitmaps let them."""
            nonlocal settled, labels
            fresh = written(pairs.join(settled, ["a", "b"], "left_anti"), "fresh")
            settled = written(settled.unionByName(fresh), "settled")
            if fresh.isEmpty():
                return 0
            new = verifier.links(fresh, small, passed)
            found = new.count()
            if found:
                labels = merged(spark, labels, new)
            return found

        # as long as probes link many sets, they do so with fewer pairs than leaders would
        turn = 0
        while tested(_probes(long, labels, percent, turn)) > PROBES_LINK:
            turn += 1  # each such round leaves fewer sets alone
        turn = 0
        while (more := _residual(long, labels, small, percent, turn)) is not None:
            (pairs, long), turn = more, turn + 1
            tested(pairs, True)

    named = reps.join(labels, reps["d1"] == labels["node"], "left").select("d1", "rep", "copies", F.coalesce("label", "d1").alias("label"))
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "label").select("d1", "component_id", "copies"), "named")
    # sets with more than a thousandth of all rows (fewer than a thousand) join by broadcast, the others by shuffle
    many = F.col("copies") * 1000 > F.lit(total[1])
    small = scan.select("doc_id", "n", "d1")
    hot = small.join(F.broadcast(named.where(many).select("d1", F.col("component_id").alias("hot"))), "d1", "left")
    rest = hot.where("hot IS NULL").join(named.where(~many).select("d1", "component_id"), "d1", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    done = rest.unionByName(hot.where("hot IS NOT NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("hot").alias("component_id")))
    lost = _scan(_texts(df, id_col, text_col).where("doc_id IS NULL"), k, 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.unionByName(lost)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of ``df``, that of the smallest id; rows without words or with a null id all stay.

    Texts under one id are told apart by their hashes, and of equal rows
    (id and text) of a group one stays.
    """
    own = F.when(df[id_col].isNotNull(), F.struct(df[id_col].alias("id"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("hash")))
    groups = jaccard_groups(df.select(own.alias("doc_id"), df[text_col].alias("text")), "doc_id", "text", k, percent)
    rows = groups.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    lost = rows.select(F.col("doc_id").alias("_own"), (F.col("component_id") != F.col("doc_id")).alias("_lost"), (F.col("n") > 1).alias("_again")).where("_lost OR _again")
    lost = written(lost, "lost")
    few = lost.count() <= BROADCAST_ROWS
    met = df.withColumn("_id", own).join(F.broadcast(lost) if few else lost, F.col("_id") == F.col("_own"), "left").where("_lost IS NULL OR NOT _lost")
    once = met.where("_again").dropDuplicates(["_own"])
    return met.where("_again IS NULL").unionByName(once).select(*df.columns)
