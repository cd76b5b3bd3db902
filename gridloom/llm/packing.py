"""Packing of tokenised documents into sequences by bin completion."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import ByteBPE, Numbers, blocks
from gridloom.llm.common import TEXTS_A_BATCH, written

Plan = list[tuple[tuple[int, ...], int]]


#: Chunks of these characters alone (lower-cased) are no other text by normalisation, and their letters and digits are ranges.
_PLAIN = re.compile("[!-~\xdf-\xf6\xf8-\xff]+")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


class WordEncoder:
    """Ids by a tokenizers file, a white-space separated chunk at a time.

    Chunks between ASCII white space are encoded once and remembered (at most
    ``cache`` of them between blocks). It suits tokenizers that fold case, drop
    white space and look at nothing across it. Where the file's own rules are
    those of ``word_bpe_49k.json``, chunks of plain letters, digits and signs
    are cut into its pieces, which are merged many at a time
    (:class:`gridloom.llm.bpe.ByteBPE`); all others go to the library.
    """

    def __init__(self, path: str, cache: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._merges = ByteBPE(path) if _known(spec) else None
        self._cache = cache
        self._forget()

    def _forget(self) -> None:
        self._number, self._piece = Numbers(), Numbers()
        self._flat, self._starts, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._parts, self._part_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks one after the other, and the number of each."""
        pieces = [_WORD.findall(c) for c in chunks]
        each = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ks = np.fromiter(map(self._piece.__getitem__, chain.from_iterable(pieces)), np.int64, int(each.sum()))
        if self._piece.new:
            flat, sizes = self._merges.encode_words([p.encode() for p in self._piece.new])
            self._parts, self._part_sizes = np.append(self._parts, flat), np.append(self._part_sizes, sizes)
            self._piece.new = []
        n = self._part_sizes[ks]
        return _gathered(self._parts, (np.cumsum(self._part_sizes) - self._part_sizes)[ks], n), np.add.reduceat(n, np.cumsum(each) - each)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [np.zeros(0, np.int32)], []
        for lo in range(0, len(chunks), 20_000):
            ids = [e.ids for e in self._model.encode_batch_fast(chunks[lo : lo + 20_000], add_special_tokens=False)]
            sizes += map(len, ids)
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
        return np.concatenate(flat), np.array(sizes, np.int64)

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self._number) > self._cache:
            self._forget()
        number, used = self._number.__getitem__, []
        for t in texts:
            # bytes: ASCII white space and letters alone; A-Z fold here, where no special token can arise by it
            found = (t if b"<|" in t else t.lower()).split()
            used.append(np.fromiter(map(number, found), np.int64, len(found)))
        new = [c.decode("utf-8", errors="replace") for c in self._number.new]
        self._number.new = []
        plain, other = [], []
        for k, c in enumerate(new):
            if self._merges is not None and _PLAIN.fullmatch(low := c.lower()) and "<|" not in c:
                plain.append((k, low))
            else:
                other.append((k, c))
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for chunks, encode in ((plain, self._merged), (other, self._library)):
            if chunks:
                at = [k for k, _ in chunks]
                flat, n = encode([c for _, c in chunks])
                starts[at], sizes[at] = len(self._flat) + np.cumsum(n) - n, n
                self._flat = np.append(self._flat, flat)
        self._starts, self._sizes = np.append(self._starts, starts), np.append(self._sizes, sizes)
        return [_gathered(self._flat, self._starts[ks], self._sizes[ks]) for ks in used]


def _known(spec: dict) -> bool:
    """Whether a tokenizers file is of the kind whose plain chunks :class:`WordEncoder` cuts by itself."""
    model, steps = spec["model"], spec.get("pre_tokenizer") or {}
    rules = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [(p.get("type"), (p.get("pattern") or {}).get("Regex"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in steps.get("pretokenizers", [])]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    plain_model = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
    special = all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    return plain_model and special and rules == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", pattern, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]


def _gathered(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``n`` from ``starts``, one after the other."""
    ends = np.cumsum(n)
    return flat[np.repeat(starts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def tokenised_pieces(df: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of documents cut at ``size`` ids; ``end`` closes each document."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordEncoder(path)
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(model.encode_batch(texts)):
                    ids = np.append(ids, end).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), size)):
                        part = ids[s : s + size]
                        row.append(lo + k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part)
                cols = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
                cols |= {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc))}
                if keep_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else ""))


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing over a histogram of lengths; equal bins move together."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = size // length
                if full := left // each:
                    add(size - each * length, (length,) * each, full)
                if rest := left % each:
                    add(size - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            pattern, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            used = min(n, left)
            if used < n:
                add(room, pattern, n - used)
            add(room - length, (*pattern, length), used)
            left -= used
    return [(p, n) for bins in open_bins.values() for p, n in bins]


class _Search:
    """Branch and bound over completions of the largest length left."""

    def __init__(self, counts: dict[int, int], size: int, nodes: int, steps: int):
        self.counts, self.size, self.nodes, self.steps = {k: n for k, n in counts.items() if n}, size, nodes, steps
        self.total = sum(k * n for k, n in self.counts.items())
        self.least = max(-(-self.total // size), sum(n for k, n in self.counts.items() if 2 * k > size))
        self.best = best_fit(self.counts, size)
        self.bins = sum(n for _, n in self.best)
        self.cut = False  # whether a limit ended an enumeration
        self.plan: Plan = []
        self.used = self.waste = 0

    def slack(self) -> int:
        """What may still be wasted in a plan better than the best so far."""
        return (self.bins - 1) * self.size - self.total - self.waste

    def fillings(self, room: int, slack: int) -> list[tuple[int, ...]]:
        """The undominated fillings of ``room`` that waste at most ``slack``, least waste first, the largest lengths first among equals.

        A filling is maximal: nothing left fits beside it. It is dominated if a
        length left could take the place of one or two of its pieces that are
        no longer together: whatever follows can swap them. So a piece that
        fills the room alone dominates all others.
        """
        left = self.counts
        lengths = sorted((k for k, n in left.items() if n and k <= room), reverse=True)
        if lengths and lengths[0] == room:
            return [(room,)]
        reach = [0] * (len(lengths) + 1)
        for k in range(len(lengths) - 1, -1, -1):
            reach[k] = reach[k + 1] + lengths[k] * left[lengths[k]]
        rising = lengths[::-1]
        found: dict[tuple[int, ...], int] = {}
        self.steps -= len(lengths)
        most = self.steps // 20
        stack: list[tuple[tuple[int, ...], int, int]] = [((), 0, room)]
        while stack:
            taken, at, rest = stack.pop()
            self.steps -= 1
            most -= 1
            if most < 0:
                self.cut = True
                break
            at = max(at, len(lengths) - bisect_right(rising, rest))
            more = []
            for k in range(at, len(lengths)):
                if rest - reach[k] > slack:
                    break
                if taken.count(lengths[k]) < left[lengths[k]]:
                    more.append(((*taken, lengths[k]), k, rest - lengths[k]))
            stack += reversed(more)  # the largest first
            self.steps -= len(more)
            most -= len(more)
            if rest <= slack and not any(taken.count(x) < left[x] for x in rising[: bisect_right(rising, rest)]) and not self._dominated(taken, rest, rising):
                found[taken] = rest
        return sorted(found, key=lambda f: (found[f], [-x for x in f]))

    def _dominated(self, taken: tuple[int, ...], rest: int, rising: list[int]) -> bool:
        free = lambda x: self.counts[x] > taken.count(x)
        for i, a in enumerate(taken):
            for b in {0, *taken[i + 1 :]}:
                lo, hi = bisect_right(rising, a if not b else a + b - 1), bisect_right(rising, a + b + rest)
                if any(free(x) for x in rising[lo:hi]):
                    return True
        return False

    def branches(self) -> Iterator[tuple[tuple[int, ...], int]]:
        """(pattern, copies) from here: as many copies as there can be, or one and then others."""
        self.nodes -= 1
        top = max(k for k, n in self.counts.items() if n)
        self.counts[top] -= 1
        ways = self.fillings(self.size - top, self.slack())
        self.counts[top] += 1
        for filling in ways:
            pattern = (top, *filling)
            copies = min(self.counts[k] // pattern.count(k) for k in set(pattern))
            yield pattern, copies
            if copies > 1:
                yield pattern, 1

    def move(self, pattern: tuple[int, ...], n: int) -> None:
        """Makes ``n`` bins of ``pattern``, or takes them back if ``n`` is negative."""
        for k in pattern:
            self.counts[k] -= n
        self.used += n
        self.waste += n * (self.size - sum(pattern))

    def run(self) -> Plan:
        if self.bins <= self.least:
            return self.best
        frames = [self.branches()]
        while frames and self.bins > self.least:
            if self.nodes <= 0 or self.steps <= 0:
                self.cut = True
                break
            step = next(frames[-1], None)
            if step is None:
                frames.pop()
                if self.plan:
                    pattern, n = self.plan.pop()
                    self.move(pattern, -n)
                continue
            self.move(*step)
            self.plan.append(step)
            if self.slack() >= 0 and any(self.counts.values()):
                frames.append(self.branches())
                continue
            if self.slack() >= 0 and self.used < self.bins:
                self.best, self.bins = list(self.plan), self.used
            pattern, n = self.plan.pop()
            self.move(pattern, -n)
        return self.best


def bin_completion(counts: dict[int, int], size: int, nodes: int = 50_000, steps: int = 3_000_000) -> Plan:
    """Packs a histogram of lengths into as few bins of ``size`` as it can.

    Bins are completed around the largest length left; equal bins are made
    together, so the work follows the number of different lengths and not of
    documents. The search is depth first over the undominated fillings, least
    waste first; a branch ends when its waste leaves no room below the
    incumbent (at first the best-fit decreasing plan). It ends by itself with
    the least number of bins, or at the lower bound, or is cut after ``nodes``
    completions or ``steps`` lengths looked at (a twentieth of those left in one
    completion); then the best plan found stands, which may not be the least.
    """
    return _Search(counts, size, nodes, steps).run()


def _places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low rank, high rank, first sequence, copies in each, first offset): where the pieces of a length go, by their rank."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plan:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            copies = pattern.count(length)
            low = taken.get(length, 0)
            out.append((length, low, low + copies * n, sequence, copies, at))
            taken[length] = low + copies * n
            at += copies * length
        sequence += n
    return out


def _blocked(places: list[tuple[int, int, int, int, int, int]]) -> tuple[dict[int, int], list[tuple[int, ...]]]:
    """Width of a block of ranks for each length, and each place once for each block (after its length) that it reaches into.

    A length has about as many blocks as places, so there are at most twice as
    many rows as places, and a piece meets two of them on average, however
    many patterns hold its length.
    """
    total, number = Counter(), Counter()
    for length, low, high, *_ in places:
        total[length] += high - low
        number[length] += 1
    width = {length: -(-n // number[length]) for length, n in total.items()}
    return width, [(p[0], block, *p[1:]) for p in places for block in range(p[1] // width[p[0]], (p[2] - 1) // width[p[0]] + 1)]


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, length, ids_crc32, ...).

    The driver plans on the number of pieces of each length (``size`` numbers
    at most) and broadcasts the plan, whose rows are bounded by the different
    lengths too. A piece finds its place by its rank among those of its
    length; ranks are counted within salted groups and shifted by the counts
    of the groups before, so that a common length is not one task's work.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    plan = bin_completion({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    width, blocked = _blocked(_places(plan))
    places = spark.createDataFrame(blocked, "length bigint, _block bigint, _low bigint, _high bigint, _seq bigint, _copies bigint, _at bigint")
    widths = spark.createDataFrame(list(width.items()), "length bigint, _width bigint")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift")).join(F.broadcast(widths), "length")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(shifts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_shift"))
    ranked = ranked.withColumn("_block", F.expr("_rank DIV _width"))
    met = ranked.join(F.broadcast(places), ["length", "_block"]).where("_rank >= _low AND _rank < _high")
    nth = F.col("_rank") - F.col("_low")
    met = met.withColumn("sequence_id", F.col("_seq") + F.floor(nth / F.col("_copies"))).withColumn("offset", F.col("_at") + nth % F.col("_copies") * F.col("length"))
    return met.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenises whole documents and packs them into sequences of at most ``size`` ids.

    One row a piece: doc_id, piece, start, length, ids_crc32 (ids),
    sequence_id, offset. Only documents over ``size`` ids are cut. A null or
    empty text is the closing id alone; null ids pass through; repeated rows
    are packed each; other columns are ignored; an empty table gives no rows.
    """
    pieces = written(tokenised_pieces(df, path, size, end, id_col, text_col, keep_ids), "pieces", TEXTS_A_BATCH)
    return pack(pieces, size)
