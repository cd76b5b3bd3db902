"""BPE encoding and decoding with contiguous rank arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank of a pair that has no merge.
NONE = np.int32(2**31 - 1)
#: The byte-level vocabularies' pattern, with White_Space spelt out (fixed values).
_WS = r"\t-\r\x20\x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


#: Text of these characters alone takes the faster engine, where letters are a range.
_ODD = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t-\r {_L}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Numbers(dict):
    """Numbers pieces in order of first use; ``new`` has those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, piece) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabularies: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary (tokenizers JSON) read from ``path``.

    Words of up to ``short`` bytes are encoded many at a time: each is a row of
    parts with the ranks of its adjacent pairs beside them; every round scans
    the rows for their least rank, deletes that boundary and refreshes the two
    neighbouring ranks. Longer words use a heap, with equal results. ``cache``
    bounds the number of words remembered between blocks of texts.
    """

    def __init__(self, path: str, short: int = 48, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, k in vocab.items():
            self.token_bytes[k] = bytes(alphabet[c] for c in t)
        for t, k in self.special.items():
            self.token_bytes[k] = t.encode()
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._piece = regex.compile(PIECE)
        self.byte_id = np.zeros(256, dtype=np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._pair = {int(k): int(r) for k, r in zip(self._keys, self._ranks, strict=True)}
        # some vocabularies mark the last byte of a word
        end = model.get("end_of_word_suffix")
        self.last_id = np.array([vocab[c + end] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int32) if end else None
        both = np.arange(256)
        self._first = self._rank(np.repeat(self.byte_id[both], 256), np.tile(self.byte_id[both], 256))
        self._decimal, self._decimal_in = self._padded([b"%d," % k for k in range(size)], 8)
        self._text, self._text_in = self._padded([t if len(t) <= 16 else b"" for t in self.token_bytes], 16)
        self._wide = np.array([len(t) > 16 for t in self.token_bytes])
        self.short, self.limit = short, cache
        self._forget()

    @staticmethod
    def _padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Strings as rows of bytes, and which of those bytes are theirs."""
        rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in strings), dtype=np.uint8).reshape(-1, width)
        return rows, np.arange(width)[None, :] < np.array([len(t) for t in strings])[:, None]

    def _forget(self) -> None:
        self._numbers, self._flat, self._ends, self._held = Numbers(), [], [], 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NONE)

    def _rows(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts of words of at most ``width`` bytes, a row each, and their number."""
        n = len(words)
        size = np.fromiter(map(len, words), dtype=np.int32, count=n)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(n, width)
        parts = self.byte_id[raw]
        ranks = self._first[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
        col = np.arange(width, dtype=np.int32)[None, :]
        ranks[col[:, :-1] >= (size - 1)[:, None]] = NONE
        if self.last_id is not None:
            at = np.arange(n)
            parts[at, size - 1] = self.last_id[raw[at, size - 1]]
            two = at[size > 1]
            ranks[two, size[two] - 2] = self._rank(parts[two, size[two] - 2], parts[two, size[two] - 1])
        done, sizes, live = np.zeros_like(parts), size.copy(), np.arange(n)
        while True:
            at = ranks.argmin(1).astype(np.int32)
            least = ranks[np.arange(len(live)), at]
            over = least == NONE
            if over.any():
                done[live[over]], sizes[live[over]] = parts[over], size[over]
                keep = ~over
                live, parts, ranks, size, at, least = live[keep], parts[keep], ranks[keep], size[keep], at[keep], least[keep]
            if not len(live):
                return done, sizes
            # delete the boundary after part ``at``: what lies beyond moves down by one
            rows = np.arange(len(live))
            after = col[:, :-1] > at[:, None]
            parts[:, :-1] = np.where(after, parts[:, 1:], parts[:, :-1])
            parts[rows, at] = self._merged[least]
            ranks[:, :-1] = np.where(after[:, :-1] | (col[:, :-2] == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            size = size - 1
            ranks[rows, size - 1] = NONE
            left, right = at > 0, at + 1 < size
            k, j = rows[left], at[left]
            ranks[k, j - 1] = self._rank(parts[k, j - 1], parts[k, j])
            k, j = rows[right], at[right]
            ranks[k, j] = self._rank(parts[k, j], parts[k, j + 1])

    def _long(self, word: bytes) -> list[int]:
        ids = [int(self.byte_id[b]) for b in word]
        if self.last_id is not None:
            ids[-1] = int(self.last_id[word[-1]])
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        get = self._pair.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self._merged[r]), False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (q := get((ids[x] << 20) | ids[after[x]])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[after[x]]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (pieces of the pre-tokeniser) one after the other, and the number of each."""
        sizes = np.zeros(len(words), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        long: list[tuple[int, list[int]]] = []
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > self.short:
                long.append((k, self._long(w)))
                sizes[k] = len(long[-1][1])
            elif w:
                groups.setdefault(max(4, -(-len(w) // 4) * 4), []).append(k)
        for width, at in groups.items():
            for lo in range(0, len(at), 20_000):
                block = np.array(at[lo : lo + 20_000])
                parts, n = self._rows([words[k] for k in block.tolist()], width)
                sizes[block] = n
                found.append((block, parts))
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), dtype=np.int32)
        for block, parts in found:
            where = np.arange(parts.shape[1])[None, :]
            mine = where < sizes[block][:, None]
            flat[(starts[block][:, None] + where)[mine]] = parts[mine]
        for k, ids in long:
            flat[starts[k] : starts[k] + len(ids)] = ids
        return flat, sizes

    def pieces(self, text: str) -> list[str]:
        """Pre-tokeniser pieces in order; special tokens stand as they are."""
        engine = self._piece if _ODD.search(text) else PLAIN
        if self._special is None or self._special.search(text) is None:
            return engine.findall(text)
        out: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            out += [part] if k % 2 else engine.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. New words of all the texts are encoded together."""
        if self._held > self.limit:
            self._forget()
        number, used = self._numbers.__getitem__, []
        for t in texts:
            found = self.pieces(t)
            used.append(np.fromiter(map(number, found), dtype=np.int64, count=len(found)))
        if new := self._numbers.new:
            flat, sizes = self.encode_words([b"" if p in self.special else p.encode() for p in new])
            if self.special.keys() & set(new):
                at = np.cumsum(sizes)
                for k, p in enumerate(new):
                    if p in self.special:
                        flat, sizes[k] = np.insert(flat, at[k], self.special[p]), 1
                        at = np.cumsum(sizes)
            self._flat.append(flat)
            self._ends.append(sizes)
            self._held += len(new)
            self._numbers.new = []
        flat = np.concatenate(self._flat) if self._flat else np.zeros(0, np.int32)
        sizes = np.concatenate(self._ends) if self._ends else np.zeros(0, np.int64)
        self._flat, self._ends = [flat], [sizes]
        starts = np.cumsum(sizes) - sizes
        out = []
        for ks in used:
            n = sizes[ks]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(starts[ks] - (ends - n), n) + np.arange(total)])
        return out

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._decimal[ids][self._decimal_in[ids]].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        if len(ids) and self._wide[ids].any():
            raw = b"".join([self.token_bytes[k] for k in ids.tolist()])
        else:
            raw = self._text[ids][self._text_in[ids]].tobytes()
        return raw.decode("utf-8", errors="replace")


def blocks(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``most`` bytes."""
    sizes = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most)))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with
    ``keep_ids``, ids array<int>. One row for each input row, repeated rows
    included; a null text is empty (no tokens), null ids pass through, other
    columns are ignored, an empty table gives no rows. No shuffle: each task
    reads the vocabulary at ``path`` (present on every machine, as the library
    is) and keeps a bounded cache of words.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteBPE(path)
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                found = model.encode_batch(texts)
                cols = {
                    "doc_id": batch.column("doc_id").slice(lo, len(texts)),
                    "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(model.decimals(x)).hexdigest() for x in found], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in found], pa.string()),
                }
                if keep_ids:
                    cols["ids"] = pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""))
