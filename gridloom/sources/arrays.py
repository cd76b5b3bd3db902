"""Chunked arrays on storage: zarr, N5 and precomputed layouts as a Spark data source with pushed boxes and writes that commit by renaming.

A path names files and layout: ``file:///data/a.zarr|zarr:``, or with an
adapter ``/data/a.zip|zip:inner/path|zarr:``. Files are reached through
pyarrow's file systems, so any store that these know will do.
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridloom.sources.shared import materialized

SOURCE = "gridloom_array"
PENDING = ".pending"
#: Decoded bytes of a partition of the reader, and rows of one of its Arrow batches.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 1 << 18


# Files ------------------------------------------------------------------------------------------------------------------


def parse_path(path: str) -> tuple[str, list[tuple[str, str]], str]:
    """(root, adapters, layout) of ``<root>|<adapter>:<inside>|<layout>:``; a bare absolute path is a file."""
    if path.startswith("/"):
        path = "file://" + urllib.parse.quote(path, safe=":|/\\")
    parts = path.split("|")
    if len(parts) < 2:
        raise ValueError(f"{path!r} names no layout: <root>|<layout>:")
    layout = parts[-1].partition(":")[0].replace("-", "_")
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}, not one of {sorted(LAYOUTS)}")
    adapters = [tuple(p.partition(":")[::2]) for p in parts[1:-1]]
    if unknown := [name for name, _ in adapters if name != "zip"]:
        raise ValueError(f"unknown adapters {unknown}")
    return parts[0], adapters, layout


class Files:
    """Small files under a root."""

    def __init__(self, root: str):
        self.root = root
        self._fs, self._base = fs.FileSystem.from_uri(root)

    def _at(self, key: str) -> str:
        return f"{self._base}/{key}" if key else self._base

    def get(self, key: str) -> bytes | None:
        try:
            with self._fs.open_input_stream(self._at(key)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def has(self, key: str) -> bool:
        return self._fs.get_file_info(self._at(key)).type == fs.FileType.File

    def put(self, key: str, data: bytes) -> None:
        self._fs.create_dir(self._at(key).rpartition("/")[0], recursive=True)
        with self._fs.open_output_stream(self._at(key)) as f:
            f.write(data)

    def put_whole(self, key: str, data: bytes) -> None:
        """Written beside its place and renamed: there whole or not at all."""
        self.put(half := f"{key}.{uuid.uuid4().hex}", data)
        self.move(half, key)

    def move(self, key: str, to: str) -> None:
        self._fs.create_dir(self._at(to).rpartition("/")[0], recursive=True)
        self._fs.move(self._at(key), self._at(to))

    def names(self, key: str) -> list[str]:
        return sorted(i.base_name for i in self._fs.get_file_info(fs.FileSelector(self._at(key), allow_not_found=True)))

    def drop(self, key: str) -> None:
        if self._fs.get_file_info(self._at(key)).type == fs.FileType.Directory:
            self._fs.delete_dir(self._at(key))


class ZipFiles:
    """Files of a zip archive, read only."""

    def __init__(self, below: Files, inside: str):
        data = below.get("")
        if data is None:
            raise FileNotFoundError(below.root)
        self._zip, self._inside = zipfile.ZipFile(io.BytesIO(data)), inside.strip("/")

    def get(self, key: str) -> bytes | None:
        try:
            return self._zip.read("/".join(filter(None, (self._inside, key))))
        except KeyError:
            return None

    def has(self, key: str) -> bool:
        return "/".join(filter(None, (self._inside, key))) in self._zip.NameToInfo


def files_of(root: str, adapters: Sequence[tuple[str, str]]) -> Files | ZipFiles:
    out: Files | ZipFiles = Files(root)
    for _, inside in adapters:
        if isinstance(out, ZipFiles):
            raise ValueError("an archive within an archive")
        out = ZipFiles(out, inside)
    return out


# Codecs -----------------------------------------------------------------------------------------------------------------


def _zstd():
    import zstandard

    return zstandard


#: Fixed names of codecs in array metadata.
_PACK = {
    "raw": lambda b, _: b,
    "zlib": lambda b, level: zlib.compress(b, 1 if level is None else level),
    "gzip": lambda b, level: gzip.compress(b, 5 if level is None else max(level, 0), mtime=0),
    "bz2": lambda b, level: bz2.compress(b, level or 5),
    "zstd": lambda b, level: _zstd().ZstdCompressor(level=level or 3).compress(b),
}
_UNPACK = {"raw": lambda b: b, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "zstd": lambda b: _zstd().ZstdDecompressor().decompressobj().decompress(b)}


# Layouts ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArraySpec:
    """A stored array. Axes, shape and chunks go from the slowest to the fastest axis."""

    root: str
    layout: str
    axes: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float = 0
    codec: str = "zlib"
    level: int | None = None
    origin: tuple[int, ...] = ()
    adapters: tuple[tuple[str, str], ...] = ()
    attributes: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if len({len(self.axes), len(self.shape), len(self.chunks)}) > 1 or min(self.chunks, default=1) < 1 or min(self.shape, default=0) < 0:
            raise ValueError(f"axes {self.axes}, shape {self.shape} and chunks {self.chunks} do not agree")
        if self.codec not in _PACK:
            raise ValueError(f"unknown codec {self.codec!r}")
        object.__setattr__(self, "origin", self.origin or (0,) * len(self.axes))

    @property
    def path(self) -> str:
        return "|".join([self.root, *(f"{n}:{p}" for n, p in self.adapters), f"{self.layout}:"])

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    def index(self, chunk: int) -> tuple[int, ...]:
        return tuple(map(int, np.unravel_index(chunk, self.grid)))

    def extent(self, index: Sequence[int]) -> tuple[tuple[int, int], ...]:
        """(first, end) of a chunk along each axis, without the origin and cut at the shape."""
        return tuple((i * c, min(n, i * c + c)) for i, c, n in zip(index, self.chunks, self.shape, strict=True))

    def files(self) -> Files | ZipFiles:
        return files_of(self.root, self.adapters)

    def key(self, index: Sequence[int]) -> str:
        return LAYOUTS[self.layout].key(self, index)

    def empty(self, index: Sequence[int]) -> np.ndarray:
        return np.full([hi - lo for lo, hi in self.extent(index)], self.fill, dtype=self.dtype)

    def load(self, files: Files | ZipFiles, index: Sequence[int]) -> np.ndarray | None:
        """Values of a chunk within the shape; None if it was never written."""
        data = files.get(self.key(index))
        return None if data is None else LAYOUTS[self.layout].decode(self, index, data)

    def pack(self, index: Sequence[int], values: np.ndarray) -> bytes:
        return LAYOUTS[self.layout].encode(self, index, values.astype(self.dtype))


class _Zarr:
    """Version 2: ``.zarray`` beside files named by chunk indices; chunks are whole even at the edge."""

    @staticmethod
    def read(files, **given) -> ArraySpec:
        raw = files.get(".zarray")
        if raw is None:
            raise FileNotFoundError(".zarray")
        meta, more = json.loads(raw), json.loads(files.get(".zattrs") or b"{}")
        if meta.get("zarr_format") != 2 or meta.get("filters"):
            raise ValueError("only zarr version 2 without filters is read")
        packed = meta.get("compressor") or {"id": "raw"}
        axes = tuple(more.get("_ARRAY_DIMENSIONS") or ("c", "z", "y", "x")[-len(meta["shape"]) :])
        fill = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf"), None: 0}.get(meta["fill_value"], meta["fill_value"])
        more = more | {"separator": meta.get("dimension_separator", "."), "order": meta.get("order", "C")}
        return ArraySpec(axes=axes, shape=tuple(meta["shape"]), chunks=tuple(meta["chunks"]), dtype=meta["dtype"], fill=fill, codec=packed["id"], level=packed.get("level"), attributes=more, **given)

    @staticmethod
    def write(files: Files, spec: ArraySpec) -> None:
        own = {k: v for k, v in spec.attributes.items() if k not in ("separator", "order")}
        fill = spec.fill if np.isfinite(spec.fill) else {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(float(spec.fill))]
        meta = {
            "zarr_format": 2, "shape": spec.shape, "chunks": spec.chunks, "dtype": np.dtype(spec.dtype).str, "fill_value": fill, "order": spec.attributes.get("order", "C"), "filters": None,
            "compressor": None if spec.codec == "raw" else {"id": spec.codec} | ({} if spec.level is None else {"level": spec.level}), "dimension_separator": spec.attributes.get("separator", "."),
        }
        files.put_whole(".zattrs", json.dumps(own | {"_ARRAY_DIMENSIONS": spec.axes}).encode())
        files.put_whole(".zarray", json.dumps(meta).encode())

    @staticmethod
    def key(spec: ArraySpec, index: Sequence[int]) -> str:
        return spec.attributes.get("separator", ".").join(map(str, index))

    @staticmethod
    def decode(spec: ArraySpec, index: Sequence[int], data: bytes) -> np.ndarray:
        whole = np.frombuffer(_UNPACK[spec.codec](data), spec.dtype).reshape(spec.chunks, order=spec.attributes.get("order", "C"))
        return whole[tuple(slice(0, hi - lo) for lo, hi in spec.extent(index))]

    @staticmethod
    def encode(spec: ArraySpec, index: Sequence[int], values: np.ndarray) -> bytes:
        whole = np.full(spec.chunks, spec.fill, dtype=spec.dtype)
        whole[tuple(slice(0, n) for n in values.shape)] = values
        return _PACK[spec.codec](whole.tobytes(order=spec.attributes.get("order", "C")), spec.level)


class _N5:
    """``attributes.json`` with the fastest axis first; blocks are big-endian with a header and cut at the edge."""

    @staticmethod
    def read(files, **given) -> ArraySpec:
        raw = files.get("attributes.json")
        if raw is None:
            raise FileNotFoundError("attributes.json")
        meta = json.loads(raw)
        n = len(meta["dimensions"])
        axes = tuple(reversed(meta.get("axes") or ("x", "y", "z", "c")[:n]))
        more = {k: v for k, v in meta.items() if k not in ("dimensions", "blockSize", "dataType", "compression", "axes")}
        packed = meta["compression"]
        return ArraySpec(axes=axes, shape=tuple(reversed(meta["dimensions"])), chunks=tuple(reversed(meta["blockSize"])), dtype=np.dtype(meta["dataType"]).str, codec={"bzip2": "bz2"}.get(packed["type"], packed["type"]), level=packed.get("level"), attributes=more, **given)

    @staticmethod
    def write(files: Files, spec: ArraySpec) -> None:
        if spec.codec == "zlib":
            raise ValueError("N5 has gzip, not zlib")
        packed = {"type": {"bz2": "bzip2"}.get(spec.codec, spec.codec)} | ({} if spec.level is None else {"level": spec.level})
        meta = {"dimensions": spec.shape[::-1], "blockSize": spec.chunks[::-1], "dataType": np.dtype(spec.dtype).name, "compression": packed, "axes": spec.axes[::-1]}
        files.put_whole("attributes.json", json.dumps(spec.attributes | meta).encode())

    @staticmethod
    def key(spec: ArraySpec, index: Sequence[int]) -> str:
        return "/".join(map(str, reversed(index)))

    @staticmethod
    def decode(spec: ArraySpec, index: Sequence[int], data: bytes) -> np.ndarray:
        mode, n = struct.unpack_from(">HH", data)
        if mode not in (0, 1):
            raise ValueError(f"N5 block mode {mode}")
        shape = struct.unpack_from(f">{n}I", data, 4)[::-1]
        body = data[4 + 4 * n + 4 * (mode == 1) :]
        values = np.frombuffer(_UNPACK[spec.codec](body), np.dtype(spec.dtype).newbyteorder(">")).reshape(shape)
        out = spec.empty(index)
        cut = tuple(slice(0, min(a, b)) for a, b in zip(out.shape, shape, strict=True))
        out[cut] = values[cut]
        return out

    @staticmethod
    def encode(spec: ArraySpec, index: Sequence[int], values: np.ndarray) -> bytes:
        head = struct.pack(f">HH{values.ndim}I", 0, values.ndim, *values.shape[::-1])
        return head + _PACK[spec.codec](values.astype(np.dtype(spec.dtype).newbyteorder(">")).tobytes(), spec.level)


class _Precomputed:
    """``info`` with scales; raw chunks named by their bounds, the first axis fastest. The first scale is meant."""

    @staticmethod
    def read(files, **given) -> ArraySpec:
        raw = files.get("info")
        if raw is None:
            raise FileNotFoundError("info")
        meta = json.loads(raw)
        scale = meta["scales"][0]
        if scale.get("encoding") != "raw" or scale.get("sharding"):
            raise ValueError("only raw, unsharded chunks are read")
        more = {"key": scale["key"], "resolution": scale.get("resolution"), "type": meta.get("type", "image")}
        return ArraySpec(
            axes=("c", "z", "y", "x"), shape=(meta["num_channels"], *reversed(scale["size"])), chunks=(meta["num_channels"], *reversed(scale["chunk_sizes"][0])), dtype=np.dtype(meta["data_type"]).str,
            codec="raw", origin=(0, *reversed(scale.get("voxel_offset") or (0, 0, 0))), attributes=more, **given,
        )

    @staticmethod
    def write(files: Files, spec: ArraySpec) -> None:
        if spec.axes != ("c", "z", "y", "x") or spec.chunks[0] != spec.shape[0] or spec.codec != "raw":
            raise ValueError("precomputed has axes c, z, y, x, all channels in a chunk, and raw chunks")
        scale = {"key": spec.attributes.get("key", "0"), "size": spec.shape[:0:-1], "chunk_sizes": [spec.chunks[:0:-1]], "encoding": "raw", "resolution": spec.attributes.get("resolution") or (1, 1, 1), "voxel_offset": spec.origin[:0:-1]}
        info = {"@type": "neuroglancer_multiscale_volume", "type": spec.attributes.get("type", "image"), "data_type": np.dtype(spec.dtype).name, "num_channels": spec.shape[0], "scales": [scale]}
        files.put_whole("info", json.dumps(info).encode())

    @staticmethod
    def key(spec: ArraySpec, index: Sequence[int]) -> str:
        bounds = [(lo + o, hi + o) for (lo, hi), o in zip(spec.extent(index), spec.origin, strict=True)][:0:-1]
        return f"{spec.attributes.get('key', '0')}/" + "_".join(f"{lo}-{hi}" for lo, hi in bounds)

    @staticmethod
    def decode(spec: ArraySpec, index: Sequence[int], data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.dtype(spec.dtype).newbyteorder("<")).reshape([hi - lo for lo, hi in spec.extent(index)])

    @staticmethod
    def encode(spec: ArraySpec, index: Sequence[int], values: np.ndarray) -> bytes:
        return values.astype(np.dtype(spec.dtype).newbyteorder("<")).tobytes()


LAYOUTS = {"zarr": _Zarr, "zarr2": _Zarr, "n5": _N5, "precomputed": _Precomputed, "neuroglancer_precomputed": _Precomputed}


def open_array(path: str) -> ArraySpec:
    """What the metadata at ``path`` says."""
    root, adapters, layout = parse_path(path)
    return LAYOUTS[layout].read(files_of(root, adapters), root=root, layout=layout, adapters=tuple(adapters))


def array_spec(path: str, axes: Sequence[str], shape: Sequence[int], chunks: Sequence[int], dtype: str, **more) -> ArraySpec:
    """A description of an array to be made at ``path``."""
    root, adapters, layout = parse_path(path)
    if adapters:
        raise ValueError("archives are read only")
    chunks = tuple(min(c, max(n, 1)) for c, n in zip(chunks, shape, strict=True))
    return ArraySpec(root, layout, tuple(axes), tuple(shape), chunks, np.dtype(dtype).str, **more)


def create_array(spec: ArraySpec, delete_existing: bool = False) -> ArraySpec:
    """Makes an empty array. One of the same shape, chunks and type that is there stays, another is an error, unless all that is there goes."""
    files = Files(spec.root)
    if delete_existing:
        files.drop("")
    else:
        try:
            there = open_array(spec.path)
        except FileNotFoundError:
            there = None
        if there is not None:
            if (there.shape, there.chunks, np.dtype(there.dtype)) != (spec.shape, spec.chunks, np.dtype(spec.dtype)):
                raise ValueError(f"another array is at {spec.path}")
            return there
    LAYOUTS[spec.layout].write(files, spec)
    return open_array(spec.path)


# Reading ----------------------------------------------------------------------------------------------------------------

_SQL = {"b1": "boolean", "i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "bigint", "f4": "float", "f8": "double", "f2": "float"}


def sql_type(dtype: str) -> str:
    """Spark has no unsigned types: the next wider one; 64 unsigned bits stay bigint, and values beyond it are an error."""
    kind = np.dtype(dtype).str[1:]
    if kind not in _SQL:
        raise TypeError(f"no column type for {dtype}")
    return _SQL[kind]


def _column(values: np.ndarray) -> pa.Array:
    if values.dtype.kind == "u" and values.dtype.itemsize == 8 and len(values) and int(values.max()) >= 2**63:
        raise OverflowError("a value of 64 unsigned bits exceeds bigint")
    wide = {"boolean": bool, "tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[sql_type(values.dtype.str)]
    return pa.array(np.ascontiguousarray(values).astype(wide))


@dataclass(frozen=True)
class ChunkRange(InputPartition):
    """Chunks lo..hi - 1 of the pruned grid, counted from the slowest axis."""

    lo: int
    hi: int


@dataclass(frozen=True)
class Box:
    """Half-open bounds along each axis, in the array's coordinates (the origin counted)."""

    low: tuple[int, ...]
    high: tuple[int, ...]

    @staticmethod
    def whole(spec: ArraySpec) -> Box:
        return Box(spec.origin, tuple(o + n for o, n in zip(spec.origin, spec.shape, strict=True)))

    def cut(self, axis: int, low: int | None, high: int | None) -> Box:
        lows, highs = list(self.low), list(self.high)
        lows[axis] = max(lows[axis], low) if low is not None else lows[axis]
        highs[axis] = min(highs[axis], high) if high is not None else highs[axis]
        return Box(tuple(lows), tuple(highs))

    def chunks(self, spec: ArraySpec) -> list[range]:
        """Chunk indices along each axis that the box touches."""
        spans = [range((lo - o) // c, -(-(hi - o) // c)) if hi > lo else range(0) for lo, hi, o, c in zip(self.low, self.high, spec.origin, spec.chunks, strict=True)]
        return spans if all(spans) else [range(0)] * len(spans)


def voxel_batches(spec: ArraySpec, files: Files | ZipFiles, index: Sequence[int], box: Box, absent: bool, value: str) -> Iterator[pa.RecordBatch]:
    """Rows (axes, value) of one chunk within a box; ``absent``: whether chunks that were never written have rows of the fill value."""
    data = spec.load(files, index)
    if data is None:
        if not absent:
            return
        data = spec.empty(index)
    first = [lo + o for (lo, _), o in zip(spec.extent(index), spec.origin, strict=True)]
    cut = [slice(max(lo - f, 0), max(min(hi - f, n), 0)) for lo, hi, f, n in zip(box.low, box.high, first, data.shape, strict=True)]
    part = data[tuple(cut)]
    first = [f + c.start for f, c in zip(first, cut, strict=True)]
    flat = part.ravel()
    for lo in range(0, len(flat), BATCH_ROWS):
        at = np.unravel_index(np.arange(lo, min(lo + BATCH_ROWS, len(flat))), part.shape)
        columns = {a: pa.array(at[k] + first[k], pa.int64()) for k, a in enumerate(spec.axes)}
        yield pa.RecordBatch.from_pydict(columns | {value: _column(flat[lo : lo + BATCH_ROWS])})


class ArrayReader(DataSourceReader):
    """Pushed comparisons of coordinates become a box; only chunks that it touches become partitions."""

    def __init__(self, spec: ArraySpec, box: Box, absent: bool, value: str):
        self.spec, self.box, self.absent, self.value = spec, box, absent, value

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            v = getattr(f, "value", None)
            if name not in self.spec.axes or isinstance(v, bool):
                yield f
                continue
            axis = self.spec.axes.index(name)
            if isinstance(f, In) and f.value and all(isinstance(x, int) for x in f.value):
                self.box = self.box.cut(axis, min(f.value), max(f.value) + 1)
                yield f  # what lies between the values
            elif not isinstance(v, int):
                yield f
            elif isinstance(f, EqualTo):
                self.box = self.box.cut(axis, v, v + 1)
            elif isinstance(f, GreaterThan):
                self.box = self.box.cut(axis, v + 1, None)
            elif isinstance(f, GreaterThanOrEqual):
                self.box = self.box.cut(axis, v, None)
            elif isinstance(f, LessThan):
                self.box = self.box.cut(axis, None, v)
            elif isinstance(f, LessThanOrEqual):
                self.box = self.box.cut(axis, None, v + 1)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        total = prod(map(len, self.box.chunks(self.spec)))
        each = max(1, PARTITION_BYTES // max(1, prod(self.spec.chunks) * np.dtype(self.spec.dtype).itemsize))
        return [ChunkRange(lo, min(total, lo + each)) for lo in range(0, total, each)] or [ChunkRange(0, 0)]

    def read(self, partition: ChunkRange) -> Iterator[pa.RecordBatch]:
        files, spans = self.spec.files(), self.box.chunks(self.spec)
        shape = [len(s) for s in spans]
        for k in range(partition.lo, partition.hi):
            index = [s[i] for s, i in zip(spans, np.unravel_index(k, shape), strict=True)]
            yield from voxel_batches(self.spec, files, [int(i) for i in index], self.box, self.absent, self.value)


# Writing ----------------------------------------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    chunks: int


def stage(spec: ArraySpec, batches: Iterator[pa.RecordBatch], job: str, value: str) -> tuple[str, list[int]]:
    """Writes the chunks that hold the rows of ``batches`` beside the array; returns the attempt's name and the chunks.

    Rows may come in any order, but those of a chunk should follow each other:
    then one chunk is held at a time. Voxels of a chunk without a row keep
    what is stored; null values become the fill value; a voxel that comes
    twice takes the later row.
    """
    files, attempt, done = Files(spec.root), uuid.uuid4().hex, []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def name(k: int) -> str:
        return f"{PENDING}/{job}/{attempt}/{k}"

    def opened(k: int) -> tuple[np.ndarray, np.ndarray]:
        index = spec.index(k)
        if k in staged:
            data = LAYOUTS[spec.layout].decode(spec, index, files.get(name(k))).copy()
            return data, np.ones(data.shape, bool)
        return spec.empty(index), np.zeros([hi - lo for lo, hi in spec.extent(index)], bool)

    def flush(keep: int | None) -> None:
        for k in [k for k in held if k != keep]:
            data, known = held.pop(k)
            if not known.all() and (old := spec.load(files, spec.index(k))) is not None:
                data = np.where(known, data, old)
            files.put(name(k), spec.pack(spec.index(k), data))
            if k not in staged:
                staged.add(k)
                done.append(k)

    staged: set[int] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64) - o for a, o in zip(spec.axes, spec.origin, strict=True)])
        if (at < 0).any() or (at >= np.array(spec.shape)[:, None]).any():
            raise ValueError(f"voxels outside of {spec.shape}")
        column = batch.column(value)
        values = (column.fill_null(False if pa.types.is_boolean(column.type) else 0) if column.null_count else column).to_numpy(zero_copy_only=False)
        if column.null_count:
            values = np.where(column.is_null().to_numpy(zero_copy_only=False), spec.fill, values)
        chunk = np.ravel_multi_index(tuple(at // np.array(spec.chunks)[:, None]), spec.grid)
        order = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            mine, k = order[lo:hi], int(chunk[order[lo]])
            if k not in held:
                held[k] = opened(k)
            place = tuple(at[:, mine] % np.array(spec.chunks)[:, None])
            held[k][0][place] = values[mine]
            held[k][1][place] = True
        flush(int(chunk[-1]))
    flush(None)
    return attempt, done


def settle(spec: ArraySpec, job: str, attempt: str, chunks: Iterable[int]) -> None:
    """Renames staged chunks into their places; those that are there already were renamed before."""
    files = Files(spec.root)
    for k in chunks:
        if files.has(staged := f"{PENDING}/{job}/{attempt}/{k}"):
            files.move(staged, spec.key(spec.index(k)))


class ArrayWriter(DataSourceArrowWriter):
    """Tasks stage chunks; the commit names the tasks that count, then renames. :func:`write_array` renames in tasks instead."""

    def __init__(self, spec: ArraySpec, value: str):
        self.spec, self.value, self.job = spec, value, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt, chunks = stage(self.spec, iterator, self.job, self.value)
        return Staged(attempt, len(chunks))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = Files(self.spec.root)
        attempts = [m.attempt for m in messages if m is not None and m.chunks]
        names = {a: [int(n) for n in files.names(f"{PENDING}/{self.job}/{a}")] for a in attempts}
        if sum(map(len, names.values())) != len(set().union(*names.values())):
            self.abort(messages)
            raise ValueError("rows of one chunk came from several tasks: repartition by chunk, or use write_array")
        files.put_whole(f"{PENDING}/{self.job}/committed", json.dumps(attempts).encode())
        finish(self.spec, self.job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Files(self.spec.root).drop(f"{PENDING}/{self.job}")


def finish(spec: ArraySpec, job: str) -> None:
    """Carries a committed write to its end, from wherever it stopped."""
    files = Files(spec.root)
    with ThreadPoolExecutor(32) as pool:
        for attempt in json.loads(files.get(f"{PENDING}/{job}/committed")):
            list(pool.map(lambda k, a=attempt: settle(spec, job, a, [int(k)]), files.names(f"{PENDING}/{job}/{attempt}")))
    files.drop(f"{PENDING}/{job}")


def recover(path: str, discard: bool = False) -> list[str]:
    """Finishes writes that had committed; with ``discard``, removes those that had not (no writer may be running then). Returns the jobs finished."""
    spec = open_array(path)
    files, done = Files(spec.root), []
    for job in files.names(PENDING):
        if files.has(f"{PENDING}/{job}/committed"):
            finish(spec, job)
            done.append(job)
        elif discard:
            files.drop(f"{PENDING}/{job}")
    return done


class ArraySource(DataSource):
    """Options: path; value (column, "v"); absent ("fill", or "skip" for chunks never written); low and high (comma-separated bounds)."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def _spec(self) -> ArraySpec:
        return open_array(self.options["path"])

    def schema(self) -> str:
        spec = self._spec()
        return ", ".join([*(f"`{a}` bigint" for a in spec.axes), f"`{self.options.get('value', 'v')}` {sql_type(spec.dtype)}"])

    def reader(self, schema) -> DataSourceReader:
        spec = self._spec()
        box = Box.whole(spec)
        for axis, (lo, hi) in enumerate(itertools.zip_longest(*(filter(None, self.options.get(k, "").split(",")) for k in ("low", "high")))):
            box = box.cut(axis, None if lo is None else int(lo), None if hi is None else int(hi))
        return ArrayReader(spec, box, self.options.get("absent", "fill") == "fill", self.options.get("value", "v"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        spec = self._spec()
        if overwrite:
            raise ValueError("append to an array; create_array empties one")
        return ArrayWriter(spec, self.options.get("value", "v"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)


def read_array(spark: SparkSession, path: str, box: tuple[Sequence[int], Sequence[int]] | None = None, absent: str = "fill", value: str = "v") -> DataFrame:
    """Voxel rows (the array's axes and ``value``) of a stored array or of a half-open box of it. Comparisons of axes with numbers reach the scan."""
    register(spark)
    reader = spark.read.format(SOURCE).option("path", path).option("absent", absent).option("value", value)
    if box is not None:
        reader = reader.option("low", ",".join(map(str, box[0]))).option("high", ",".join(map(str, box[1])))
    return reader.load()


def chunk_of(spec: ArraySpec):
    """Number of the chunk that a row of voxel coordinates is in, as a Column."""
    out = F.lit(0).cast("bigint")
    for a, o, c, g in zip(spec.axes, spec.origin, spec.chunks, spec.grid, strict=True):
        out = out * g + F.floor((F.col(a) - o) / c).cast("bigint")
    return out


def read_chunks(spec: ArraySpec, chunks: DataFrame, absent: bool = True, value: str = "v") -> DataFrame:
    """Voxel rows of the chunks numbered in column ``chunk``: each task reads its own chunks, whatever their number."""
    box = Box.whole(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = spec.files()
        for batch in batches:
            for k in batch.column("chunk").to_pylist():
                yield from voxel_batches(spec, files, spec.index(k), box, absent, value)

    return chunks.select("chunk").mapInArrow(run, ", ".join([*(f"`{a}` bigint" for a in spec.axes), f"`{value}` {sql_type(spec.dtype)}"]))


def read_points(spark: SparkSession, path: str, points: DataFrame, value: str = "v") -> DataFrame:
    """``points`` (the array's axes and any other columns) with the stored value of each; null outside of the array.

    Only chunks that hold a point are read, once each however many points
    they hold; a point joins by its coordinates, so no chunk gathers its points.
    """
    spec = open_array(path)
    inside = F.lit(True)
    for a, o, n in zip(spec.axes, spec.origin, spec.shape, strict=True):
        inside = inside & (F.col(a) >= o) & (F.col(a) < o + n)
    held = points.where(inside).select(chunk_of(spec).alias("chunk")).distinct()
    return points.join(read_chunks(spec, held, value=value), list(spec.axes), "left")


def _committed(spec: ArraySpec, staging: DataFrame, job: str) -> int:
    """Runs ``staging`` (attempt, chunk of what tasks stage under ``job``) and renames the chunks into place; returns their number.

    When all are staged the job is marked as committed, and only then tasks
    rename: readers see a chunk before or after, and a write that is broken
    off is finished by :func:`recover` or leaves no trace. Nothing but marks
    passes the driver.
    """

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for attempt, k in zip(batch.column("attempt").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                settle(spec, job, attempt, [k])
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files = Files(spec.root)
    try:
        staged = materialized(staging, "staged")
    except Exception:
        files.drop(f"{PENDING}/{job}")
        raise
    attempts = [r["attempt"] for r in staged.select("attempt").distinct().collect()]  # one a task
    files.put_whole(f"{PENDING}/{job}/committed", json.dumps(attempts).encode())
    parts = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = staged.repartition(parts).mapInArrow(moved, "n bigint").agg(F.sum("n")).first()[0]
    files.drop(f"{PENDING}/{job}")
    return done or 0


def write_array(df: DataFrame, path: str, value: str = "v") -> int:
    """Writes voxel rows into a stored array, all together at the end; returns the number of chunks written.

    Rows meet by chunk in one shuffle; each task stages its chunks, one at a time.
    """
    spec, job = open_array(path), uuid.uuid4().hex
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*spec.axes, value, chunk_of(spec).alias("chunk")).repartition(parts, "chunk").sortWithinPartitions("chunk").drop("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, chunks = stage(spec, batches, job, value)
        if chunks:
            yield pa.RecordBatch.from_pydict({"attempt": pa.array([attempt] * len(chunks)), "chunk": pa.array(chunks, pa.int64())})

    return _committed(spec, rows.mapInArrow(run, "attempt string, chunk bigint"), job)


def write_blocks(chunks: DataFrame, path: str, make) -> int:
    """Writes the chunks numbered in column ``chunk``, each as ``make(index)`` makes it in a task; returns their number. No row is shuffled."""
    spec, job = open_array(path), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, attempt = Files(spec.root), uuid.uuid4().hex
        for batch in batches:
            for k in batch.column("chunk").to_pylist():
                index = spec.index(k)
                block = make(index)
                if list(block.shape) != [hi - lo for lo, hi in spec.extent(index)]:
                    raise ValueError(f"a block of {block.shape} for chunk {index}")
                files.put(f"{PENDING}/{job}/{attempt}/{k}", spec.pack(index, block))
            yield pa.RecordBatch.from_pydict({"attempt": pa.array([attempt] * batch.num_rows), "chunk": batch.column("chunk").cast(pa.int64())})

    return _committed(spec, chunks.select("chunk").mapInArrow(run, "attempt string, chunk bigint"), job)


def read_block(spec: ArraySpec, files: Files | ZipFiles, low: Sequence[int], high: Sequence[int]) -> np.ndarray:
    """The values of a half-open box (counted without the origin) as one array, from the chunks that it touches."""
    out = np.full([max(0, hi - lo) for lo, hi in zip(low, high, strict=True)], spec.fill, dtype=spec.dtype)
    for index in itertools.product(*(range(lo // c, -(-hi // c)) for lo, hi, c in zip(low, high, spec.chunks, strict=True))):
        data = spec.load(files, index)
        if data is not None:
            spans = [(max(a, lo), min(b, hi), a, lo) for (a, b), lo, hi in zip(spec.extent(index), low, high, strict=True)]
            out[tuple(slice(f - lo, e - lo) for f, e, _, lo in spans)] = data[tuple(slice(f - a, e - a) for f, e, a, _ in spans)]
    return out


def from_numpy(spark: SparkSession, data: np.ndarray, axes: Sequence[str] = ("c", "z", "y", "x"), value: str = "v") -> DataFrame:
    """Voxel rows of an array in the driver's memory: for small inputs and tests."""
    at = np.unravel_index(np.arange(data.size), data.shape)
    columns = {a: pa.array(at[k], pa.int64()) for k, a in enumerate(axes)} | {value: _column(data.ravel())}
    return spark.createDataFrame(pa.table(columns))


def with_shape(spec: ArraySpec, path: str, **changes) -> ArraySpec:
    """``spec`` at another path, with changed fields."""
    root, adapters, layout = parse_path(path)
    return replace(spec, root=root, adapters=tuple(adapters), layout=layout, **changes)
