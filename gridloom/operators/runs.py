"""Runs of operator chains from one stored array to another, of which only missing chunks are made."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.specs import merged_spec
from gridloom.operators.registry import AXES, OPS, Bounds, apply, build, input_box, output_shape
from gridloom.sources import arrays
from gridloom.sources.arrays import ArraySpec, Box, Files
from gridloom.sources.shared import materialized

#: The bounds of a piece, which are its key.
KEYS = tuple(f"_{a}{e}" for a in AXES for e in (0, 1))
_LOG = "materialize_log.json"


@dataclass(frozen=True)
class Report:
    """Chunks of the output, those that were missing, the pieces that they made up and the input chunks read for them (None: all)."""

    chunks: int
    missing: int
    pieces: int
    read: int | None


def _xyz(spec: ArraySpec, values: Sequence[int]) -> tuple[int, int, int]:
    return tuple(values[spec.axes.index(a)] for a in AXES)


def output_spec(source: ArraySpec, path: str, shape: Sequence[int], overrides: Mapping[str, Any] | None = None) -> ArraySpec:
    """The output's description: the input's, with the chain's shape and ``overrides`` (dtype, chunks, fill, codec, level, attributes), see :func:`merged_spec`."""
    given = {"dtype": source.dtype, "chunks": list(source.chunks), "fill": source.fill, "codec": source.codec, "level": source.level, "attributes": dict(source.attributes)}
    spec = merged_spec(dict(given), overrides or {}, given)
    whole = [dict(zip(AXES, shape, strict=True)).get(a, 1) for a in source.axes]
    defaults = {"dtype": source.dtype, "chunks": source.chunks, "codec": "raw", "fill": 0, "level": None, "attributes": {}}
    spec = defaults | spec
    return arrays.array_spec(path, source.axes, whole, spec["chunks"], spec["dtype"], fill=spec["fill"], codec=spec["codec"], level=spec["level"], attributes=spec["attributes"])


def missing_chunks(spark: SparkSession, spec: ArraySpec, nonzero: bool = False) -> DataFrame:
    """Numbers (``chunk``) of the chunks that were never written, or with ``nonzero`` hold nothing but zeros. Tasks look; the driver lists nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = spec.files()
        for batch in batches:
            gone = []
            for k in batch.column("id").to_pylist():
                if not files.has(spec.key(spec.index(k))):
                    gone.append(k)
                elif nonzero and not float(np.asarray(spec.load(files, spec.index(k)), dtype=float).sum()):
                    gone.append(k)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(gone, pa.int64())})

    return spark.range(int(np.prod(spec.grid))).mapInArrow(run, "chunk bigint")


def _pieces(missing: DataFrame, target: ArraySpec) -> DataFrame:
    """Boxes (KEYS) of missing chunks, those next to each other along the fastest axis in one."""
    last = target.grid[-1]
    row, place = F.floor(F.col("chunk") / last), F.col("chunk") % last
    run = place - F.row_number().over(Window.partitionBy(row).orderBy(place))
    ends = missing.select(row.alias("row"), place.alias("place"), run.alias("run")).groupBy("row", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int]] = {k: [] for k in KEYS}
            for r, first, end in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "last")), strict=True):
                low, high = target.extent(target.index(r * last + first)), target.extent(target.index(r * last + end))
                for a, (lo, _), (_, hi) in zip(AXES, _xyz(target, low), _xyz(target, high), strict=True):
                    out[f"_{a}0"].append(lo)
                    out[f"_{a}1"].append(hi)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return ends.mapInArrow(bounds, ", ".join(f"{k} bigint" for k in KEYS))


def _inputs(pieces: DataFrame, source: ArraySpec, steps: Sequence, channel: int) -> DataFrame:
    """chunk, parts: the input chunks that pieces need, each with the pieces (bounds of output, then of input) that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, parts = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in KEYS), strict=True):
                need = input_box(steps, tuple(zip(row[::2], row[1::2], strict=True)))
                spans = []
                for a, c in zip(source.axes, source.chunks, strict=True):
                    lo, hi = need[AXES.index(a)] if a in AXES else (channel, channel + 1)
                    spans.append(range(lo // c, -(-hi // c)))
                for index in product(*spans):
                    chunks.append(int(np.ravel_multi_index(index, source.grid)))
                    parts.append([*row, *(e for span in need for e in span)])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int64()), "part": pa.array(parts, pa.list_(pa.int64()))})

    return pieces.mapInArrow(run, "chunk bigint, part array<bigint>").groupBy("chunk").agg(F.collect_list("part").alias("parts"))


def _voxels(inputs: DataFrame, source: ArraySpec, channel: int) -> DataFrame:
    """Voxel rows of each piece, under its KEYS: an input chunk is read once and goes to all pieces that it is needed for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = source.files()
        for batch in batches:
            for chunk, parts in zip(batch.column("chunk").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                index = source.index(chunk)
                for part in parts:
                    need = dict(zip(AXES, zip(part[6::2], part[7::2], strict=True), strict=True))
                    spans = [need.get(a, (channel, channel + 1)) for a in source.axes]
                    box = Box(tuple(lo + o for (lo, _), o in zip(spans, source.origin, strict=True)), tuple(hi + o for (_, hi), o in zip(spans, source.origin, strict=True)))
                    for rows in arrays.voxel_batches(source, files, index, box, True, "v"):
                        keys = {k: pa.array(np.full(rows.num_rows, v)) for k, v in zip(KEYS, part, strict=False)}
                        places = {a: pa.array(rows.column(a).to_numpy() - source.origin[source.axes.index(a)]) for a in AXES}
                        yield pa.RecordBatch.from_pydict(keys | places | {"v": rows.column("v").cast(pa.float64())})

    return inputs.mapInArrow(run, ", ".join([*(f"{k} bigint" for k in (*KEYS, *AXES)), "v double"]))


def _stored(df: DataFrame, target: ArraySpec, channel: int) -> DataFrame:
    """Voxel rows (x, y, z, v) as the target takes them."""
    kind = np.dtype(target.dtype).kind
    v = F.rint("v").cast("bigint") if kind in "iu" else F.col("v") != 0 if kind == "b" else F.col("v")
    return df.select(*[F.col(a) if a in AXES else F.lit(channel).cast("bigint").alias(a) for a in target.axes], v.alias("v"))


def run_chain(
    spark: SparkSession, source: str, chain: str | Sequence[Mapping[str, Any]], target: str, overrides: Mapping[str, Any] | None = None, resume: bool = True, nonzero: bool = False, channel: int = 0, max_chunk_bytes: int = 4_000_000_000, ops=OPS,
) -> Report:
    """Applies a chain to the stored array at ``source`` and stores the result at ``target``.

    With ``resume``, only chunks that are not there yet (with ``nonzero``:
    that hold only zeros) are made. They become pieces, each a volume of its
    own with the context that the chain needs around it, so input chunks that
    no piece needs are never opened. A chain with an operator over the whole
    volume reads all of the input, but writes missing chunks only. Values are
    computed as doubles; integer targets take them rounded half to even.
    Chunks are renamed into place together at the end (see ``write_array``),
    and a log is written after them.
    """
    arrays.recover(target) if resume and _there(target) else None
    spec = arrays.open_array(source)
    if set(AXES) - set(spec.axes) or not 0 <= channel < dict(zip(spec.axes, spec.shape, strict=True)).get("c", 1):
        raise ValueError(f"axes {spec.axes} without x, y and z, or no channel {channel}")
    shape = _xyz(spec, spec.shape)
    steps = build(chain, shape, ops)
    out = output_spec(spec, target, output_shape(steps, shape), overrides)
    if np.prod(out.chunks) * np.dtype(out.dtype).itemsize > max_chunk_bytes:
        raise ValueError(f"a chunk of {out.chunks} exceeds {max_chunk_bytes} bytes")
    out = arrays.create_array(out, delete_existing=not resume)
    missing = materialized(missing_chunks(spark, out, nonzero), "missing")
    n = missing.count()
    report = Report(int(np.prod(out.grid)), n, 0, 0)
    if n:
        whole: Bounds = tuple((0, m) for m in output_shape(steps, shape))
        if input_box(steps, whole) is None:
            box = None if "c" not in spec.axes else tuple(zip(*((o + (channel if a == "c" else 0), o + (channel + 1 if a == "c" else m)) for a, o, m in zip(spec.axes, spec.origin, spec.shape, strict=True)), strict=True))
            rows = arrays.read_array(spark, source, box)
            rows = rows.select(*[(F.col(a) - spec.origin[spec.axes.index(a)]).alias(a) for a in AXES], F.col("v").cast("double").alias("v"))
            done = _stored(apply(rows, steps), out, 0)
            done = done.join(missing, arrays.chunk_of(out) == missing["chunk"], "left_semi")
            report = Report(report.chunks, n, 0, None)
        else:
            pieces = materialized(_pieces(missing, out), "pieces")
            inputs = materialized(_inputs(pieces, spec, steps, channel), "inputs")
            done = apply(_voxels(inputs, spec, channel), steps, KEYS)
            for a in AXES:
                done = done.where((F.col(a) >= F.col(f"_{a}0")) & (F.col(a) < F.col(f"_{a}1")))
            done = _stored(done, out, 0)
            report = Report(report.chunks, n, pieces.count(), inputs.count())
        arrays.write_array(done, target)
    log = {"source": source, "chain": chain if isinstance(chain, str) else list(chain), "channel": channel} | asdict(report)
    Files(out.root).put_whole(_LOG, json.dumps(log).encode())
    return report


def _there(path: str) -> bool:
    try:
        arrays.open_array(path)
    except FileNotFoundError:
        return False
    return True


def run_pyramid(spark: SparkSession, source: str, target: str, factors: Sequence[Sequence[int]], how: str = "mean", layout: str = "zarr", resume: bool = True, overrides: Mapping[str, Any] | None = None) -> list[Report]:
    """Levels s0, s1, ... below ``target`` (a root), each from the one before by ``factors`` (x, y, z); metadata of all scales stands beside them."""
    reports, before, total = [], source, np.ones(3, int)
    scales = []
    for k, f in enumerate([(1, 1, 1), *factors]):
        path = f"{target}/s{k}|{layout}:"
        chain = f"down('{how}', x={f[0]}, y={f[1]}, z={f[2]})" if k else ""
        reports.append(run_chain(spark, before, chain, path, overrides, resume, channel=0))
        total, before = total * np.array(f), path
        scales.append({"path": f"s{k}", "downsample_factors": total.tolist()})
    root = arrays.parse_path(f"{target}|{layout}:")[0]
    Files(root).put_whole("attributes.json", json.dumps({"axes": list(AXES), "scales": scales}).encode())
    return reports


def open_described(spark: SparkSession, descriptor: str | Mapping[str, Any], box: Bounds | None = None, channel: int = 0, ops=OPS) -> DataFrame:
    """Voxel rows of a descriptor {"source": path, "chain": ...} (also as JSON), lazily; for a ``box`` of the result only what it needs is read."""
    d = json.loads(descriptor) if isinstance(descriptor, str) else descriptor
    spec = arrays.open_array(d["source"])
    shape = _xyz(spec, spec.shape)
    steps = build(d.get("chain") or "", shape, ops)
    need = input_box(steps, box) if box is not None else None
    spans = [(need[AXES.index(a)] if need is not None and a in AXES else (0, n)) if a != "c" else (channel, channel + 1) for a, n in zip(spec.axes, spec.shape, strict=True)]
    rows = arrays.read_array(spark, d["source"], tuple(zip(*((o + lo, o + hi) for (lo, hi), o in zip(spans, spec.origin, strict=True)), strict=True)))
    rows = rows.select(*[(F.col(a) - spec.origin[spec.axes.index(a)]).alias(a) for a in AXES], F.col("v").cast("double").alias("v"))
    out = apply(rows, steps)
    for a, (lo, hi) in zip(AXES, box or (), strict=False):
        out = out.where((F.col(a) >= lo) & (F.col(a) < hi))
    return out
