"""Masks of planes by active contours: rounds of a morphological level set, then erosion, dilation and filled holes.

Planes are cut into tiles, each one row of arrays. A step sends every tile to
itself and its rim to the tiles around it, so a voxel moves as a few bytes, and
only as often as what it can see grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.segmentation import _block_parts, connected
from gridloom.sources.shared import materialized

AXES = ("x", "y", "z")
#: Neighbours of a voxel on lines through it: right, down, falling and rising.
LINES = ((1, 0), (0, 1), (1, 1), (1, -1))
#: Voxels along x and y, and planes, of a tile.
TILE, PLANES = 64, 32
#: Tiles of a batch that goes to Python.
TILES_A_BATCH = 16

KEYS = ("tz", "tx", "ty")
TILES = "tz bigint, tx bigint, ty bigint, x0 bigint, y0 bigint, z0 bigint, nx int, ny int, nz int, there binary, u binary, v binary"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df``; a row is a tile, so few rows make a batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(TILES_A_BATCH))
    try:
        return materialized(df, name)
    finally:
        conf.set(key, before)


class _Tile:
    """A box of voxels: ``there`` is 0 for none, 1, or 2 for a null value; ``u`` inside or not; ``v`` values (or None)."""

    def __init__(self, low: Sequence[int], there: np.ndarray, u: np.ndarray, v: np.ndarray | None):
        self.low, self.there, self.u, self.v = tuple(low), there, u, v

    @classmethod
    def of(cls, row: dict) -> _Tile:
        shape = (row["nx"], row["ny"], row["nz"])
        there, u = (np.frombuffer(row[c], np.uint8).reshape(shape) for c in ("there", "u"))
        return cls((row["x0"], row["y0"], row["z0"]), there, u, None if row["v"] is None else np.frombuffer(row["v"], np.float64).reshape(shape))

    def row(self, key: Sequence[int]) -> dict:
        arrays = {"there": self.there.astype(np.uint8).tobytes(), "u": self.u.astype(np.uint8).tobytes(), "v": None if self.v is None else self.v.tobytes()}
        return dict(zip(KEYS, key, strict=True)) | dict(zip(("x0", "y0", "z0"), self.low, strict=True)) | dict(zip(("nx", "ny", "nz"), self.there.shape, strict=True)) | arrays

    def cut(self, low: Sequence[int], high: Sequence[int]) -> _Tile:
        """What lies from ``low`` up to ``high`` (x, y) of it."""
        at = tuple(slice(min(max(a - o, 0), n), min(max(b - o, 0), n)) for a, b, o, n in zip(low, high, self.low, self.there.shape, strict=False))
        start = (self.low[0] + at[0].start, self.low[1] + at[1].start, self.low[2])
        return _Tile(start, self.there[at], self.u[at], None if self.v is None else self.v[at])

    def widened(self, halo: int, pieces: list[_Tile]) -> _Tile:
        """It with a rim of ``halo`` voxels that ``pieces`` fill."""
        pad = ((halo, halo), (halo, halo), (0, 0))
        out = _Tile((self.low[0] - halo, self.low[1] - halo, self.low[2]), np.pad(self.there, pad), np.pad(self.u, pad), None if self.v is None else np.pad(self.v, pad))
        for p in pieces:
            to, of = [], []
            for k in range(3):
                lo, hi = max(p.low[k], out.low[k]), min(p.low[k] + p.there.shape[k], out.low[k] + out.there.shape[k])
                to.append(slice(lo - out.low[k], max(hi, lo) - out.low[k]))
                of.append(slice(lo - p.low[k], max(hi, lo) - p.low[k]))
            to, of = tuple(to), tuple(of)
            out.there[to], out.u[to] = p.there[of], p.u[of]
            if out.v is not None:
                out.v[to] = p.v[of]
        return out

    def inner(self, halo: int) -> _Tile:
        n, m = self.there.shape[:2]
        return self.cut((self.low[0] + halo, self.low[1] + halo), (self.low[0] + n - halo, self.low[1] + m - halo))


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({name: pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields})


def _rows_of(df: DataFrame, make: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _table([out for row in batch.to_pylist() for out in make(row)], schema).to_batches()

    return df.mapInArrow(run, schema)


def _tiles(df: DataFrame, value: Callable[[_Tile], _Tile], kind: str) -> DataFrame:
    """Packs voxels (x, y, z, v double) into tiles."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        at = [t.column(a).to_numpy() for a in AXES]
        low = [int(a.min()) for a in at]
        shape = [int(a.max()) - lo + 1 for a, lo in zip(at, low, strict=True)]
        place = tuple(a - lo for a, lo in zip(at, low, strict=True))
        there, v = np.zeros(shape, np.uint8), np.zeros(shape)
        lost = np.asarray(t.column("v").is_null())
        there[place], v[place] = np.where(lost, 2, 1), t.column("v").fill_null(0.0).to_numpy()
        tile = value(_Tile(low, there, np.zeros(shape, np.uint8), v))
        return _table([tile.row([k.as_py() for k in key])], TILES)

    places = [F.col(a).cast("bigint").alias(a) for a in AXES]
    keys = [F.floor(F.col(a) / n).alias(k) for k, a, n in zip(KEYS, ("z", "x", "y"), (PLANES, TILE, TILE), strict=True)]
    rows = df.dropna(subset=list(AXES)).select(*places, F.col(kind).cast("double").alias("v"))
    return _kept(rows.select(*keys, *AXES, "v").groupBy(*KEYS).applyInArrow(pack, TILES), "tiles")


def _stepped(tiles: DataFrame, halo: int, step: Callable[[_Tile, list], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
    """``step`` on each tile with a rim of ``halo`` (TILE at most) voxels; ``more`` (tz, or tz, tx and ty, and an array ``e``) gives it what it needs besides."""

    def send(row: dict) -> list[dict]:
        tile, key, out = _Tile.of(row), [row[k] for k in KEYS], [row | {"own": True}]
        low = (key[1] * TILE, key[2] * TILE)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                at = [(low[k] + TILE - halo, low[k] + TILE) if d > 0 else (low[k], low[k] + halo) if d < 0 else (low[k], low[k] + TILE) for k, d in enumerate((i, j))]
                piece = tile.cut(*zip(*at, strict=True)) if i or j else None
                if piece is not None and piece.there.any():
                    out.append(piece.row((key[0], key[1] + i, key[2] + j)) | {"own": False})
        return out

    sent = _rows_of(tiles, send, f"{TILES}, own boolean") if halo else tiles.withColumn("own", F.lit(True))
    if more is not None:
        kind = more.schema["e"].dataType.simpleString()
        told = more if "tx" in more.columns else tiles.select(*KEYS).join(more, "tz")
        sent = sent.withColumn("e", F.lit(None).cast(kind)).unionByName(told, allowMissingColumns=True)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = [r for r in rows if r["own"]]
        if not own:
            return _table([], schema)
        pieces = [_Tile.of(r) for r in rows if r["own"] is False]
        extra = [e for r in rows if r["own"] is None for e in r["e"]]
        return step(_Tile.of(own[0]).widened(halo, pieces) if halo else _Tile.of(own[0]), extra, [k.as_py() for k in key])

    return sent.groupBy(*KEYS).applyInArrow(run, schema)


def _moved(u: np.ndarray, i: int, j: int) -> np.ndarray:
    """The value at (x + i, y + j); 0 beyond."""
    wide = np.pad(u, ((1, 1), (1, 1), (0, 0)))
    return wide[1 + i : 1 + i + u.shape[0], 1 + j : 1 + j + u.shape[1]]


def _lines(u: np.ndarray, erode: bool) -> np.ndarray:
    """The greatest of the erosions by lines of three, or the least of the dilations."""
    inner, outer = (np.minimum, np.maximum) if erode else (np.maximum, np.minimum)
    return outer.reduce([inner(u, inner(_moved(u, i, j), _moved(u, -i, -j))) for i, j in LINES])


def _slope(u: np.ndarray, there: np.ndarray, axis: int) -> np.ndarray:
    """The size of the slope along an axis between the voxels before and after; at an end, to the one there is."""
    u, there = np.moveaxis(u.astype(np.int8), axis, 0), np.moveaxis(there > 0, axis, 0)
    beside = []
    for order in (range(len(u)), range(len(u) - 1, -1, -1)):
        last, out = np.full(u.shape[1:], -1, np.int8), np.empty_like(u)
        for i in order:
            out[i] = last
            last = np.where(there[i], u[i], last)
        beside.append(out)
    before, after = beside
    slope = np.where(before < 0, np.where(after < 0, 0, after - u), np.where(after < 0, u - before, (after - before) / 2))
    return np.moveaxis(np.abs(slope), 0, axis)


def _steps(seeds: np.ndarray, there: np.ndarray) -> np.ndarray:
    """City-block distance of each voxel to the nearest seed: along x, then along y."""
    d = np.where(seeds & (there > 0), 0.0, np.inf)
    for axis in (0, 1):
        line = np.moveaxis(d, axis, 0)
        for order in (range(1, len(line)), range(len(line) - 2, -1, -1)):
            for i in order:
                np.minimum(line[i], line[i - order.step] + 1, out=line[i])
        d[there == 0] = np.inf
    return d


def _started(df: DataFrame, square: int, value: str) -> DataFrame:
    def chequered(t: _Tile) -> _Tile:
        x, y = (np.arange(n) + lo for n, lo in zip(t.there.shape[:2], t.low[:2], strict=True))
        u = ((x[:, None] // square + y // square) % 2).astype(np.uint8)[:, :, None]
        return _Tile(t.low, t.there, np.where(t.there > 0, u, 0), t.v)

    return _tiles(df, chequered, value)


def _contour(df: DataFrame, rounds: int, smoothing: int, square: int, value: str) -> DataFrame:
    now, turn = _started(df, square, value), 0
    halo = 1 + 2 * smoothing
    if halo > TILE:
        raise ValueError(f"smoothing of {smoothing}")

    def sums(row: dict) -> list[dict]:
        t = _Tile.of(row)
        out = []
        for k in range(t.there.shape[2]):
            there, u, v = t.there[:, :, k], t.u[:, :, k], t.v[:, :, k]
            if there.any():
                in_ = [(there > 0) & (u == side) for side in (0, 1)]
                out.append({"tz": row["tz"], "z": t.low[2] + k} | {f"s{side}": float(v[m & (there == 1)].sum()) for side, m in enumerate(in_)} | {f"n{side}": int(m.sum()) for side, m in enumerate(in_)})
        return out

    for _ in range(rounds):
        parts = _rows_of(now, sums, "tz bigint, z bigint, s0 double, s1 double, n0 bigint, n1 bigint")
        mean = lambda k: (F.sum(f"s{k}") / (F.sum(f"n{k}") + 1e-8)).alias(f"c{k}")
        means = _kept(parts.groupBy("tz", "z").agg(mean(0), mean(1)), "means").groupBy("tz").agg(F.collect_list(F.struct("z", "c0", "c1")).alias("e"))  # PLANES at most

        def step(t: _Tile, extra: list, key: list, turn: int = turn) -> pa.Table:
            c0, c1 = (np.zeros(t.there.shape[2]) for _ in range(2))
            for e in extra:
                if 0 <= e["z"] - t.low[2] < len(c0):
                    c0[e["z"] - t.low[2]], c1[e["z"] - t.low[2]] = e["c0"], e["c1"]
            steep = _slope(t.u, t.there, 0) + _slope(t.u, t.there, 1)
            with np.errstate(all="ignore"):
                pull = steep * ((t.v - c1) ** 2 - (t.v - c0) ** 2)
            u = np.where(pull < 0, 1, np.where((pull > 0) | np.isnan(pull), 0, t.u))
            u = np.where(t.there == 2, t.u, u).astype(np.uint8) * (t.there > 0)
            for k in range(smoothing):
                for erode in ((turn + k) % 2 == 1, (turn + k) % 2 == 0):
                    u = _lines(u, erode) * (t.there > 0)
            return _table([_Tile(t.low, t.there, u, t.v).inner(halo).row(key)], TILES)

        now = _kept(_stepped(now, halo, step, TILES, means), "contour")
        turn += smoothing
    return now


def _voxels(t: _Tile, name: str) -> pa.Table:
    at = np.nonzero(t.there)
    return pa.table({a: pa.array(p + lo, pa.int64()) for a, p, lo in zip(AXES, at, t.low, strict=True)} | {name: pa.array(t.u[at].astype(bool)) if name == "mask" else pa.array(t.u[at].astype(np.int32))})


def chan_vese(df: DataFrame, rounds: int, smoothing: int = 1, square: int = 5, value: str = "v") -> DataFrame:
    """x, y, z, u: 1 inside and 0 outside of a contour in each plane, from a chequered start of squares.

    Each round lets voxels at the contour go to the side whose mean is nearer
    to their value, and smooths it by lines, opening and closing in turn.
    Planes must be without gaps, with each voxel once; voxels with a null
    coordinate are left out. The means are one row a plane.
    """
    return _stepped(_contour(df, rounds, smoothing, square, value), 0, lambda t, extra, key: _voxels(t, "u"), "x bigint, y bigint, z bigint, u int")


def _open_parts(tiles: DataFrame, shape: Sequence[int]) -> DataFrame:
    """tz, tx, ty, e: the parts outside of a tile's mask that reach a tile's rim and, from there, the plane's edge."""

    def rims(row: dict) -> list[dict]:
        t = _Tile.of(row)
        at, part, open_ = _outside(t, shape)
        x, y, z = (p + lo for p, lo in zip(at, t.low, strict=True))
        is_open = dict.fromkeys(open_.tolist())
        out = []
        for side, rim in enumerate(((x % TILE == 0) & (x > 0), (x + 1) % TILE == 0, (y % TILE == 0) & (y > 0), (y + 1) % TILE == 0)):
            for k in np.flatnonzero(rim).tolist():
                out.append({k_: row[k_] for k_ in KEYS} | {"side": side, "x": int(x[k]), "y": int(y[k]), "z": int(z[k]), "part": int(part[k]), "open": int(part[k]) in is_open})
        return out

    found = _kept(_rows_of(tiles, rims, "tz bigint, tx bigint, ty bigint, side int, x bigint, y bigint, z bigint, part bigint, open boolean"), "rims")
    links = None
    for low, a in ((0, "x"), (2, "y")):
        high = found.where(F.col("side") == low + 1).select(*[(F.col(c) + 1).alias(c) if c == a else F.col(c) for c in AXES], F.col("part").alias("a"))
        met = high.join(found.where(F.col("side") == low).select(*AXES, F.col("part").alias("b")), list(AXES)).select("a", "b")
        links = met if links is None else links.unionByName(met)
    roots = connected(links).withColumnRenamed("node", "part")
    placed = found.groupBy(*KEYS, "part").agg(F.max("open").alias("open")).join(roots, "part", "left").withColumn("component", F.coalesce("component", "part"))
    placed = materialized(placed, "parts")
    open_ = placed.where("open").select("component").distinct()
    return placed.join(open_, "component", "left_semi").groupBy(*KEYS).agg(F.collect_set("part").alias("e"))  # at most a rim's voxels


def _outside(t: _Tile, shape: Sequence[int]) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Voxels of a tile outside of its mask, the part of each (its least voxel's number), and the parts at the plane's edge."""
    at = np.nonzero((t.there > 0) & (t.u == 0))
    if not len(at[0]):
        return at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.stack([p + lo for p, lo in zip(at, t.low, strict=True)]).astype(np.int64)
    number = (places[2] * shape[1] + places[1]) * shape[0] + places[0]
    part = _block_parts(places, np.zeros(len(number), np.int64), number, (shape[0], shape[1], 1))
    edge = (places[0] == 0) | (places[0] == shape[0] - 1) | (places[1] == 0) | (places[1] == shape[1] - 1)
    return at, part, np.unique(part[edge])


def contour_mask(df: DataFrame, shape: Sequence[int], background: tuple[int, int] | None = None, rounds: int = 2, erosions: int = 10, dilations: int = 10, holes: bool = True, value: str = "v") -> DataFrame:
    """x, y, z, mask of each plane of a volume of ``shape``: :func:`chan_vese`, turned over where ``background`` (x, y) is inside, worn off, grown, and its holes filled.

    Erosion and dilation by k face neighbours are thresholds of one city-block
    distance each; what lies beyond the plane counts as outside.
    """
    tiles = _contour(df, rounds, 1, 5, value).withColumn("v", F.lit(None).cast("binary"))
    turned = None
    if background is not None:
        bx, by = background

        def inside(row: dict) -> list[dict]:
            t = _Tile.of(row)
            i, j = bx - t.low[0], by - t.low[1]
            held = 0 <= i < t.there.shape[0] and 0 <= j < t.there.shape[1]
            return [{"tz": row["tz"], "z": t.low[2] + k} for k in np.flatnonzero(t.u[i, j]).tolist()] if held else []

        turned = _kept(_rows_of(tiles.where((F.col("tx") == bx // TILE) & (F.col("ty") == by // TILE)), inside, "tz bigint, z bigint"), "turned")
        turned = turned.groupBy("tz").agg(F.collect_list(F.struct("z")).alias("e"))  # PLANES at most

    todo = [(k, n) for k, n in enumerate((erosions, dilations)) if n > 0]
    reaches = [(k, min(TILE, n - lo)) for k, n in todo for lo in range(0, n, TILE)] or ([(1, 0)] if turned is not None else [])
    while reaches:
        some = []
        while reaches and sum(n for _, n in some) + reaches[0][1] <= TILE:
            some.append(reaches.pop(0))
        halo = sum(n for _, n in some)

        def step(t: _Tile, extra: list, key: list, some: list = some, halo: int = halo) -> pa.Table:
            m = t.u > 0
            for e in extra:
                if 0 <= (k := e["z"] - t.low[2]) < m.shape[2]:
                    m[:, :, k] = ~m[:, :, k]
            x, y = (np.arange(n) + lo for n, lo in zip(t.there.shape[:2], t.low[:2], strict=True))
            edge = np.minimum(np.minimum(x + 1, shape[0] - x)[:, None], np.minimum(y + 1, shape[1] - y))[:, :, None]
            for way, n in some:
                m = m & (t.there > 0)
                if n and way == 0:
                    m = np.minimum(_steps(~m, t.there), edge) > n
                elif n:
                    m = _steps(m, t.there) <= n
            return _table([_Tile(t.low, t.there, m & (t.there > 0), None).inner(halo).row(key)], TILES)

        tiles, turned = _kept(_stepped(tiles, halo, step, TILES, turned), "mask"), None

    def filled(t: _Tile, extra: list, key: list) -> pa.Table:
        if not holes:
            return _voxels(t, "mask")
        at, part, open_ = _outside(t, shape)
        u = t.u.copy()
        u[at] = ~np.isin(part, np.union1d(open_, np.array(extra, np.int64)))
        return _voxels(_Tile(t.low, t.there, u, None), "mask")

    wide = holes and (shape[0] > TILE or shape[1] > TILE)
    return _stepped(tiles, 0, filled, "x bigint, y bigint, z bigint, mask boolean", _open_parts(tiles, shape) if wide else None)
