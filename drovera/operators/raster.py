"""Elevation rasters as cell tables: profile, mosaic, slope, windows and sampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..session import spread
from . import runs
from .tiles import TILE, tile_of, with_meta

#: Grid cells that one task of a mosaic makes, about.
GRID_CELLS = 4_000_000
#: Rows whose spans are cut together.
SLICE = 2_500


def raster_profile(
    cells: DataFrame, *, keys: Sequence[str] = ("dem_id",), value: str = "elev",
    nodata: str = "nodata"
) -> DataFrame:
    """Size, missing cells, type and range per raster or tile."""
    dtype = dict(cells.dtypes)[value]
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col(nodata) == 1).alias("nodata_count"),
        (F.count_if(F.col(nodata) == 1) / F.count(F.lit(1)) * 100).alias("nodata_pct"),
        F.lit(dtype).alias("dtype"),
        F.min(value).alias("min_elev"),
        F.max(value).alias("max_elev"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Stack raster sources on a common grid; each must carry its ``source_rank``."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def mosaic_dem(
    cells: DataFrame,
    *,
    keys: Sequence[str] = ("dem_id",),
    source_rank: str = "source_rank",
    sentinel: float | None = None,
    full_extent: bool = True,
) -> DataFrame:
    """Merge sources cell by cell; the valid value of the lowest rank wins.

    NaN, null and the sentinel are missing. A cell no source fills has elevation 0 and nodata 1,
    also where no source has the cell at all (``full_extent``): the empty grid joins the stack
    before the one aggregation. It is made tile by tile, ``GRID_CELLS`` cells a task; counting them is a job.
    """
    elev = F.col("elev")
    valid = elev.isNotNull() & ~F.isnan(elev)
    if sentinel is not None:
        valid = valid & (elev != float(sentinel))
    stack = cells.select(*keys, "row", "col", F.when(valid, elev).alias("elev"),
                         F.col(source_rank).alias("_rank"))
    if full_extent:
        box = cells.groupBy(*keys).agg(
            F.min("row").alias("r0"), F.max("row").alias("r1"),
            F.min("col").alias("c0"), F.max("col").alias("c1"),
        )
        size = (F.col("r1") - F.col("r0") + 1).cast("bigint") * (F.col("c1") - F.col("c0") + 1)
        total = box.agg(F.sum(size)).first()[0] or 0
        # a directory of tiles, dealt by a stated count: none of its tasks makes more than its tiles
        at = lambda lo, hi: F.explode(F.sequence(tile_of(lo), tile_of(hi)))
        places = box.select("*", at("r0", "r1").alias("_tr")).select("*", at("c0", "c1").alias("_tc"))
        dealt = places.repartition(max(1, -(-int(total) // GRID_CELLS)), *keys, "_tr", "_tc")
        within = lambda lo, hi, t: F.sequence(
            F.greatest(F.col(lo), F.col(t) * TILE), F.least(F.col(hi), F.col(t) * TILE + (TILE - 1))
        )
        grid = dealt.select("*", F.explode(within("r0", "r1", "_tr")).alias("row")).select(
            *keys, "row", F.explode(within("c0", "c1", "_tc")).alias("col"),
            F.lit(None).cast("double").alias("elev"), F.lit(None).cast("int").alias("_rank"),
        )
        stack = stack.unionByName(grid)
    best = F.min_by("elev", F.when(F.col("elev").isNotNull(), F.col("_rank")))
    merged = stack.groupBy(*keys, "row", "col").agg(best.alias("_e"))
    return merged.select(
        *keys, "row", "col",
        F.coalesce("_e", F.lit(0.0)).alias("elev"),
        F.col("_e").isNull().cast("int").alias("nodata"),
    )


def _with_tile_halo(cells: DataFrame, tile: int) -> DataFrame:
    """Tile coordinates, with border cells copied to the (up to three) tiles they touch."""

    def near(axis: str) -> Column:
        own = F.floor(F.col(axis) / tile)
        pos = F.pmod(F.col(axis), F.lit(tile))
        return F.array_compact(
            F.array(
                own,
                F.when(pos == 0, own - 1),
                F.when(pos == tile - 1, own + 1),
            )
        )

    return (
        cells.withColumn("_tr", F.explode(near("row")))
        .withColumn("_tc", F.explode(near("col")))
        .withColumn(
            "_own",
            (F.floor(F.col("row") / tile) == F.col("_tr"))
            & (F.floor(F.col("col") / tile) == F.col("_tc")),
        )
    )


def slope_gradients(
    cells: DataFrame,
    *,
    pixel_m: float | str,
    keys: Sequence[str] = ("dem_id",),
    tile: int = TILE,
) -> DataFrame:
    """Horn's 3x3 gradients dx, dy, borders replicated.

    Cells are shuffled once, by tile with a one-cell halo, so a task never holds more than
    (tile + 2)^2 cells of a raster of any size. The kernel is separable: a vertical pass gives the
    weighted sum and the difference of each column, a horizontal pass combines three columns.
    """
    tiles = _with_tile_halo(cells, tile).repartition(*keys, "_tr", "_tc")
    part = [*keys, "_tr", "_tc"]
    down = Window.partitionBy(*part, "col").orderBy("row")
    up_e = F.when(F.lag("row").over(down) == F.col("row") - 1, F.lag("elev").over(down))
    dn_e = F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("elev").over(down))
    v = tiles.withColumns({"_u": up_e, "_d": dn_e})
    u, d, e = F.coalesce("_u", "elev"), F.coalesce("_d", "elev"), F.col("elev")
    v = v.withColumns({"_s": u + 2 * e + d, "_g": d - u}).drop("_u", "_d")

    across = Window.partitionBy(*part, "row").orderBy("col")
    has_l = F.lag("col").over(across) == F.col("col") - 1
    has_r = F.lead("col").over(across) == F.col("col") + 1
    h = v.withColumns(
        {
            "_sl": F.when(has_l, F.lag("_s").over(across)),
            "_sr": F.when(has_r, F.lead("_s").over(across)),
            "_gl": F.when(has_l, F.lag("_g").over(across)),
            "_gr": F.when(has_r, F.lead("_g").over(across)),
        }
    ).filter("_own")
    scale = 8 * (F.col(pixel_m) if isinstance(pixel_m, str) else F.lit(float(pixel_m)))
    dx = (F.coalesce("_sr", "_s") - F.coalesce("_sl", "_s")) / scale
    dy = (F.coalesce("_gl", "_g") + 2 * F.col("_g") + F.coalesce("_gr", "_g")) / scale
    return h.withColumns({"dx": dx, "dy": dy}).drop(
        "_tr", "_tc", "_own", "_s", "_g", "_sl", "_sr", "_gl", "_gr"
    )


def slope_mask(
    cells: DataFrame,
    *,
    pixel_m: float | str,
    threshold_deg: float = C.SLOPE_THRESHOLD_DEG,
    keys: Sequence[str] = ("dem_id",),
    tile: int = TILE,
    out: str = "slope",
) -> DataFrame:
    """1 where the terrain is steeper than the threshold; 90 degrees or more marks nothing."""
    if threshold_deg >= 90.0:
        return cells.withColumn(out, F.lit(0))
    limit = math.tan(math.radians(threshold_deg)) ** 2
    g = slope_gradients(cells, pixel_m=pixel_m, keys=keys, tile=tile)
    steep = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") > F.lit(limit)
    return g.withColumn(out, steep.cast("int")).drop("dx", "dy")


def _invert(x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row) as reals from map coordinates, by the affine columns a..f."""
    a, b, c, d, e, f = (F.col(k) for k in "abcdef")
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def dem_window(
    pose: DataFrame,
    dem_meta: DataFrame,
    *,
    buffer_scale: float = C.DEM_BUFFER_SCALE,
    lon: str = "longitude",
    lat: str = "latitude",
    keys: Sequence[str] = ("dem_id",),
) -> DataFrame:
    """Square odd window of cells around the drone that holds the frame in any rotation.

    ``pose`` carries the frame corners (``ul_lon`` ...) and the raster's key. Adds the cell range,
    its geographic bounds and whether it stays on the raster.
    """
    described = [c for c in dem_meta.columns if c not in keys]
    df = with_meta(pose, dem_meta, described, by=[lon, lat, "ul_lon", "ul_lat"], keys=keys)
    centre_col, centre_row = _invert(F.col(lon), F.col(lat))
    rows, cols = [], []
    for k in ("ul", "ur", "br", "bl"):
        cc, rr = _invert(F.col(f"{k}_lon"), F.col(f"{k}_lat"))
        rows.append(F.floor(rr))
        cols.append(F.floor(cc))
    longest = F.greatest(
        F.greatest(*rows) - F.least(*rows), F.greatest(*cols) - F.least(*cols), F.lit(1)
    )
    scale = max(float(buffer_scale), 0.5)
    df = df.withColumns(
        {
            "_cr": F.floor(centre_row), "_cc": F.floor(centre_col),
            "half_size": F.ceil(longest * (0.5 + scale)),
        }
    )
    df = df.withColumns(
        {
            "window_size": 2 * F.col("half_size") + 1,
            "row0": F.col("_cr") - F.col("half_size"), "row1": F.col("_cr") + F.col("half_size"),
            "col0": F.col("_cc") - F.col("half_size"), "col1": F.col("_cc") + F.col("half_size"),
        }
    )
    a, b, c, d, e, f = (F.col(k) for k in "abcdef")
    left, right = F.col("col0"), F.col("col1") + 1
    top, bottom = F.col("row0"), F.col("row1") + 1
    xs = [a * x + b * y + c for x in (left, right) for y in (top, bottom)]
    ys = [d * x + e * y + f for x in (left, right) for y in (top, bottom)]
    on_raster = (
        (F.col("row0") >= 0) & (F.col("col0") >= 0)
        & (F.col("row1") < F.col("height")) & (F.col("col1") < F.col("width"))
    )
    return df.withColumns(
        {
            "min_lon": F.least(*xs), "max_lon": F.greatest(*xs),
            "min_lat": F.least(*ys), "max_lat": F.greatest(*ys),
            "on_raster": on_raster,
        }
    ).drop("_cr", "_cc", *"abcdef", "width", "height", "crs")


def dem_window_cells(
    windows: DataFrame,
    cells: DataFrame,
    *,
    keys: Sequence[str] = ("dem_id",),
    window_keys: Sequence[str] = ("flight_id", "frame_id"),
) -> DataFrame:
    """Cells of each window. Outside the raster elevation is 0 and nodata is 1."""
    grid = (
        windows.select(*window_keys, *keys, "col0", "col1",
                       F.explode(F.sequence("row0", "row1")).alias("row"))
        .withColumn("col", F.explode(F.sequence("col0", "col1")))
        .drop("col0", "col1")
    )
    return grid.join(cells, [*keys, "row", "col"], "left").withColumns(
        {
            "elev": F.coalesce("elev", F.lit(0.0)),
            "nodata": F.coalesce("nodata", F.lit(1)),
        }
    )


def pixel_to_cell(
    points: DataFrame,
    dem_meta: DataFrame,
    *,
    px: str = "x",
    py: str = "y",
    keys: Sequence[str] = ("dem_id",),
) -> DataFrame:
    """Raster cell under the centre of a frame pixel: frame affine, then inverse raster affine."""
    x, y = F.col(px) + 0.5, F.col(py) + 0.5
    lon = F.col("aff_a") * x + F.col("aff_b") * y + F.col("aff_c")
    lat = F.col("aff_d") * x + F.col("aff_e") * y + F.col("aff_f")
    df = with_meta(points, dem_meta, list("abcdef"), by=[px, py, "aff_c", "aff_f"], keys=keys)
    col, row = _invert(lon, lat)
    return df.withColumns({"row": F.floor(row), "col": F.floor(col)}).drop(*"abcdef")


def sample_raster(
    points: DataFrame,
    cells: DataFrame,
    *,
    keys: Sequence[str] = ("dem_id",),
    cols: Sequence[str] = ("elev", "nodata"),
    distinct: bool = False,
) -> DataFrame:
    """Nearest cell values for points that already carry ``row`` and ``col``.

    The join key is the cell, which spreads a raster evenly. The cell side has one row per key, so
    if many points share one cell AQE may split the point side of that partition freely. With
    ``distinct`` repeated points are merged before they are shuffled.
    """
    pts = points.distinct() if distinct else points
    return pts.join(cells.select(*keys, "row", "col", *cols), [*keys, "row", "col"], "left")


def compute_once_per_pose(
    frames: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    *,
    pose: Sequence[str] = ("latitude", "longitude", "rel_alt", "gb_yaw"),
) -> DataFrame:
    """Evaluate ``fn`` once per distinct pose and attach its columns to every frame of that pose.

    A hovering drone repeats one pose for long; the distinct is combined before the shuffle and
    the join back has one hot side only, which AQE splits.
    """
    poses = frames.select(*pose).distinct()
    layers = fn(poses)
    cond = None
    renamed = layers.select(
        *[F.col(p).alias(f"_p_{p}") for p in pose], *[c for c in layers.columns if c not in pose]
    )
    for p in pose:
        term = F.col(p).eqNullSafe(F.col(f"_p_{p}"))
        cond = term if cond is None else cond & term
    return frames.join(renamed, cond, "left").drop(*[f"_p_{p}" for p in pose])


def pad_raster(
    cells: DataFrame, dem_meta: DataFrame, *, ring: int = 2, keys: Sequence[str] = ("dem_id",)
) -> DataFrame:
    """Adds ``ring`` cells of elevation 0 and nodata 1 around the raster.

    Beyond its edge a raster counts as flat ground at height 0 that nobody surveyed, so the edge
    itself is a cliff; slopes computed after padding show that.
    """
    h, w, k = F.col("height"), F.col("width"), ring
    lines = dem_meta.select(
        *keys, "width", "height", F.explode(F.sequence(F.lit(-k), h + (k - 1))).alias("row")
    ).repartition(*keys, "row")
    outside = (F.col("row") < 0) | (F.col("row") >= h)
    edge = F.concat(
        F.sequence(F.lit(-k), F.lit(-1)), F.sequence(w.cast("int"), (w + (k - 1)).cast("int"))
    )
    cols = F.when(outside, F.sequence(F.lit(-k), (w + (k - 1)).cast("int"))).otherwise(edge)
    border = lines.select(
        *keys, F.col("row").cast("int").alias("row"), F.explode(cols).alias("col"),
        F.lit(0.0).alias("elev"), F.lit(1).alias("nodata"),
    )
    return cells.select(*keys, F.col("row").cast("int").alias("row"),
                        F.col("col").cast("int").alias("col"), "elev", "nodata").unionByName(border)


def _cell_cuts(batch: pa.RecordBatch, of: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs ``(span, first, last, row, col)`` of spans; ``of`` is the row of the batch with their affine columns."""
    real = lambda n: batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)[of]
    a, b, c, d, e, f = (real(n) for n in "abcdef")
    fa, fb, fc, fd, fe, ff = (real(f"aff_{k}") for k in "abcdef")
    py = y + 0.5
    with np.errstate(all="ignore"):
        det = a * e - b * d

        def cell_at(px: float) -> tuple[np.ndarray, np.ndarray]:
            lon, lat = fa * px + fb * py + fc, fd * px + fe * py + ff
            return (e * (lon - c) - b * (lat - f)) / det, (a * (lat - f) - d * (lon - c)) / det

        # along one image row the cell coordinates are linear in x: start + slope * x
        (cs, rs), (c1, r1) = cell_at(0.5), cell_at(1.5)
        known = _known(batch, [*"abcdef", *(f"aff_{k}" for k in "abcdef")])[of]
        cs, ck, rs, rk = (np.where(known, v, 0.0) for v in (cs, c1 - cs, rs, r1 - rs))
        span, first, last = runs.cut_at_cells(x0, x1, ((cs, ck), (rs, rk)))
        return span, first, last, runs.floored(rs[span] + rk[span] * first), runs.floored(cs[span] + ck[span] * first), known


def _known(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.logical_and.reduce([batch.column(n).is_valid().to_numpy(zero_copy_only=False) for n in names])


def _whole(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def cell_runs(
    spans: DataFrame,
    dem_meta: DataFrame,
    *,
    frame: Sequence[str] = ("flight_id", "frame_id"),
    keys: Sequence[str] = ("dem_id",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """The given spans (with the frame's affine on their rows), cut where the nearest cell changes.

    One row per run of pixels inside a cell: ``frame keys y x0 x1 row col`` and the carried columns.
    Spans of frames without an affine stay whole, with no row and col.
    """
    kept = [*frame, *keys, *carry, "y"]
    s = with_meta(spans, dem_meta, list("abcdef"), by=[*frame, "y"], keys=keys)
    s = s.select(*kept, "x0", "x1", *"abcdef", *[f"aff_{k}" for k in "abcdef"])
    out = s.select(
        *kept, *[F.col(n).cast("int").alias(n) for n in ("x0", "x1")], *[F.lit(None).cast("bigint").alias(n) for n in ("row", "col")]
    ).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _known(batch, ["y", "x0", "x1"])
            ends = [np.where(given, _whole(batch, n), 0) for n in ("x0", "x1")]
            span, first, last, row, col, known = _cell_cuts(batch, np.arange(batch.num_rows), _whole(batch, "y"), *ends)
            at, there = pa.array(span), (known & given)[span]
            whole = {n: batch.column(n).cast(pa.int32()).take(at) for n in ("x0", "x1")}
            placed = lambda v: pa.array(v, mask=~there)
            named = [pc.if_else(pa.array(there), pa.array(v.astype(np.int32)), whole[n]) for n, v in (("x0", first), ("x1", last))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n).take(at) for n in kept], *named, placed(row), placed(col)], [*kept, "x0", "x1", "row", "col"]
            )

    return s.mapInArrow(work, out)


def cell_sums(
    spans: DataFrame,
    dem_meta: DataFrame,
    *,
    by: Sequence[str],
    keys: Sequence[str] = ("dem_id",),
    fence: str | None = None,
    width: int = 0,
    masks: Sequence[str] = (),
    packed: str | None = None,
) -> DataFrame:
    """``cell_runs`` added up per ``by``, ``masks`` and cell: their pixels ``_n``, and ``_beyond`` the fence of their span.

    Runs are cut and added up in the task that holds the spans, and only sums leave it; a group that goes on in another
    batch has a row from each. ``fence`` names the pixel edges of ``geo.pixel_fence``, in rows of ``width`` pixels;
    nothing is beyond where there is no fence or no affine. ``masks`` are flags of the spans. With ``packed``
    a row holds many spans as ``runs.SPAN`` in that column, with the masks as bits, instead of ``y x0 x1`` and the masks.
    """
    named = [*by, *keys]
    spread_by = by if packed else [*by, "y"]
    s = with_meta(spans, dem_meta, list("abcdef"), by=spread_by, keys=keys)
    own = [packed] if packed else ["y", "x0", "x1", *masks]
    s = s.select(*named, *own, *"abcdef", *[f"aff_{k}" for k in "abcdef"], *([fence] if fence else []))
    flags = [F.lit(None).cast("boolean").alias(n) for n in masks]
    out = s.select(*named, *flags, *[F.lit(None).cast("bigint").alias(n) for n in ("row", "col", "_n", "_beyond")]).schema

    def added(batch: pa.RecordBatch) -> pa.RecordBatch:
        if packed:
            kept = [v or b"" for v in batch.column(packed).to_pylist()]
            of = np.repeat(np.arange(len(kept)), [len(v) // runs.SPAN.itemsize for v in kept])
            got = np.frombuffer(b"".join(kept), dtype=runs.SPAN)
            y, x0, x1, on = (got[n].astype(np.int64) for n in ("y", "x0", "x1", "on"))
        else:
            of = np.arange(batch.num_rows)
            y, x0, x1 = (_whole(batch, n) for n in ("y", "x0", "x1"))
            on = np.zeros(batch.num_rows, dtype=np.int64)
            for k, n in enumerate(masks):
                on |= batch.column(n).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) << k
        span, first, last, row, col, known = _cell_cuts(batch, of, y, x0, x1)
        there = known[span]
        size = last - first + 1
        beyond = np.zeros_like(size)
        if fence:
            fenced, *edges = runs.edges_of(batch.column(fence))
            within = runs.inside_fence(span, first, last, y=y, of=of, edges=edges, width=width)
            beyond = np.where(fenced[of][span] & there, size - within, 0)
        group = runs.groups_of(batch, named)
        head = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
        total = {"_n": pa.array(size), "_beyond": pa.array(beyond)}
        parts = [group[of[span]], on[span], there.astype(np.int64), row, col]
        low = [int(v.min()) if len(v) else 0 for v in parts]
        wide = [int(v.max()) - k + 1 if len(v) else 1 for v, k in zip(parts, low)]
        if math.prod(wide) < 2**62:
            # one number a group, which is quicker than five
            key = np.zeros_like(size)
            for v, k, n in zip(parts, low, wide):
                key = key * n + (v - k)
            sums = pa.table({"key": pa.array(key), **total}).group_by(["key"], use_threads=False).aggregate([("_n", "sum"), ("_beyond", "sum")])
            key, found = sums["key"].to_numpy(), []
            for k, n in zip(reversed(low), reversed(wide)):
                found.append(key % n + k)
                key = key // n
            g, bits, here, row, col = reversed(found)
        else:
            names = [f"k{i}" for i in range(len(parts))]
            sums = pa.table({**{n: pa.array(v) for n, v in zip(names, parts)}, **total})
            sums = sums.group_by(names, use_threads=False).aggregate([("_n", "sum"), ("_beyond", "sum")])
            g, bits, here, row, col = (sums[n].to_numpy() for n in names)
        at, away = pa.array(head[g]), here == 0
        made = [pa.array((bits >> k) & 1 == 1) for k in range(len(masks))]
        cells = [pa.array(v, mask=away) for v in (row, col)]
        added_up = [sums[n].combine_chunks() for n in ("_n_sum", "_beyond_sum")]
        return pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in named], *made, *cells, *added_up], out.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few enough at a time for the arrays of their runs
            for at in range(0, batch.num_rows, SLICE):
                yield added(batch.slice(at, SLICE))

    return s.mapInArrow(work, out)


def cell_layer_spans(
    spans: DataFrame,
    dem_meta: DataFrame,
    cells: DataFrame,
    *,
    frame: Sequence[str] = ("flight_id", "frame_id"),
    keys: Sequence[str] = ("dem_id",),
    layers: Sequence[str] = ("nodata", "slope"),
) -> DataFrame:
    """Raster layers under the given spans, as spans.

    Each span (with the frame's affine on its row) is cut where the nearest cell changes, so what
    is shuffled to the cells is one row per run instead of one per pixel. Cells the raster does not
    have are nodata and not steep.
    """
    runs = cell_runs(spread(spans, *frame, "y"), dem_meta, frame=frame, keys=keys)
    hit = runs.join(cells.select(*keys, "row", "col", *layers), [*keys, "row", "col"], "left")
    default = {name: F.lit(1 if name == "nodata" else 0) for name in layers}
    named = F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(n), default[n]) == 1, F.lit(n)) for n in layers])
    )
    return hit.select(*frame, F.explode(named).alias("layer"), "y", "x0", "x1")
