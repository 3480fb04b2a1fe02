"""Danger detection end to end: frames, telemetry and detections in, alerts out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import alerts, geo, raster, spans, telemetry, tiles
from ..session import cut, free, sized, spread
from ..settings import Camera, HazardSettings

POSE = ("latitude", "longitude", "rel_alt", "gb_yaw")
POSED = (*POSE, "meters_per_pixel", "image_w", "image_h")
AFFINE = tuple(f"aff_{k}" for k in "abcdef")
#: Bits of the ground tiles; a cell the raster does not have counts as unsurveyed and flat.
GROUND = {"nodata": 1, "slope": 2}


@dataclass(frozen=True)
class DangerResult:
    frames: DataFrame  # pose, resolution and safety radius per frame
    layers: DataFrame  # hazard spans; raster layers only under safety circles and segments
    flags: DataFrame  # touched layers and mask areas, one row for every frame
    cooldown_us: int

    @cached_property
    def alerts(self) -> DataFrame:
        """Rate-limited alerts; their jobs run only when they are asked for."""
        hits = self.flags.filter("alert_msg <> ''").select(*spans.FRAME, "alert_msg", "ts_us")
        return alerts.alert_cooldown(hits, cooldown_us=self.cooldown_us)


def locate_frames(
    frames: DataFrame,
    snapshots: DataFrame,
    detections: DataFrame,
    *,
    camera: Camera = Camera(),
    settings: HazardSettings = HazardSettings(),
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
) -> DataFrame:
    """Nearest telemetry per frame, metres per pixel, and the safety radius with its fallback.

    The join reads ``snapshots`` several times.
    """
    f = telemetry.asof_nearest(frames, snapshots, tol_us=settings.tolerance_us)
    f = f.select(
        *[c for c in f.columns if c != "telemetry"], "telemetry.*",
        F.lit(width).alias("image_w"), F.lit(height).alias("image_h"),
    )
    f = geo.safety_radius_px(
        geo.meters_per_pixel(f, camera=camera), radius_m=settings.safety_radius_m
    )
    f = geo.fallback_radius(
        f, detections, ref_size_m=settings.reference_size_m, radius_m=settings.safety_radius_m,
        out="_fallback",
    )
    return f.withColumn(
        "safety_radius_px",
        F.when(F.col("rel_alt").isNull(), F.col("_fallback")).otherwise(F.col("safety_radius_px")),
    ).drop("_fallback")


@dataclass(frozen=True)
class Ground:
    """What lies under frames whatever they see: a fence, and a raster as tiles of ``GROUND`` bits."""

    ring: Column | None
    tiles: DataFrame | None
    dem_meta: DataFrame | None
    dem_id: str | None
    width: int
    height: int

    def _runs(self, lines: DataFrame, by: list[str]) -> DataFrame:
        """Pixel runs of one cell (whole lines without a raster), with the fence's inside runs as ``_in``."""
        if self.ring is not None:
            lines = geo.inside_runs(lines.withColumn("_w", F.lit(self.width)), fence="fence", y="y", width="_w", out="_in")
        if self.tiles is None:
            return lines
        carry = ["_in"] if self.ring is not None else []
        return raster.cell_runs(lines.withColumn("dem_id", F.lit(self.dem_id)), self.dem_meta, frame=by, carry=carry)

    def _sums(self, lines: DataFrame, by: list[str], masks: Sequence[str] = ()) -> DataFrame:
        """Pixels of lines, or of packed segments, per cell, and those beyond the fence."""
        fence = "fence" if self.ring is not None else None
        packed = "segments" if "segments" in lines.columns else None
        lines = lines.withColumn("dem_id", F.lit(self.dem_id))
        return raster.cell_sums(lines, self.dem_meta, by=by, masks=masks, packed=packed, fence=fence, width=self.width)

    def _fenced(self, placed: DataFrame) -> DataFrame:
        """Rows with an affine and the fence in its pixels, null where there is no affine."""
        if self.ring is None:
            return placed
        moved = geo.pixel_fence(placed, ring=self.ring)
        return moved.withColumn("fence", F.when(F.col("aff_a").isNotNull(), F.col("fence")))

    def _bits(self, cells: DataFrame) -> DataFrame:
        return tiles.sample_tiles(cells, self.tiles, values={"ground": F.lit(GROUND["nodata"]).cast("tinyint")})

    def posed(self, poses: DataFrame) -> DataFrame:
        """Poses with their affine and the fence in their pixels."""
        # a filter on the affine itself would copy the geodesic expressions into its condition
        known = poses.filter(F.col("meters_per_pixel") > 0)
        out = cut(geo.frame_affine(geo.frame_corners(known)))
        return out if self.ring is None else geo.pixel_fence(out, ring=self.ring)

    def cover(self, poses: DataFrame) -> DataFrame:
        """Per pose the affine, and how many pixels of a whole frame the ground layers cover together.

        Cells part an image row into runs, so the union needs no sweep: a run counts whole where its
        cell is marked, and by the pixels beyond the fence otherwise. Runs are added up per pose and
        cell in the task that draws the pose, before they meet the tiles; no span is made.
        """
        posed = cut(self.posed(poses).withColumn("_pose", F.monotonically_increasing_id()))
        fence = ["fence"] if self.ring is not None else []
        lines = spread(posed.select("_pose", *AFFINE, *fence), "_pose").select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(self.height - 1))).alias("y"),
            F.lit(0).alias("x0"), F.lit(self.width - 1).alias("x1"),
        )
        if self.tiles is not None:
            parts = self._bits(self._sums(lines, ["_pose"]))
            parts = parts.withColumn("_n", F.when(F.col("ground") > 0, F.col("_n")).otherwise(F.col("_beyond")))
        else:
            size = (F.col("x1") - F.col("x0") + 1).cast("bigint")
            runs = self._runs(lines, ["_pose"])
            parts = runs.select("_pose", (size - geo.inside_px("_in", F.col("x0"), F.col("x1"))).alias("_n"))
        area = parts.groupBy("_pose").agg(F.sum("_n").alias("ground_px"))
        # the fence follows from the affine, so frames need not carry it
        return posed.join(area, "_pose", "left").drop("_pose", "fence")

    def under(self, looked: DataFrame, posed: DataFrame, by: list[str]) -> DataFrame:
        """Ground layers of the posed frames as spans, only where ``looked`` spans lie."""
        fence = ["fence"] if self.ring is not None else []
        runs = self._runs(looked.join(self._fenced(posed.select(*by, *AFFINE)), by), by)
        runs = runs if self.tiles is None else self._bits(runs)
        here = F.array(F.struct(F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1")))
        named = lambda name, found: F.transform(found, lambda r: F.struct(F.lit(name).alias("layer"), r["x0"].alias("x0"), r["x1"].alias("x1")))
        parts = []
        if fence:
            parts.append(named("geofence", geo.outside_runs("_in", F.col("x0"), F.col("x1"))))
        if self.tiles is not None:
            none = F.array().cast("array<struct<x0:int,x1:int>>")
            parts.extend(
                named(name, F.when(F.col("ground").bitwiseAND(F.lit(bit).cast("tinyint")) > 0, here).otherwise(none))
                for name, bit in GROUND.items()
            )
        return runs.select(*by, "y", F.explode(F.concat(*parts)).alias("_g")).select(*by, "_g.layer", "y", "_g.x0", "_g.x1")


    def flags(self, segments: DataFrame, posed: DataFrame) -> DataFrame:
        """Per frame the layers under safety circles, and the mask areas.

        ``segments`` are disjoint (``spans.circle_segments``), so fence and cells are looked up once
        for every pixel and everything is a sum; those that come packed have their frame's affine beside them.
        ``danger_px`` is what the frame adds to ``ground_px``: segments beside the ground layers count, ground
        inside circles does not.
        """
        keys, by = list(spans.FRAME), [*spans.FRAME, "_band"]
        names = list(C.SEGMENT_LAYERS.values())
        if "segments" in segments.columns:
            met = self._fenced(segments)
        else:
            fence = ["fence"] if self.ring is not None else []
            met = segments.join(spans.frame_bands(posed.select(*spans.FRAME, *AFFINE, *fence), height=self.height), by, "left")
        if self.tiles is not None:
            # Added up per cell before tiles are met: what follows that join is compiled into it, so no row carries a copy of its tile.
            runs = self._bits(self._sums(met, keys, ["safe", *names]))
            runs = runs.withColumn("ground", F.when(F.col("row").isNotNull(), F.col("ground")).otherwise(F.lit(0).cast("tinyint")))
        else:
            met = spans.segment_rows(met) if "segments" in met.columns else met
            met = geo.inside_runs(met.withColumn("_w", F.lit(self.width)), fence="fence", y="y", width="_w", out="_in")
            x0, x1 = F.col("x0"), F.col("x1")
            size = (x1 - x0 + 1).cast("bigint")
            beyond = F.coalesce(size - geo.inside_px("_in", x0, x1), F.lit(0)).cast("bigint")
            runs = met.select(*keys, "safe", *names, size.alias("_n"), beyond.alias("_beyond")).withColumn("ground", F.lit(0).cast("tinyint"))
        part = F.when(F.col("ground") > 0, F.col("_n")).otherwise(F.col("_beyond"))
        whole = F.lit(False)
        for n in names:
            whole = whole | F.col(n)
        found = {n: F.col(n) for n in names} | {"geofence": F.col("_beyond") > 0} | {
            n: F.col("ground").bitwiseAND(F.lit(bit).cast("tinyint")) > 0 for n, bit in GROUND.items()
        }
        safe = F.col("safe")
        total = lambda c: F.sum(c).cast("bigint")
        return runs.groupBy(*keys).agg(
            *[F.max(safe & on).alias(n) for n, on in found.items()],
            total(F.when(safe, F.when(whole, F.col("_n")).otherwise(part)).otherwise(0)).alias("intersection_px"),
            total(F.when(safe, -part).when(whole, F.col("_n") - part).otherwise(0)).alias("danger_px"),
        )


class Covered:
    """``Ground.cover`` over one batch after another: only poses that the batch before did not have are counted.

    What it keeps is bounded by the poses of a batch. It is kept beside the stream's state, not in it: a driver
    that starts anew counts its first batch's poses again.
    """

    def __init__(self, ground: Ground) -> None:
        self.ground, self.last = ground, None

    def __call__(self, poses: DataFrame) -> DataFrame:
        if self.last is None:
            self.last = sized(self.ground.cover(poses))
            return self.last
        poses = sized(poses)
        same = lambda a, b: reduce(Column.__and__, [a[p].eqNullSafe(b[p]) for p in POSED])
        known = self.last.join(poses, same(self.last, poses), "left_semi")
        fresh = poses.join(self.last, same(poses, self.last), "left_anti")
        self.last = sized(known.unionByName(self.ground.cover(fresh)))
        return self.last


def ground_tiles(cells: DataFrame, dem_meta: DataFrame, *, pixel_m: float | str, threshold_deg: float) -> DataFrame:
    """Tiles of ``GROUND`` bits; slope is computed once per cell, with the raster's edge as a cliff."""
    steep = raster.slope_mask(raster.pad_raster(cells, dem_meta), pixel_m=pixel_m, threshold_deg=threshold_deg)
    bits = [F.when(F.col(n) == 1, F.lit(b)).otherwise(F.lit(0)) for n, b in GROUND.items()]
    ground = (bits[0] + bits[1]).cast("tinyint").alias("ground")
    return tiles.tile_raster(steep.select("dem_id", "row", "col", ground), values=["ground"])


def ground_of(
    *,
    ring: Column | None = None,
    dem_cells: DataFrame | None = None,
    dem_meta: DataFrame | None = None,
    dem_id: str | None = None,
    dem_pixel_m: float | str = 1.0,
    settings: HazardSettings = HazardSettings(),
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
) -> Ground | None:
    """Fence and raster prepared for any number of frames; None without either."""
    if ring is None and dem_cells is None:
        return None
    steep = None
    if dem_cells is not None:
        # a row a raster: at its true size no join with it shuffles the spans
        dem_meta = sized(dem_meta)
        steep = cut(ground_tiles(
            dem_cells, dem_meta, pixel_m=dem_pixel_m, threshold_deg=settings.slope_threshold_deg
        ))
    return Ground(ring, steep, dem_meta, dem_id, width, height)


def danger_detection(
    frames: DataFrame,
    messages: DataFrame,
    detections: DataFrame,
    label_spans: DataFrame,
    *,
    camera: Camera = Camera(),
    settings: HazardSettings = HazardSettings(),
    suppress: tuple[int, ...] = (),
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    **ground: Column | DataFrame | str | float | None,
) -> DangerResult:
    """Hazard layers against safety circles; ``ground`` names what ``ground_of`` takes.

    Slope is computed once per raster cell, not per frame. How much of a whole frame the fence and the
    raster cover depends on the pose alone and is counted once per distinct pose, without spans; the
    frames then look at fence and cells only under their circles and segments. Frames without telemetry, or on the
    ground, get no geographic layers; every frame has a row in ``flags``.
    """
    return hazards(
        frames, cut(telemetry.telemetry_snapshot(telemetry.decode_telemetry(messages))), detections, label_spans,
        ground=ground_of(settings=settings, width=width, height=height, **ground),
        camera=camera, settings=settings, suppress=suppress, width=width, height=height,
    )


def hazards(
    frames: DataFrame,
    snapshots: DataFrame,
    detections: DataFrame,
    label_spans: DataFrame,
    *,
    ground: Ground | None,
    camera: Camera = Camera(),
    settings: HazardSettings = HazardSettings(),
    suppress: tuple[int, ...] = (),
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    cover: Callable[[DataFrame], DataFrame] | None = None,
) -> DangerResult:
    """``danger_detection`` from telemetry snapshots and a prepared ground; ``cover`` stands for its own (``Covered``)."""
    located = cut(
        locate_frames(
            frames, snapshots, detections, camera=camera, settings=settings, width=width, height=height
        )
    )
    keys = list(spans.FRAME)
    del snapshots
    free(located.sparkSession)
    layers = spans.segmentation_layers(label_spans, suppress=suppress)
    if ground is not None:
        located = cut(raster.compute_once_per_pose(
            located, cover or ground.cover, pose=POSED
        ))
        free(located.sparkSession)
    # read once by the flags; whoever asks for the layers has them joined again
    boxes = detections.select(*keys, "cx", "cy").join(located.select(*keys, "safety_radius_px"), keys)
    if ground is not None:
        posed = located.filter(F.col("meters_per_pixel") > 0)
        beside = spans.frame_bands(posed.select(*keys, *AFFINE), height=height)
        touched = ground.flags(spans.circle_segments(boxes, layers, width=width, height=height, beside=beside), posed)
        looked = spans.safety_spans(boxes, width=width, height=height).unionByName(layers)
        layers = layers.unionByName(ground.under(looked.drop("layer"), posed, keys))
    else:
        located = located.withColumn("ground_px", F.lit(None).cast("bigint"))
        touched = spans.circle_danger_flags(boxes, layers, width=width, height=height)
    every = located.select(*keys, "ts_us", "ground_px").join(touched, keys, "left")
    names = [n for n, _ in C.DANGER_LABELS]
    flags = every.select(
        *keys, "ts_us",
        *[F.coalesce(n, F.lit(False)).alias(n) for n in names],
        F.coalesce("intersection_px", F.lit(0).cast("bigint")).alias("intersection_px"),
        (F.coalesce("danger_px", F.lit(0)) + F.coalesce("ground_px", F.lit(0)))
        .cast("bigint").alias("danger_px"),
    )
    flags = cut(spans.danger_message(flags))
    return DangerResult(located, layers, flags, settings.cooldown_us)


def cell_width_m(dem_meta: DataFrame, *, out: str = "pixel_m") -> DataFrame:
    """East-west width of a raster cell in metres at the raster's middle latitude."""
    mid = F.col("f") + F.col("e") * F.col("height") / 2
    m = dem_meta.withColumns({"_lat": mid, "_l0": F.col("c"), "_l1": F.col("c") + F.col("a") * F.col("width")})
    m = geo.geodesic_distance_m(m, lat1="_lat", lon1="_l0", lat2="_lat", lon2="_l1", out="_span")
    return m.withColumn(out, F.col("_span") / F.col("width")).drop("_lat", "_l0", "_l1", "_span")
