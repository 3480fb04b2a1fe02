"""Ground resolution, safety radius, geolocation, footprints and the geofence layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geodesy
from ..session import spread
from ..settings import Camera

Ring = Sequence[tuple[float, float]]

# Corner order: upper left, upper right, bottom right, bottom left.
CORNERS = ("ul", "ur", "br", "bl")


def meters_per_pixel(
    df: DataFrame,
    *,
    camera: Camera = Camera(),
    alt: str = "rel_alt",
    image_w: str = "image_w",
    image_h: str = "image_h",
    out: str = "meters_per_pixel",
) -> DataFrame:
    return df.withColumn(
        out, geodesy.camera_resolution(F.col(alt), camera, F.col(image_w), F.col(image_h))
    )


def safety_radius_px(
    df: DataFrame,
    *,
    radius_m: float = C.SAFETY_RADIUS_M,
    mpp: str = "meters_per_pixel",
    out: str = "safety_radius_px",
) -> DataFrame:
    """Truncated towards zero; null where the resolution is unknown or not positive (on the ground).

    A radius beyond the int range is its end, so that no row ends the job.
    """
    size = F.when(F.col(mpp) > 0, F.least(F.try_divide(F.lit(float(radius_m)), F.col(mpp)), F.lit(2147483647.0)))
    return df.withColumn(out, size.cast("int"))


def fallback_radius(
    frames: DataFrame,
    boxes: DataFrame,
    *,
    keys: Sequence[str] = ("flight_id", "frame_id"),
    ref_size_m: float = C.ANIMAL_REFERENCE_SIZE_M,
    radius_m: float = C.SAFETY_RADIUS_M,
    out: str = "safety_radius_px",
) -> DataFrame:
    """Radius without telemetry: the median longer box side is taken as one animal length.

    -1 when the frame has no boxes or the median is zero. The exact median buffers one counter per
    distinct side length, and lengths are pixel counts, so a crowded frame stays small.
    """
    w = F.abs(F.col("x2") - F.col("x1"))
    h = F.abs(F.col("y2") - F.col("y1"))
    med = boxes.groupBy(*keys).agg(F.median(F.greatest(w, h)).alias("_med"))
    radius = F.when(
        F.col("_med") > 0, (F.lit(float(radius_m)) / (F.lit(float(ref_size_m)) / F.col("_med")))
    ).otherwise(F.lit(-1.0))
    return frames.join(med, list(keys), "left").withColumn(out, radius.cast("int")).drop("_med")


def pixel_to_lonlat(
    df: DataFrame,
    *,
    px: str,
    py: str,
    lat: str = "latitude",
    lon: str = "longitude",
    yaw: str = "gb_yaw",
    mpp: str = "meters_per_pixel",
    image_w: str = "image_w",
    image_h: str = "image_h",
    out_lon: str = "lon",
    out_lat: str = "lat",
    iterations: int = 2,
) -> DataFrame:
    """Pixel to geographic position: offset from the frame centre, rotated by the yaw.

    ``px`` and ``py`` are SQL expressions; the other inputs are column names.
    """
    offset = [
        {
            "dx": f"(({px}) - (`{image_w}` - 1) / 2) * `{mpp}`",
            "dy": f"((`{image_h}` - 1) / 2 - ({py})) * `{mpp}`",
        },
        {
            "dist": "sqrt(_g_dx * _g_dx + _g_dy * _g_dy)",
            "bear": f"pmod(90 - (degrees(atan2(_g_dy, _g_dx)) - `{yaw}`), 360D)",
        },
    ]
    return geodesy.staged(
        df,
        offset + geodesy.direct_steps(lat, "_g_bear", "_g_dist", iterations),
        geodesy.direct_result(lon, out_lat, out_lon, iterations),
    )


def frame_corners(df: DataFrame, **kw: str) -> DataFrame:
    """Adds lon/lat of the four corner pixels as ``<corner>_lon`` and ``<corner>_lat``.

    The corners stay columns of the frame row, so no explode and no regrouping is needed.
    """
    right = f"(`{kw.get('image_w', 'image_w')}` - 1)"
    bottom = f"(`{kw.get('image_h', 'image_h')}` - 1)"
    pixels = {"ul": ("0", "0"), "ur": (right, "0"), "br": (right, bottom), "bl": ("0", bottom)}
    for name in CORNERS:
        px, py = pixels[name]
        df = pixel_to_lonlat(
            df, px=px, py=py, out_lon=f"{name}_lon", out_lat=f"{name}_lat", **kw
        )
    return df


def frame_affine(df: DataFrame, *, image_w: str = "image_w", image_h: str = "image_h") -> DataFrame:
    """Six coefficients mapping (col, row) to (lon, lat), from three corners."""
    w, h = F.col(image_w) - 1, F.col(image_h) - 1
    return df.withColumns(
        {
            "aff_a": (F.col("ur_lon") - F.col("ul_lon")) / w,
            "aff_b": (F.col("bl_lon") - F.col("ul_lon")) / h,
            "aff_c": F.col("ul_lon"),
            "aff_d": (F.col("ur_lat") - F.col("ul_lat")) / w,
            "aff_e": (F.col("bl_lat") - F.col("ul_lat")) / h,
            "aff_f": F.col("ul_lat"),
        }
    )


def geodesic_distance_m(
    df: DataFrame, *, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "distance_m"
) -> DataFrame:
    return geodesy.geodesic_inverse(df, lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2, out=out)


def window_size_m(
    df: DataFrame,
    *,
    ref_lat: str,
    bounds: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat"),
    out: str = "window_m",
    strict: bool = True,
) -> DataFrame:
    """East-west extent of a window at the reference latitude, which must lie inside it.

    ``strict`` raises on a violating row; otherwise the width of such a row is null.
    """
    min_lon, min_lat, max_lon, max_lat = bounds
    inside = (F.col(min_lat) < F.col(ref_lat)) & (F.col(ref_lat) < F.col(max_lat))
    df = geodesic_distance_m(df, lat1=ref_lat, lon1=min_lon, lat2=ref_lat, lon2=max_lon, out=out)
    if strict:
        message = F.lit("reference latitude outside the window")
        return df.withColumn(out, F.when(inside, F.col(out)).otherwise(F.raise_error(message).cast("double")))
    return df.withColumn(out, F.when(inside, F.col(out)))


def footprint_within_bounds(
    df: DataFrame,
    *,
    bounds: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat"),
    out: str = "within_bounds",
) -> DataFrame:
    """All four corners inside the bounds (inclusive); unknown bounds give false."""
    min_lon, min_lat, max_lon, max_lat = (F.col(b) for b in bounds)
    lons = [F.col(f"{c}_lon") for c in CORNERS]
    lats = [F.col(f"{c}_lat") for c in CORNERS]
    inside = (
        (F.least(*lons) >= min_lon)
        & (F.greatest(*lons) <= max_lon)
        & (F.least(*lats) >= min_lat)
        & (F.greatest(*lats) <= max_lat)
    )
    return df.withColumn(out, F.coalesce(inside, F.lit(False)))


# ---------------------------------------------------------------- geofence

# what stands between a pair of brackets, and the plain decimals that may stand there
BRACKETS = r"\(([^()]*)\)"
DECIMAL = r"^[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)$"


def parse_geofence(df: DataFrame, *, text_col: str, out: str = "ring") -> DataFrame:
    """Text to ring of (lon, lat). Empty text or "none" is null; ``<out>_error`` names a bad one.

    A pair is two plain decimals with a comma between them in brackets; whatever else the text
    holds is passed over.
    """
    text = F.trim(F.col(text_col))
    unset = text.isNull() | F.lower(text).isin("", "none")
    inner = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(BRACKETS), 1)
    parts = F.transform(inner, lambda p: F.transform(F.split(p, ","), lambda n: F.trim(n)))
    pairs = F.filter(parts, lambda p: (F.size(p) == 2) & F.forall(p, lambda n: n.rlike(DECIMAL)))
    lons = F.transform(pairs, lambda p: p[0].cast("double"))
    lats = F.transform(pairs, lambda p: p[1].cast("double"))
    ring = F.zip_with(lons, lats, lambda x, y: F.struct(x.alias("lon"), y.alias("lat")))
    df = df.withColumn("_ring", F.when(~unset, ring))
    outside = F.exists(
        "_ring", lambda p: ~(p["lon"].between(-180.0, 180.0) & p["lat"].between(-90.0, 90.0))
    )
    error = F.when(F.size("_ring") < 3, F.lit("fewer than 3 pairs")).when(
        outside, F.lit("coordinate out of range")
    )
    return (
        df.withColumn(f"{out}_error", F.when(F.col("_ring").isNotNull(), error))
        .withColumn(out, F.when(F.col(f"{out}_error").isNull(), F.col("_ring")))
        .drop("_ring")
    )


def ring_literal(ring: Ring) -> Column:
    """A configured polygon as an array literal of (lon, lat)."""
    return F.array(
        *[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring]
    )


def _edges(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        nxt,
        lambda p, q: F.struct(
            p["lon"].alias("ax"), p["lat"].alias("ay"), q["lon"].alias("bx"), q["lat"].alias("by")
        ),
    )


def _crossing_x(e: Column, y: Column) -> Column:
    return e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])


def geofence_points(
    df: DataFrame, *, ring: Column, x: str = "lon", y: str = "lat", out: str = "inside"
) -> DataFrame:
    """Even-odd test of a point against a ring; a narrow projection without a join.

    ``ring`` is an array column or literal: a fence has as many vertices as a person entered.
    """
    hits = F.size(
        F.filter(
            _edges(ring),
            lambda e: ((e["ay"] > F.col(y)) != (e["by"] > F.col(y)))
            & (F.col(x) < _crossing_x(e, F.col(y))),
        )
    )
    return df.withColumn(out, F.pmod(hits, F.lit(2)) == 1)


def pixel_fence(frames: DataFrame, *, ring: Column, out: str = "fence") -> DataFrame:
    """Edges of the ring in each frame's pixel coordinates, by the inverse of the frame's affine."""
    a, b, c, d, e, f = (F.col(f"aff_{k}") for k in "abcdef")
    det = a * e - b * d
    to_px = F.transform(
        ring,
        lambda p: F.struct(
            ((e * (p["lon"] - c) - b * (p["lat"] - f)) / det).alias("lon"),
            ((a * (p["lat"] - f) - d * (p["lon"] - c)) / det).alias("lat"),
        ),
    )
    return frames.withColumn("_ring", to_px).withColumn(out, _edges(F.col("_ring"))).drop("_ring")


def inside_runs(lines: DataFrame, *, fence: str, y: str, width: str, out: str) -> DataFrame:
    """Runs ``(s, e)``, end exclusive, of pixels of an image row inside a fence of pixel edges.

    The row is cut at its sorted crossings; pixel i is inside when its centre i + 0.5 lies in
    [cut 2j, cut 2j + 1). A per-row expression; null where the row has no fence.
    """
    yc, w = F.col(y) + 0.5, F.col(width).cast("bigint")
    cuts = F.sort_array(
        F.transform(
            F.filter(fence, lambda g: (g["ay"] > yc) != (g["by"] > yc)), lambda g: F.ceil(_crossing_x(g, yc) - 0.5)
        )
    )
    run = lambda i: F.struct(
        F.greatest(F.get("_cut", i), F.lit(0).cast("bigint")).alias("s"), F.least(F.get("_cut", i + 1), w).alias("e")
    )
    pairs = F.transform(F.sequence(F.lit(0), F.size("_cut") - 2, F.lit(2)), run)
    runs = F.when(F.size("_cut") >= 2, F.filter(pairs, lambda r: r["s"] < r["e"])).otherwise(
        F.array().cast("array<struct<s:bigint,e:bigint>>")
    )
    known = F.when(F.col(fence).isNotNull(), runs)
    return lines.withColumn("_cut", cuts).withColumn(out, known).drop("_cut")


def inside_px(runs: str | Column, x0: Column, x1: Column) -> Column:
    """How many pixels of x0..x1 lie in the runs."""
    shared = lambda r: F.greatest(F.least(r["e"], x1 + 1) - F.greatest(r["s"], x0), F.lit(0).cast("bigint"))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + shared(r))


def outside_runs(runs: str, x0: Column, x1: Column) -> Column:
    """The gaps ``(x0, x1)``, both inclusive, that the runs leave in x0..x1."""
    lo, hi = x0.cast("bigint"), x1.cast("bigint")
    starts = F.concat(F.array(lo), F.transform(runs, lambda r: F.greatest(r["e"], lo)))
    ends = F.concat(F.transform(runs, lambda r: F.least(r["s"] - 1, hi)), F.array(hi))
    gaps = F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("int").alias("x0"), e.cast("int").alias("x1")))
    return F.filter(gaps, lambda g: g["x0"] <= g["x1"])


def geofence_layer(
    frames: DataFrame,
    *,
    ring: Column,
    keys: Sequence[str] = ("flight_id", "frame_id"),
    image_w: str = "image_w",
    image_h: str = "image_h",
    layer: str = "geofence",
) -> DataFrame:
    """Spans of pixels outside the fence, one scan line at a time.

    The ring is moved into pixel coordinates with the inverse of the frame's affine, each line is
    cut at its crossings (sampled at pixel centres), and the gaps between inside runs are the
    layer. Everything is a per-row expression; only the frames themselves are shuffled, to give
    every task its share of scan lines.
    """
    # the ring is transformed once per frame, before its lines are listed
    moved = pixel_fence(spread(frames, *keys), ring=ring, out="_edges")
    lines = moved.select(
        *keys,
        F.col(image_w).alias("_w"),
        "_edges",
        F.explode(F.sequence(F.lit(0), F.col(image_h) - 1)).alias("y"),
    )
    lines = inside_runs(lines, fence="_edges", y="y", width="_w", out="_in")
    gaps = outside_runs("_in", F.lit(0), F.col("_w") - 1)
    return lines.select(*keys, "y", F.explode(gaps).alias("_g")).select(
        *keys, F.lit(layer).alias("layer"), "y", "_g.x0", "_g.x1"
    )
