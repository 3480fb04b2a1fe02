"""Geolocation, footprint and geofence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import geo, quality
from . import views as V
from .registry import query

_A, _FL = C.WGS84_A, C.WGS84_F
_B = _A * (1 - _FL)
_EP2 = (_A * _A - _B * _B) / (_B * _B)

# customers as camera poses
_POSE = {
    "frame_id": "c_custkey",
    "latitude": "35.0 + (c_custkey % 97) * 0.05",
    "longitude": "-20.0 + (c_custkey % 83) * 0.7",
    "gb_yaw": "CAST((c_custkey * 17) % 360 AS DOUBLE)",
    "rel_alt": "20.0 + (c_custkey % 61)",
    "meters_per_pixel": "(20.0 + (c_custkey % 61)) * 0.001",
    "image_w": "1280",
    "image_h": "720",
    "px": "CAST((c_custkey * 37) % 1280 AS DOUBLE)",
    "py": "CAST((c_custkey * 91) % 720 AS DOUBLE)",
}
POSES = "po AS (SELECT " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {n}" if n not in ("frame_id", "image_w", "image_h") else f"{e} AS {n}"
    for n, e in _POSE.items()
) + " FROM customer)"


def poses(spark, d) -> DataFrame:
    return V.table(spark, d, "customer").select(
        *[
            F.expr(e if n in ("frame_id", "image_w", "image_h") else f"CAST({e} AS DOUBLE)").alias(n)
            for n, e in _POSE.items()
        ]
    )


def direct_sql(src: str, out: str, px: str, py: str, keep: str) -> str:
    """Vincenty's direct series with one iteration more than the library uses."""
    step = f"""cos(2 * sig1 + sig) AS c2m, sin(sig) AS ss, cos(sig) AS cs"""
    ctes = f"""
{out}_0 AS (SELECT *, ({px} - (image_w - 1) / 2.0) * meters_per_pixel AS dx,
    ((image_h - 1) / 2.0 - {py}) * meters_per_pixel AS dy FROM {src}),
{out}_1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS s, radians(90 - (degrees(atan2(dy, dx)) - gb_yaw)) AS al,
    atan((1 - {_FL!r}) * tan(radians(latitude))) AS u FROM {out}_0),
{out}_2 AS (SELECT *, atan2(tan(u), cos(al)) AS sig1, cos(u) * sin(al) AS sa FROM {out}_1),
{out}_3 AS (SELECT *, (1 - sa * sa) * {_EP2!r} AS usq FROM {out}_2),
{out}_4 AS (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS ba,
    usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bb FROM {out}_3),
{out}_5 AS (SELECT *, s / ({_B!r} * ba) AS sig FROM {out}_4)"""
    last = f"{out}_5"
    for i in range(3):
        ctes += f""",
{out}_a{i} AS (SELECT *, {step} FROM {last}),
{out}_b{i} AS (SELECT * EXCLUDE (sig, c2m, ss, cs), s / ({_B!r} * ba) + bb * ss * (c2m + bb / 4 * (
    cs * (-1 + 2 * c2m * c2m) - bb / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m))) AS sig FROM {out}_a{i})"""
        last = f"{out}_b{i}"
    ctes += f""",
{out}_f AS (SELECT *, {step}, {_FL!r} / 16 * (1 - sa * sa) * (4 + {_FL!r} * (4 - 3 * (1 - sa * sa))) AS cc FROM {last}),
{out} AS (SELECT {keep}, degrees(atan2(sin(u) * cs + cos(u) * ss * cos(al), (1 - {_FL!r}) * sqrt(
      sa * sa + power(sin(u) * ss - cos(u) * cs * cos(al), 2)))) AS lat,
    longitude + degrees(atan2(ss * sin(al), cos(u) * cs - sin(u) * ss * cos(al))
      - (1 - cc) * {_FL!r} * sa * (sig + cc * ss * (c2m + cc * cs * (-1 + 2 * c2m * c2m)))) AS lon FROM {out}_f)"""
    return ctes


@query(
    "pixel_to_lonlat",
    f"""WITH {V.EVENTS}, {POSES}, {direct_sql('po', 'g', 'px', 'py', 'frame_id')}
    SELECT frame_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM g""",
)
def to_lonlat(spark, d) -> DataFrame:
    p = geo.pixel_to_lonlat(poses(spark, d), px="px", py="py")
    return p.select("frame_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


_CORNER_SQL = f"""WITH {POSES}, pc AS (
    SELECT po.*, corner, CASE corner WHEN 'ul' THEN 0 WHEN 'bl' THEN 0 ELSE image_w - 1 END AS cpx,
      CASE corner WHEN 'ul' THEN 0 WHEN 'ur' THEN 0 ELSE image_h - 1 END AS cpy
    FROM po, (VALUES ('ul'), ('ur'), ('br'), ('bl')) v(corner)),
    {direct_sql('pc', 'g', 'cpx', 'cpy', 'frame_id, corner, latitude, longitude')},
  wide AS (SELECT frame_id, any_value(latitude) AS latitude, any_value(longitude) AS longitude, """ + ", ".join(
    f"max(CASE WHEN corner = '{c}' THEN {a} END) AS {c}_{a}" for c in geo.CORNERS for a in ("lon", "lat")
) + " FROM g GROUP BY 1)"


@query(
    "frame_corners",
    _CORNER_SQL + " SELECT frame_id, " + ", ".join(
        f"round({c}_{a}, 7) AS {c}_{a}" for c in geo.CORNERS for a in ("lon", "lat")) + " FROM wide",
)
def corners(spark, d) -> DataFrame:
    p = geo.frame_corners(poses(spark, d))
    return p.select(
        "frame_id",
        *[F.round(f"{c}_{a}", 7).alias(f"{c}_{a}") for c in geo.CORNERS for a in ("lon", "lat")],
    )


@query(
    "frame_affine",
    _CORNER_SQL + """ SELECT frame_id, round((ur_lon - ul_lon) / 1279, 10) AS aff_a,
      round((bl_lon - ul_lon) / 719, 10) AS aff_b, round(ul_lon, 7) AS aff_c,
      round((ur_lat - ul_lat) / 1279, 10) AS aff_d, round((bl_lat - ul_lat) / 719, 10) AS aff_e,
      round(ul_lat, 7) AS aff_f FROM wide""",
)
def affine(spark, d) -> DataFrame:
    p = geo.frame_affine(geo.frame_corners(poses(spark, d)))
    digits = {"aff_a": 10, "aff_b": 10, "aff_c": 7, "aff_d": 10, "aff_e": 10, "aff_f": 7}
    return p.select("frame_id", *[F.round(k, n).alias(k) for k, n in digits.items()])


# a box around the drone that most, not all, footprints fit; every seventh has no box
_BOUND = "CASE WHEN frame_id % 7 = 0 THEN NULL ELSE {c} {s} 0.0003 END"
_BOUNDS = {
    "min_lon": _BOUND.format(c="longitude", s="-"), "min_lat": _BOUND.format(c="latitude", s="-"),
    "max_lon": _BOUND.format(c="longitude", s="+"), "max_lat": _BOUND.format(c="latitude", s="+"),
}


@query(
    "footprint_within_bounds",
    _CORNER_SQL + ", b AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _BOUNDS.items()) + """ FROM wide)
    SELECT frame_id, coalesce(least(ul_lon, ur_lon, br_lon, bl_lon) >= min_lon
      AND greatest(ul_lon, ur_lon, br_lon, bl_lon) <= max_lon
      AND least(ul_lat, ur_lat, br_lat, bl_lat) >= min_lat
      AND greatest(ul_lat, ur_lat, br_lat, bl_lat) <= max_lat, false) AND min_lon IS NOT NULL AS within_bounds FROM b""",
)
def within(spark, d) -> DataFrame:
    p = geo.frame_corners(poses(spark, d))
    p = p.withColumns({n: F.expr(e) for n, e in _BOUNDS.items()})
    return geo.footprint_within_bounds(p).select("frame_id", "within_bounds")


@query(
    "geodesic_distance",
    # independent check: numerical integration of the parallel's chord is not exact enough, so the
    # inverse series is iterated twelve times instead of eight
    "WITH RECURSIVE " + POSES + f""", z0 AS (SELECT frame_id, latitude AS la1, longitude AS lo1,
      latitude + ((frame_id % 11) - 5) * 0.01 AS la2, longitude + ((frame_id % 13) - 6) * 0.02 AS lo2 FROM po),
    z1 AS (SELECT *, radians(lo2 - lo1) AS dl, atan((1 - {_FL!r}) * tan(radians(la1))) AS u1,
      atan((1 - {_FL!r}) * tan(radians(la2))) AS u2 FROM z0),
    z AS (
      SELECT frame_id, dl, u1, u2, dl AS lam, 0 AS it FROM z1
      UNION ALL
      SELECT frame_id, dl, u1, u2, dl + (1 - cc) * {_FL!r} * sa * (sig + cc * ss * (c2m + cc * cs * (-1 + 2 * c2m * c2m))), it + 1
      FROM (SELECT *, {_FL!r} / 16 * csq * (4 + {_FL!r} * (4 - 3 * csq)) AS cc,
          CASE WHEN csq < 1e-15 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / csq END AS c2m, atan2(ss, cs) AS sig
        FROM (SELECT *, 1 - sa * sa AS csq FROM (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa
          FROM (SELECT *, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM z WHERE it < 12) q1) q2) q3) q4),
    y AS (SELECT *, 1 - sa * sa AS csq FROM (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa
      FROM (SELECT *, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
        sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM z WHERE it = 12) q1) q2),
    x AS (SELECT *, CASE WHEN csq < 1e-15 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / csq END AS c2m, csq * {_EP2!r} AS usq FROM y),
    w AS (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS ba,
      usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bb FROM x)
    SELECT frame_id, round(CASE WHEN ss = 0 THEN 0.0 ELSE {_B!r} * ba * (atan2(ss, cs) - bb * ss * (c2m + bb / 4 * (
      cs * (-1 + 2 * c2m * c2m) - bb / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))) END, 4) AS distance_m FROM w""",
)
def distance(spark, d) -> DataFrame:
    p = poses(spark, d).withColumns(
        {
            "la2": F.expr("latitude + ((frame_id % 11) - 5) * 0.01D"),
            "lo2": F.expr("longitude + ((frame_id % 13) - 6) * 0.02D"),
        }
    )
    p = geo.geodesic_distance_m(p, lat1="latitude", lon1="longitude", lat2="la2", lon2="lo2")
    return p.select("frame_id", F.round("distance_m", 4).alias("distance_m"))


# ---------------------------------------------------------------- geofence

RING = [(2.0, 1.0), (8.0, 0.5), (9.0, 5.0), (5.0, 3.0), (1.5, 6.0)]
_RING_SQL = "ring AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {x}::DOUBLE, {y}::DOUBLE, {RING[(i + 1) % len(RING)][0]}::DOUBLE, {RING[(i + 1) % len(RING)][1]}::DOUBLE)"
    for i, (x, y) in enumerate(RING)
) + ") v(i, ax, ay, bx, by_))"


@query(
    "geofence_points",
    f"""WITH {_RING_SQL}, pt AS (SELECT c_custkey, (c_custkey * 37 % 1009) / 100.0::DOUBLE AS lon,
      (c_custkey * 91 % 701) / 100.0::DOUBLE AS lat FROM customer)
    SELECT c_custkey, sum(CASE WHEN (ay > lat) <> (by_ > lat) AND lon < ax + (lat - ay) * (bx - ax) / (by_ - ay)
      THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM pt, ring GROUP BY 1""",
)
def points(spark, d) -> DataFrame:
    p = V.table(spark, d, "customer").select(
        "c_custkey",
        F.expr("(c_custkey * 37 % 1009) / 100.0D").alias("lon"),
        F.expr("(c_custkey * 91 % 701) / 100.0D").alias("lat"),
    )
    return geo.geofence_points(p, ring=geo.ring_literal(RING)).select("c_custkey", "inside")


# small frames over the ring: turned by a different amount each
_W, _H = 48, 27
_AFF = {
    "aff_a": "0.2 - (c_custkey % 7) * 0.01",
    "aff_b": "(c_custkey % 5) * 0.03",
    "aff_c": "(c_custkey % 11) * 0.37 + 0.013",
    "aff_d": "(c_custkey % 3) * 0.02",
    "aff_e": "-0.25 + (c_custkey % 4) * 0.02",
    "aff_f": "6.5 + (c_custkey % 9) * 0.11",
}


@query(
    "geofence_spans",
    f"""WITH {_RING_SQL}, f AS (SELECT c_nationkey AS flight_id, c_custkey AS frame_id, """
    + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _AFF.items())
    + f""" FROM customer),
    px AS (SELECT f.*, x, y, aff_a * (x + 0.5) + aff_b * (y + 0.5) + aff_c AS lon,
        aff_d * (x + 0.5) + aff_e * (y + 0.5) + aff_f AS lat
      FROM f, (SELECT unnest(range({_W})) AS x) xs, (SELECT unnest(range({_H})) AS y) ys),
    out AS (SELECT flight_id, frame_id, y, x FROM px, ring GROUP BY flight_id, frame_id, y, x
      HAVING sum(CASE WHEN (ay > lat) <> (by_ > lat) AND lon < ax + (lat - ay) * (bx - ax) / (by_ - ay)
        THEN 1 ELSE 0 END) % 2 = 0),
    r AS (SELECT *, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) AS g FROM out)
    SELECT CAST(flight_id AS BIGINT) AS flight_id, frame_id, CAST(y AS BIGINT) AS y, CAST(min(x) AS BIGINT) AS x0,
      CAST(max(x) AS BIGINT) AS x1 FROM r GROUP BY flight_id, frame_id, y, g""",
)
def spans(spark, d) -> DataFrame:
    f = V.table(spark, d, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("flight_id"),
        F.col("c_custkey").alias("frame_id"),
        F.lit(_W).alias("image_w"), F.lit(_H).alias("image_h"),
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in _AFF.items()],
    )
    s = geo.geofence_layer(f, ring=geo.ring_literal(RING))
    return s.select("flight_id", "frame_id", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x0", "x1")])


_FENCE_TEXT = """CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN '(1.5, 2), (3, -4.25)'
  WHEN 2 THEN '(' || CAST(c_custkey AS {s}) || ', 10), (20, 30), (40, 50)'
  WHEN 3 THEN ' (1,2),( 3 , 4 ),(+5.5,-6) , (7, 8)' ELSE '' END"""


@query(
    "parse_geofence",
    f"""WITH t AS (SELECT c_custkey, {_FENCE_TEXT.format(s='VARCHAR')} AS txt FROM customer)
    SELECT c_custkey,
      CASE c_custkey % 5 WHEN 3 THEN 4 WHEN 2 THEN CASE WHEN c_custkey <= 180 THEN 3 END END::BIGINT AS vertices,
      CASE c_custkey % 5 WHEN 3 THEN 16.5 WHEN 2 THEN CASE WHEN c_custkey <= 180 THEN c_custkey + 60.0 END END::DOUBLE AS lon_sum,
      CASE c_custkey % 5 WHEN 1 THEN 'fewer than 3 pairs'
        WHEN 2 THEN CASE WHEN c_custkey > 180 THEN 'coordinate out of range' END END AS error FROM t""",
)
def fence_text(spark, d) -> DataFrame:
    t = V.table(spark, d, "customer").select(
        "c_custkey", F.expr(_FENCE_TEXT.format(s="STRING")).alias("txt")
    )
    r = geo.parse_geofence(t, text_col="txt")
    return r.select(
        "c_custkey",
        F.when(F.col("ring").isNotNull(), F.size("ring")).cast("bigint").alias("vertices"),
        F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["lon"]).alias("lon_sum"),
        F.col("ring_error").alias("error"),
    )


@query(
    "aspect_ratio_check",
    """SELECT p_partkey AS frame_id FROM part
      WHERE abs((1880.0 + p_size) / (1050 + p_size % 20) - 16.0 / 9.0) < 0.02""",
)
def aspect(spark, d) -> DataFrame:
    f = V.table(spark, d, "part").select(
        F.col("p_partkey").alias("frame_id"),
        (F.lit(1880) + F.col("p_size")).alias("orig_w"),
        (F.lit(1050) + F.col("p_size") % 20).alias("orig_h"),
    )
    return quality.aspect_ratio_check(f).select("frame_id")


@query(
    "sensor_aspect_check",
    """WITH c AS (SELECT s_suppkey, 17.35 + (s_suppkey % 5) * 0.01 AS phys_w FROM supplier)
    SELECT s_suppkey, abs(phys_w / 13.0 - 5280.0 / 3956) <= 0.001 * greatest(phys_w / 13.0, 5280.0 / 3956) AS aspect_ok FROM c""",
)
def sensor(spark, d) -> DataFrame:
    c = V.table(spark, d, "supplier").select(
        "s_suppkey",
        F.expr("17.35D + (s_suppkey % 5) * 0.01D").alias("sensor_w_mm"),
        F.lit(13.0).alias("sensor_h_mm"),
        F.lit(5280).alias("sensor_w_px"), F.lit(3956).alias("sensor_h_px"),
    )
    return quality.sensor_aspect_ok(c).select("s_suppkey", "aspect_ok")
