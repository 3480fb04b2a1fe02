from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from drovera.functions.geodesy import ground_resolution
from drovera.operators import geo, quality
from drovera.settings import AnomalySettings, Camera, HazardSettings


def test_ground_resolution(spark):
    sizes = [(1920, 1080), (4000, 3000), (4000, 4000), (1080, 1920), (3000, 4000)]
    df = spark.createDataFrame(sizes, "w INT, h INT")
    col = ground_resolution(
        F.lit(100.0), focal_mm=F.lit(10.0), sensor_w_mm=F.lit(4.0), sensor_w_px=F.lit(4000.0),
        sensor_h_px=F.lit(3000.0), image_w=F.col("w"), image_h=F.col("h"))
    for r in df.select("w", "h", col.alias("m")).collect():
        assert r.m == pytest.approx(0.01 * min(4000 / r.w, 3000 / r.h), rel=1e-6)


# positions of nine pixels of a 1920 x 1080 frame at 1 m/px around (-74, 40.7485), per yaw
EXPECTED = {
    0: [(-74.011411, 40.753348), (-73.988611, 40.753348), (-73.988611, 40.743663), (-74.011411, 40.743663),
        (-74.005711, 40.750932), (-73.994289, 40.750932), (-73.994289, 40.746086), (-74.005711, 40.746086), (-74.000012, 40.748509)],
    90: [(-73.993584, 40.757126), (-73.993584, 40.739889), (-74.006402, 40.739889), (-74.006402, 40.757126),
         (-73.996781, 40.752819), (-73.996781, 40.744201), (-74.003195, 40.744201), (-74.003195, 40.752819), (-73.999988, 40.748509)],
    180: [(-73.988589, 40.743652), (-74.011389, 40.743652), (-74.011389, 40.753337), (-73.988589, 40.753337),
          (-73.994287, 40.746068), (-74.005687, 40.746068), (-74.005687, 40.750914), (-73.994287, 40.750914), (-73.999988, 40.748491)],
    270: [(-74.006416, 40.739874), (-74.006416, 40.757111), (-73.993596, 40.757111), (-73.993596, 40.739874),
          (-74.003218, 40.744181), (-74.003218, 40.752799), (-73.996801, 40.752799), (-73.996801, 40.744181), (-74.000012, 40.748491)],
}
PIXELS = [(0, 0), (1919, 0), (1919, 1079), (0, 1079), (479, 269), (1439, 269), (1439, 809), (479, 809), (959, 539)]


def test_localisation(spark):
    rows = [(yaw, x, y, *e) for yaw, exp in EXPECTED.items() for (x, y), e in zip(PIXELS, exp)]
    df = spark.createDataFrame([(float(a), b, c, d, e) for a, b, c, d, e in rows],
                               "gb_yaw DOUBLE, x INT, y INT, elon DOUBLE, elat DOUBLE")
    df = df.selectExpr("*", "40.7485D AS latitude", "-74.0D AS longitude", "1.0D AS meters_per_pixel",
                       "1920 AS image_w", "1080 AS image_h")
    out = geo.pixel_to_lonlat(df, px="x", py="y").collect()
    assert len(out) == 36
    for r in out:
        assert abs(r.lon - r.elon) < 1e-4 and abs(r.lat - r.elat) < 1e-4


def test_direct_and_inverse_agree(spark):
    df = spark.range(200).selectExpr(
        "-60 + id * 0.6 AS latitude", "id * 1.7 - 170 AS longitude", "cast(id * 23 % 360 AS double) AS b",
        "cast(10 + id * 37 AS double) AS m")
    from drovera.functions.geodesy import geodesic_direct, geodesic_inverse

    df = df.selectExpr("cast(latitude AS double) latitude", "cast(longitude AS double) longitude", "b", "m")
    df = geodesic_direct(df, lat="latitude", lon="longitude", bearing="b", distance_m="m", out_lat="la", out_lon="lo")
    df = geodesic_inverse(df, lat1="latitude", lon1="longitude", lat2="la", lon2="lo", out="back")
    assert max(abs(r.back - r.m) for r in df.collect()) < 1e-4


def window(spark, lat, w, s, e, n):
    return spark.createDataFrame([(lat, w, s, e, n)], "lat DOUBLE, min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, max_lat DOUBLE")


def test_window_size(spark):
    got = geo.window_size_m(window(spark, 0.0, -1.0, -1.0, 1.0, 1.0), ref_lat="lat").first().window_m
    assert got == pytest.approx(2 * math.pi * 6378137 / 180, rel=1e-9)  # the equator is a circle
    mid = geo.window_size_m(window(spark, 45.0, -120.0, 30.0, -110.0, 60.0), ref_lat="lat").first().window_m
    assert 786_000 < mid < 788_500
    for lat in (-2.0, 2.0, -1.0, 1.0):
        bad = window(spark, lat, -1.0, -1.0, 1.0, 1.0)
        assert geo.window_size_m(bad, ref_lat="lat", strict=False).first().window_m is None
        with pytest.raises(Exception, match="outside the window"):
            geo.window_size_m(bad, ref_lat="lat").collect()


def rotated(cx, cy, hx, hy, deg):
    t = math.radians(deg)

    def p(x, y):
        return cx + x * math.cos(t) - y * math.sin(t), cy + x * math.sin(t) + y * math.cos(t)

    return p(-hx, hy), p(hx, hy), p(-hx, -hy)


STRAIGHT = ((10.0, 48.01), (10.02, 48.01), (10.0, 47.99))
BOX = lambda w, s, e, n: [(w, n), (e, n), (e, s), (w, s)]
FENCES = [
    ("centre", STRAIGHT, BOX(10.006, 47.996, 10.014, 48.004), [(320, 240)], [(5, 5), (635, 475)]),
    ("corner", STRAIGHT, BOX(10.0, 48.004, 10.008, 48.01), [(40, 40)], [(500, 400), (320, 240)]),
    ("other corner", STRAIGHT, BOX(10.012, 47.99, 10.02, 48.002), [(600, 440)], [(40, 40), (320, 240)]),
    ("turned", rotated(10.01, 48.0, 0.010, 0.008, 30), BOX(10.007, 47.997, 10.013, 48.003), [(320, 240)], [(5, 5)]),
    ("all in", STRAIGHT, BOX(9.99, 47.98, 10.03, 48.02), [(0, 0), (639, 479)], []),
    ("all out", STRAIGHT, BOX(11.0, 48.99, 11.01, 49.0), [], [(0, 0), (639, 479)]),
]


@pytest.mark.parametrize("name,corners,ring,inside,outside", FENCES, ids=[f[0] for f in FENCES])
def test_geofence_layer(spark, name, corners, ring, inside, outside):
    (ul, ur, bl) = corners
    df = spark.createDataFrame([(1, 1, 640, 480, *ul, *ur, *bl)],
        "flight_id BIGINT, frame_id BIGINT, image_w INT, image_h INT, ul_lon DOUBLE, ul_lat DOUBLE, "
        "ur_lon DOUBLE, ur_lat DOUBLE, bl_lon DOUBLE, bl_lat DOUBLE")
    layer = geo.geofence_layer(geo.frame_affine(df), ring=geo.ring_literal(ring)).collect()
    out = {}
    for r in layer:
        out.setdefault(r.y, []).append((r.x0, r.x1))
    hit = lambda x, y: any(a <= x <= b for a, b in out.get(y, []))
    assert all(not hit(*p) for p in inside) and all(hit(*p) for p in outside)
    if name == "all in":
        assert not layer
    if name == "all out":
        assert len(layer) == 480 and all((r.x0, r.x1) == (0, 639) for r in layer)


def test_geofence_text(spark):
    texts = {
        "( -3.5,+12 ) , (.25, 7.0)\n(4,\t-8)": [(-3.5, 12.0), (0.25, 7.0), (4.0, -8.0)],
        "(1,2)(3,4);x(5,6,7)(5.,6)(1e1,2)((8,9)": [(1.0, 2.0), (3.0, 4.0), (8.0, 9.0)],
        "(1,2) (3,4)": "fewer than 3 pairs", "(1,2) (3,4) (NaN,5)": "fewer than 3 pairs",
        "(1,2) (3,4) (181,5)": "coordinate out of range", "None": None, "  ": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in geo.parse_geofence(df, text_col="t").collect():
        want = texts[r.t]
        assert r.ring_error == (want if isinstance(want, str) else None)
        assert (r.ring and [tuple(p) for p in r.ring]) == (want if isinstance(want, list) else None)


def test_settings_checks():
    Camera().check_aspect()
    with pytest.raises(ValueError):
        Camera(sensor_h_mm=12.0).check_aspect()
    with pytest.raises(ValueError):
        HazardSettings(slope_threshold_deg=90.0)
    with pytest.raises(ValueError):
        AnomalySettings(ema_alpha=0.0)


def test_aspect_ratio(spark):
    df = spark.createDataFrame([(1920, 1080), (1920, 1088), (640, 480)], "orig_w INT, orig_h INT")
    assert quality.aspect_ratio_check(df).count() == 2
    assert quality.aspect_rejects(df).first().orig_w == 640
    with pytest.raises(Exception, match="unexpected frame size"):
        quality.aspect_ratio_check(df, strict=True).collect()


def test_rows_on_the_ground_do_not_end_the_job(spark):
    from drovera.operators import geo, quality

    rows = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, None), (3, 1e-12), (4, 0.5)], "id int, meters_per_pixel double")
    got = {r.id: r.safety_radius_px for r in geo.safety_radius_px(rows, radius_m=2.0).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 2147483647, 4: 4}
    sizes = spark.createDataFrame([(16, 0), (16, 9)], "orig_w int, orig_h int")
    assert quality.aspect_rejects(sizes).count() == 1
