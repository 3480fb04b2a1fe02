from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovera.operators import raster as R

CELL = "dem_id STRING, row INT, col INT, elev DOUBLE, nodata INT"


def cells(spark, **grids):
    rows = [(k, r, c, float(g[r, c]), 0) for k, g in grids.items() for r in range(g.shape[0]) for c in range(g.shape[1])]
    return spark.createDataFrame(rows, CELL)


def horn(g, pixel, deg):
    p = np.pad(g, 1, mode="edge")
    n, m = g.shape
    s = lambda i, j: p[1 + i : 1 + i + n, 1 + j : 1 + j + m]
    dx = (s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)) / (8 * pixel)
    dy = (s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)) / (8 * pixel)
    return (dx ** 2 + dy ** 2 > math.tan(math.radians(deg)) ** 2).astype(int)


def masks(df, **kw):
    out = {}
    for r in R.slope_mask(df, **kw).collect():
        out.setdefault(r.dem_id, {})[r.row, r.col] = r.slope
    return out


def test_slope_fixtures(spark):
    y, x = np.mgrid[0:100, 0:100].astype(float)
    t = lambda d: math.tan(math.radians(d))
    dome = 20 * np.exp(-((x - 50) ** 2 + (y - 50) ** 2) / (2 * 15 ** 2))
    two = np.where(x < 50, 0.0, (x - 50) * t(35))
    grids = {
        "flat": 0 * x, "ramp": x * t(20), "ramp_y": y * t(20), "dome": dome, "two": two, "two_y": two.T,
        "cliff": np.where(x < 50, 0.0, 10.0), "diag": (x + y) / math.sqrt(2) * t(20),
        "wave": 5 * np.sin(2 * np.pi * 3 * x / 100),
    }
    data = cells(spark, **grids).cache()
    expect = {
        30: {"ramp": {(50, 50): 0}, "ramp_y": {(50, 50): 0}, "diag": {(50, 50): 0}},
        10: {"flat": {(0, 0): 0, (50, 50): 0}, "ramp": {(50, 50): 1}, "ramp_y": {(50, 50): 1}, "diag": {(50, 50): 1}},
        25: {"dome": {(50, 65): 1, (50, 35): 1, (35, 50): 1, (65, 50): 1, (50, 50): 0, (50, 90): 0, (0, 0): 0}},
        20: {"two": {(50, 75): 1, (50, 25): 0}, "two_y": {(75, 50): 1, (25, 50): 0}},
        60: {"cliff": {(50, 49): 1, (50, 50): 1, (50, 25): 0, (50, 75): 0}},
    }
    for deg, want in expect.items():
        got = masks(data.filter(F.col("dem_id").isin(*want)), pixel_m=1.0, threshold_deg=deg, tile=32)
        for name, points in want.items():
            for at, v in points.items():
                assert got[name][at] == v, (deg, name, at)
            full = horn(grids[name], 1.0, deg)
            assert all(full[at] == v for at, v in got[name].items())
    assert sum(sum(m.values()) for m in masks(data, pixel_m=1.0, threshold_deg=90.0).values()) == 0


def test_slope_small_grids(spark):
    steep = np.arange(9).reshape(3, 3) * 100.0
    rows = np.array([[0.0] * 3, [5.0] * 3, [5.0] * 3])
    got = masks(cells(spark, s=steep), pixel_m=1.0, threshold_deg=1.0, tile=2)["s"]
    assert set(got.values()) == {1} and len(got) == 9
    assert set(masks(cells(spark, s=steep / 100), pixel_m=1000.0, threshold_deg=5.0)["s"].values()) == {0}
    assert set(masks(cells(spark, s=steep), pixel_m=1.0, threshold_deg=0.0)["s"].values()) == {1}
    assert sum(masks(cells(spark, s=rows), pixel_m=10.0, threshold_deg=15.0)["s"].values()) == 0
    assert sum(masks(cells(spark, s=rows), pixel_m=10.0, threshold_deg=13.0)["s"].values()) == 6


def test_slope_tiles_do_not_change_the_result(spark):
    g = np.random.default_rng(2).random((23, 31)) * 5
    want = horn(g, 2.0, 30.0)
    for tile in (1, 2, 5, 64):
        got = masks(cells(spark, g=g), pixel_m=2.0, tile=tile)["g"]
        assert len(got) == g.size and all(want[at] == v for at, v in got.items())


META = "dem_id STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE, width INT, height INT, crs STRING"


def affine_of(ul, ur, bl, w, h):
    return {"aff_a": (ur[0] - ul[0]) / (w - 1), "aff_b": (bl[0] - ul[0]) / (h - 1), "aff_c": ul[0],
            "aff_d": (ur[1] - ul[1]) / (w - 1), "aff_e": (bl[1] - ul[1]) / (h - 1), "aff_f": ul[1]}


def cross():
    r, c = np.mgrid[0:80, 0:80].astype(float)
    v = c / 79 * 160 + r / 79 * 80
    v[:39, 39:42], v[42:, 39:42], v[39:42, 42:], v[39:42, :39], v[39:42, 39:42] = 10, 210, 240, 150, 255
    return v


@pytest.mark.parametrize("deg", [0, 30, 45])
def test_sampling_a_turned_frame(spark, deg):
    t, h = math.radians(deg), 50.0
    p = lambda x, y: (202.3 + x * math.cos(t) - y * math.sin(t), 197.6 + x * math.sin(t) + y * math.cos(t))
    aff = affine_of(p(-h, h), p(h, h), p(-h, -h), 100, 100)
    grid = cross()
    meta = spark.createDataFrame([("dem", 5.0, 0.0, 0.0, 0.0, -5.0, 400.0, 80, 80, "x")], META)
    pts = spark.createDataFrame([(x, y) for x in range(0, 100, 7) for y in range(0, 100, 7)] + [(49, 49)], "x INT, y INT")
    pts = pts.withColumns({"dem_id": F.lit("dem"), **{k: F.lit(v) for k, v in aff.items()}})
    rows = R.sample_raster(R.pixel_to_cell(pts, meta), cells(spark, dem=grid)).collect()
    near_border = 0
    for r in rows:
        gx = (aff["aff_a"] * (r.x + 0.5) + aff["aff_b"] * (r.y + 0.5) + aff["aff_c"]) / 5
        gy = (400 - (aff["aff_d"] * (r.x + 0.5) + aff["aff_e"] * (r.y + 0.5) + aff["aff_f"])) / 5
        if min(abs(gx - round(gx)), abs(gy - round(gy))) < 1e-9:
            near_border += 1
            continue
        assert r.elev == grid[int(gy), int(gx)]
    assert near_border < len(rows) / 10
    assert [r.elev for r in rows if (r.x, r.y) == (49, 49)] == [255.0] * sum((r.x, r.y) == (49, 49) for r in rows)


def test_cell_runs_equal_pixel_sampling(spark):
    rng = np.random.default_rng(4)
    flags = rng.integers(0, 2, (2, 9, 9))
    rows = [("dem", r, c, int(flags[0, r, c]), int(flags[1, r, c])) for r in range(9) for c in range(9)]
    cl = spark.createDataFrame(rows, "dem_id STRING, row INT, col INT, nodata INT, slope INT")
    meta = spark.createDataFrame([("dem", 5.0, 0.0, 0.0, 0.0, -5.0, 45.0, 9, 9, "x")], META)
    for aff in ((0.6113, 0.2317, 3.3071, -0.1931, -0.4703, 41.7019), (-0.8311, 0.3119, 44.1037, 0.2713, 0.5503, 0.9041), (0.9017, 0.0, -6.3011, 0.0, -0.7013, 40.1033)):
        named = dict(zip(("aff_a", "aff_b", "aff_c", "aff_d", "aff_e", "aff_f"), aff))
        spans = spark.createDataFrame([(1, 1, y, 2, 57) for y in range(0, 40, 3)], "flight_id BIGINT, frame_id BIGINT, y INT, x0 INT, x1 INT")
        spans = spans.withColumns({"dem_id": F.lit("dem"), **{k: F.lit(v) for k, v in named.items()}})
        got = {"nodata": set(), "slope": set()}
        for r in R.cell_layer_spans(spans, meta, cl).collect():
            got[r.layer] |= {(r.y, x) for x in range(r.x0, r.x1 + 1)}
        want = {"nodata": set(), "slope": set()}
        a, b, c, d, e, f = aff
        for y in range(0, 40, 3):
            for x in range(2, 58):
                col = math.floor((a * (x + 0.5) + b * (y + 0.5) + c) / 5)
                row = math.floor((45 - (d * (x + 0.5) + e * (y + 0.5) + f)) / 5)
                inside = 0 <= row < 9 and 0 <= col < 9
                if not inside or flags[0, row, col]:
                    want["nodata"].add((y, x))
                if inside and flags[1, row, col]:
                    want["slope"].add((y, x))
        assert got == want


def test_window_outside_the_raster(spark):
    meta = spark.createDataFrame([("dem", 1.0, 0.0, 0.0, 0.0, -1.0, 4.0, 4, 4, "x")], META)
    pose = spark.createDataFrame([("dem", 1, 1, 0.5, 3.5)], "dem_id STRING, flight_id INT, frame_id INT, longitude DOUBLE, latitude DOUBLE")
    for k in ("ul", "ur", "br", "bl"):
        pose = pose.withColumns({f"{k}_lon": F.col("longitude"), f"{k}_lat": F.col("latitude")})
    w = R.dem_window(pose, meta, buffer_scale=0.1)
    r = w.first()
    # one cell wide footprint: longest side 1, scale at least 0.5, so one cell to each side
    assert (r.half_size, r.window_size, r.row0, r.row1, r.col0, r.col1, r.on_raster) == (1, 3, -1, 1, -1, 1, False)
    got = {(c.row, c.col): (c.elev, c.nodata) for c in R.dem_window_cells(w, cells(spark, dem=np.full((4, 4), 7.0))).collect()}
    assert len(got) == 9
    assert got[0, 0] == (7.0, 0) and got[-1, 0] == (0.0, 1) and got[1, 1] == (7.0, 0)


def test_mosaic_and_profile(spark):
    rows = [("m", 0, 0, 1.0, 1), ("m", 0, 0, 2.0, 2), ("m", 0, 1, float("nan"), 1), ("m", 0, 1, 5.0, 2),
            ("m", 2, 2, None, 1), ("m", 1, 0, -9999.0, 1)]
    df = spark.createDataFrame(rows, "dem_id STRING, row INT, col INT, elev DOUBLE, source_rank INT")
    m = R.mosaic_dem(df, sentinel=-9999.0)
    got = {(r.row, r.col): (r.elev, r.nodata) for r in m.collect()}
    assert len(got) == 9 and got[0, 0] == (1.0, 0) and got[0, 1] == (5.0, 0)
    assert all(got[p] == (0.0, 1) for p in got if p not in ((0, 0), (0, 1)))
    p = R.raster_profile(m).first()
    assert (p["size"], p.nodata_count, p.dtype, p.min_elev, p.max_elev) == (9, 7, "double", 0.0, 5.0)


def test_padding(spark):
    meta = spark.createDataFrame([("dem", 1.0, 0.0, 0.0, 0.0, -1.0, 3.0, 4, 3, "x")], META)
    p = R.pad_raster(cells(spark, dem=np.ones((3, 4))), meta).collect()
    assert len({(r.row, r.col) for r in p}) == len(p) == 7 * 8
    assert sum(r.nodata for r in p) == 56 - 12
