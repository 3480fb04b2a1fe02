from __future__ import annotations

import random
from collections import Counter

import numpy as np

from drovera.operators import geo, raster, runs, spans

META = ("d", 0.9, 0.1, -3.0, 0.2, -1.1, 40.0)
AFF = "aff_a DOUBLE, aff_b DOUBLE, aff_c DOUBLE, aff_d DOUBLE, aff_e DOUBLE, aff_f DOUBLE"


def meta(spark):
    return spark.createDataFrame([META], "dem_id STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE")


def test_circles_and_spans_are_parted_without_a_window(spark, monkeypatch):
    """Frames and bands that go on in further slices, and spans in no image row, are whole."""
    monkeypatch.setattr(spans, "SLICE", 3)
    rng = random.Random(3)
    boxes = [(1, rng.randrange(3), rng.randrange(-5, 90), rng.randrange(-5, 150), rng.randrange(0, 40)) for _ in range(60)]
    layers = [(1, rng.randrange(4), rng.choice(["roads", "vehicles", "slope"]), rng.randrange(140), x := rng.randrange(80), x + rng.randrange(-1, 20))
              for _ in range(80)] + [(1, 9, "roads", None, 4, 6)]
    beside = spark.createDataFrame([(1, f, b, f * 10.0 + b) for f in range(3) for b in range(3)], "flight_id long, frame_id long, _band long, at double")
    got = spans.circle_segments(
        spark.createDataFrame(boxes, "flight_id long, frame_id long, cx int, cy int, safety_radius_px int"),
        spark.createDataFrame(layers, "flight_id long, frame_id long, layer string, y int, x0 int, x1 int"),
        width=80, height=140, beside=beside,
    )
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    rows = spans.segment_rows(got).collect()
    want: dict = {}
    for _, f, cx, cy, r in set(boxes):
        for y in range(max(cy - r, 0), min(cy + r, 139) + 1) if r > 0 else ():
            for x in range(80):
                if (x - cx) ** 2 + (y - cy) ** 2 <= r * r:
                    want.setdefault((f, y, x), set()).add("safe")
    for _, f, name, y, x0, x1 in layers:
        for x in range(x0, x1 + 1) if name != "slope" else ():
            want.setdefault((f, y or 0, x), set()).add(name)
    seen = {}
    for r in rows:
        assert r.at is None if r.frame_id in (3, 9) else r.at == r.frame_id * 10.0 + r._band
        for x in range(r.x0, r.x1 + 1):
            assert (r.frame_id, r.y, x) not in seen
            seen[r.frame_id, r.y, x] = {n for n in ("safe", "roads", "vehicles") if r[n]}
    assert seen == want
    assert len({(r.frame_id, r._band) for r in rows}) == got.count()


def test_cells_and_fence_are_added_up_as_pixel_by_pixel(spark, monkeypatch):
    monkeypatch.setattr(raster, "SLICE", 7)
    rng = random.Random(5)
    affine = (0.21, 0.05, 2.0, -0.04, 0.17, 3.0)
    ring = [(3.0, 4.0), (9.0, 5.0), (7.0, 9.0), (6.0, 6.5), (4.0, 9.0)]
    lines = [(i % 4, rng.choice([True, False]), rng.randrange(40), x := rng.randrange(60), x + rng.randrange(30), *(affine if i % 4 else [None] * 6))
             for i in range(60)]
    given = spark.createDataFrame(lines, f"frame_id long, safe boolean, y int, x0 int, x1 int, {AFF}").selectExpr("*", "'d' AS dem_id")
    fenced = geo.pixel_fence(given, ring=geo.ring_literal(ring))
    got: Counter = Counter()
    for r in raster.cell_sums(fenced, meta(spark), by=["frame_id"], masks=["safe"], fence="fence", width=100).collect():
        got += Counter({(r.frame_id, r.safe, r.row, r.col, "n"): r._n, (r.frame_id, r.safe, r.row, r.col, "beyond"): r._beyond})
    _, a, b, c, d, e, f = META
    det = a * e - b * d
    want: Counter = Counter()
    for frame, safe, y, x0, x1, *aff in lines:
        for x in range(x0, x1 + 1):
            row = col = None
            out = 0
            if aff[0] is not None:
                lon, lat = (aff[k] * (x + 0.5) + aff[k + 1] * (y + 0.5) + aff[k + 2] for k in (0, 3))
                col, row = np.floor((e * (lon - c) - b * (lat - f)) / det), np.floor((a * (lat - f) - d * (lon - c)) / det)
                edges = zip(ring, ring[1:] + ring[:1])
                out = 1 - sum((p[1] > lat) != (q[1] > lat) and lon < p[0] + (lat - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in edges) % 2
            want += Counter({(frame, safe, row, col, "n"): 1, (frame, safe, row, col, "beyond"): out})
    assert got == want
    again = Counter()
    for r in raster.cell_runs(given, meta(spark), frame=["frame_id"], carry=["safe"]).collect():
        again[r.frame_id, r.safe, r.row, r.col, "n"] += r.x1 - r.x0 + 1
    assert again == Counter({k: n for k, n in want.items() if k[-1] == "n"})


def test_rows_that_pass_many_cells_a_pixel_have_a_run_a_pixel(spark):
    """From a great height a pixel passes millions of cells, which are not listed."""
    x0, x1 = np.array([5, 0]), np.array([9, 0])
    span, first, last = runs.cut_at_cells(x0, x1, ((np.array([0.5, 0.5]), np.array([4e9, 4e9])), (np.zeros(2), np.zeros(2))))
    assert span.tolist() == [0] * 5 + [1] and first.tolist() == last.tolist() == [5, 6, 7, 8, 9, 0]
    high = spark.createDataFrame([(1, 0, 0, 9, 4e9, 0.0, 0.0, 0.0, 4e9, 0.0)], f"frame_id long, y int, x0 int, x1 int, {AFF}")
    assert raster.cell_runs(high.selectExpr("*", "'d' AS dem_id"), meta(spark), frame=["frame_id"]).count() == 10


def test_poses_of_the_batch_before_are_not_counted_again(spark):
    from drovera.plans import danger

    asked = []

    class Ground:
        def cover(self, poses):
            asked.append(sorted(r.latitude for r in poses.collect()))
            return poses.selectExpr("*", "cast(latitude * 10 AS bigint) AS ground_px")

    schema = ", ".join(f"{p} {'INT' if p.startswith('image') else 'DOUBLE'}" for p in danger.POSED)
    pose = lambda *at: spark.createDataFrame([(float(a), None, 1.0, 2.0, 0.5, W, H) for a in at], schema)
    W, H = 320, 180
    cover = danger.Covered(Ground())
    for given in ((1, 2), (2, 3), (3, 4, 2), (1,)):
        got = cover(pose(*given)).collect()
        assert sorted((r.latitude, r.ground_px) for r in got) == sorted((float(a), a * 10) for a in given)
    # only what the last batch had is kept
    assert asked == [[1.0, 2.0], [3.0], [4.0], [1.0]]


def test_flags_of_dealt_circles_sweep_only_rows_with_layers(spark):
    rng = random.Random(29)
    boxes = spark.createDataFrame(
        [(rng.choice([0, 1, None]), rng.randrange(6), rng.randrange(-5, 330), rng.randrange(-5, 190), rng.randrange(0, 50))
         for _ in range(100)], "flight_id long, frame_id long, cx int, cy int, safety_radius_px int")
    layers = spark.createDataFrame(
        [(rng.choice([0, 1, None]), rng.randrange(4), rng.choice(["roads", "slope", "other"]), rng.randrange(180), x := rng.randrange(300),
          x + rng.randrange(20)) for _ in range(150)], "flight_id long, frame_id long, layer string, y int, x0 int, x1 int")
    plain = spans.safety_spans(boxes, width=320, height=180)
    dealt = spans.safety_spans(boxes, width=320, height=180, dealt=True)
    rows = lambda df: sorted(df.collect(), key=repr)
    # frames 4 and 5 have circles and no layers
    assert rows(spans.danger_flags(dealt, layers)) == rows(spans.danger_flags(plain, layers))
    few = spans._where_layered(dealt.filter("flight_id is not null"), layers, spans.FRAME).count()
    assert few < plain.filter("flight_id is not null").count() / 5
