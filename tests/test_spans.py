from __future__ import annotations

import random

import numpy as np
import pytest

from drovera.operators import spans as S

SPAN = "flight_id BIGINT, frame_id BIGINT, layer STRING, y INT, x0 INT, x1 INT"


def to_spans(mask, layer="a", frame=1):
    rows = []
    for y, line in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.r_[0, line, 0]))
        rows += [(1, frame, layer, y, int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]
    return rows


def to_mask(rows, h, w, frame=1):
    m = np.zeros((h, w), dtype=int)
    for r in rows:
        if r.frame_id == frame:
            m[r.y, r.x0 : r.x1 + 1] += 1
    return m


def midpoint_circle(h, w, cx, cy, r):
    """Filled circle by the integer midpoint rule."""
    m = np.zeros((h, w), dtype=int)
    x, d, y = r, 0, 0
    while x >= y:
        for half, row in ((x, y), (y, x)):
            for yy in (cy - row, cy + row):
                if 0 <= yy < h:
                    m[yy, max(0, cx - half) : max(0, cx + half + 1)] = 1
        y += 1
        d = y * y + x * x - r * r
        if d > 0:
            x -= 1
    return m


def test_safety_circles_follow_the_midpoint_rule(spark):
    cases = [(1, 30, 30, 10), (2, 0, 0, 7), (3, 99, 50, 25), (4, 50, 50, 1), (5, 20, 70, 45), (6, 10, 10, 0), (7, 10, 10, -1)]
    df = spark.createDataFrame([(1, f, x, y, r) for f, x, y, r in cases for _ in (0, 1)],
                               "flight_id BIGINT, frame_id BIGINT, cx INT, cy INT, safety_radius_px INT")
    rows = S.safety_spans(df, width=100, height=100).collect()
    for f, x, y, r in cases:
        want = midpoint_circle(100, 100, x, y, r) if r > 0 else np.zeros((100, 100), dtype=int)
        np.testing.assert_array_equal(to_mask(rows, 100, 100, f), want)


def test_mask_algebra_on_random_masks(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.random((2, 12, 40)) < 0.4).astype(int)
    da = spark.createDataFrame(to_spans(a), SPAN)
    db = spark.createDataFrame(to_spans(b, "b"), SPAN)
    both = da.unionByName(db).unionByName(da)
    for df, want in (
        (S.span_intersect(da, db), a & b), (S.mask_difference(da, db), a & ~b & 1), (S.mask_union(both), a | b)
    ):
        rows = df.collect()
        np.testing.assert_array_equal(to_mask(rows, 12, 40), want)
        assert len(rows) == len(to_spans(want))  # maximal runs
    lines = spark.createDataFrame([(1, 1, y) for y in range(12)], "flight_id BIGINT, frame_id BIGINT, y INT")
    np.testing.assert_array_equal(to_mask(S.mask_complement(da, lines, width=40).collect(), 12, 40), 1 - a)
    assert S.mask_area(S.mask_union(both), keys=S.FRAME).first().area_px == (a | b).sum()


NAMES = ("roads", "vehicles", "nodata", "geofence", "slope")


def flags_of(spark, boxes, masks, radius=10):
    b = spark.createDataFrame([(1, 1, x, y, radius) for x, y in boxes],
                              "flight_id BIGINT, frame_id BIGINT, cx INT, cy INT, safety_radius_px INT")
    rows = [r for n, m in masks.items() for r in to_spans(m, n)]
    l = spark.createDataFrame(rows, SPAN)
    return S.danger_message(S.danger_flags(S.safety_spans(b, width=100, height=100), l)).collect()


def test_danger_cases(spark):
    zero = np.zeros((100, 100), dtype=int)
    one = midpoint_circle(100, 100, 50, 50, 10)
    assert flags_of(spark, [], {}) == []
    (r,) = flags_of(spark, [(50, 50)], {"vehicles": one})
    assert r.alert_msg == "Vehicles" and r.intersection_px == one.sum() and r.danger_px == 0
    two = midpoint_circle(100, 100, 30, 30, 10) | midpoint_circle(100, 100, 70, 70, 10)
    (r,) = flags_of(spark, [(30, 30), (70, 70)], {
        "roads": np.roll(two, 9, 0), "vehicles": np.roll(two, 9, 0), "nodata": np.roll(two, 5, 0),
        "geofence": np.roll(two, 5, 1), "slope": np.roll(two, 9, 1)})
    assert r.alert_msg == "Roads & Vehicles & Missing elevation data & Out of geo-fenced area & Steep slope"
    far = zero.copy()
    far[90:, 90:] = 1
    (r,) = flags_of(spark, [(10, 10)], {"roads": far})
    assert r.alert_msg == "" and r.intersection_px == 0 and r.danger_px == 100
    rng = np.random.default_rng(1)
    masks = {n: rng.integers(0, 2, (100, 100)) for n in NAMES}
    (r,) = flags_of(spark, [(50, 50)], masks)
    any_ = np.maximum.reduce(list(masks.values()))
    assert (r.intersection_px, r.danger_px) == ((any_ & one).sum(), (any_ & (1 - one)).sum())


def test_no_radius_keeps_the_danger_mask(spark):
    (r,) = flags_of(spark, [(50, 50)], {"slope": np.ones((100, 100), dtype=int)}, radius=-1)
    assert r.alert_msg == "" and r.danger_px == 10_000


def test_union_of_random_planes(spark):
    planes = np.random.default_rng(5).random((4, 7, 11)) < 0.3
    rows = [r for i, p in enumerate(planes) for r in to_spans(p.astype(int), str(i))]
    got = S.mask_union(spark.createDataFrame(rows, SPAN)).collect()
    np.testing.assert_array_equal(to_mask(got, 7, 11), planes.any(axis=0))


def test_detections_and_counts(spark):
    raw = spark.createDataFrame(
        [(1, 1, 0, 3.0, [7.25, 31.5, 14.0, 9.0], [0.25, 27.0, 14.25, 36.75]), (1, 1, 1, 0.0, [418.0, 5.99, 64.0, 8.0], [386.01, 2.0, 450.0, 9.5])],
        "flight_id BIGINT, frame_id BIGINT, det_id BIGINT, class_id DOUBLE, xywh ARRAY<DOUBLE>, xyxy ARRAY<DOUBLE>")
    g = sorted(tuple(r)[3:] for r in S.box_geometry(raw).collect())
    assert g == [(0, 418, 5, 386, 2, 450, 9), (3, 7, 31, 0, 27, 14, 36)]
    frames = spark.createDataFrame([(1, 1), (1, 2)], "flight_id BIGINT, frame_id BIGINT")
    det = spark.createDataFrame([(1, 1, c) for c in (0, 1, 1, 0, 1)], "flight_id BIGINT, frame_id BIGINT, class_id INT")
    lines = {(r.frame_id, r.line) for r in S.class_counts(frames, det, classes={0: "Sheep", 1: "Goat"}).collect()}
    assert lines == {(1, "N. Sheep: 2"), (1, "N. Goat: 3"), (2, "N. Sheep: 0"), (2, "N. Goat: 0")}


@pytest.mark.parametrize("suppress,want", [((), {"roads", "vehicles"}), ((2,), {"roads"}), ((1, 2), set())])
def test_suppressed_classes(spark, suppress, want):
    df = spark.createDataFrame([(1, 1, c, 0, 0, 3) for c in (0, 1, 2, 3)], "flight_id BIGINT, frame_id BIGINT, class_id INT, y INT, x0 INT, x1 INT")
    assert {r.layer for r in S.segmentation_layers(df, suppress=suppress).collect()} == want


def test_rows_are_sorted_by_their_most_selective_column(spark):
    a = spark.createDataFrame([(1, 2, 3, 0, 9)], "flight_id BIGINT, frame_id BIGINT, y INT, x0 INT, x1 INT")
    plan = S.mask_difference(a, a)._jdf.queryExecution().executedPlan().toString()
    sorts = [line.split("Sort [")[1] for line in plan.split("\n") if "Sort [" in line]
    assert sorts and all(order.startswith("frame_id") for order in sorts)


def test_dealt_circles_meet_only_the_rows_of_the_other_mask(spark):
    rng = random.Random(23)
    boxes = spark.createDataFrame(
        [(rng.choice([0, 1, None]), rng.randrange(4), rng.randrange(-5, 330), rng.randrange(-5, 190), rng.randrange(0, 80))
         for _ in range(120)], "flight_id long, frame_id long, cx int, cy int, safety_radius_px int")
    layers = spark.createDataFrame(
        [(rng.choice([0, 1, None]), rng.randrange(5), "roads", y := rng.randrange(180), x := rng.randrange(300), x + rng.randrange(20))
         for _ in range(200)], "flight_id long, frame_id long, layer string, y int, x0 int, x1 int")
    plain = S.safety_spans(boxes, width=320, height=180)
    dealt = S.safety_spans(boxes, width=320, height=180, dealt=True)
    rows = lambda df: sorted(df.collect(), key=repr)
    assert rows(dealt.drop("_band")) == rows(plain)
    assert rows(S.span_intersect(dealt, layers)) == rows(S.span_intersect(plain, layers))
    assert rows(S.span_intersect(layers, dealt)) == rows(S.span_intersect(layers, plain))
    assert rows(S.mask_difference(layers, dealt)) == rows(S.mask_difference(layers, plain))
    held = {tuple(r) for r in layers.select("flight_id", "frame_id", "y").collect()}
    met = S._where_met(dealt, layers, S.FRAME).filter("flight_id is not null")
    assert {tuple(r) for r in met.select("flight_id", "frame_id", "y").distinct().collect()} <= held
