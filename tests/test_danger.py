from __future__ import annotations

from drovera.plans import danger
from drovera.settings import HazardSettings

W, H = 320, 180
TOPICS = ("latitude", "longitude", "rel_alt", "gb_yaw")


def job(spark, poses, detections, labels, width=W, height=H, **kw):
    """Frames 1..n of one flight, a second apart; a pose of None sends no telemetry."""
    frames = [(1, i, i * 1_000_000) for i in range(1, len(poses) + 1)]
    sent = [
        (1, i * 10 + k, i * 1_000_000 - 4000 + k * 1000, f"telemetry/{t}", str(v))
        for i, pose in enumerate(poses, 1) if pose for k, (t, v) in enumerate(zip(TOPICS, pose))
    ]
    def make(rows, schema):
        return spark.createDataFrame(rows, "flight_id BIGINT, " + schema)
    out = danger.danger_detection(
        make(frames, "frame_id BIGINT, ts_us BIGINT"),
        make(sent, "seq BIGINT, ts_us BIGINT, topic STRING, payload STRING"),
        make(detections, "frame_id BIGINT, cx INT, cy INT, x1 INT, x2 INT, y1 INT, y2 INT"),
        make(labels, "frame_id BIGINT, class_id INT, y INT, x0 INT, x1 INT"),
        settings=HazardSettings(), width=width, height=height, **kw,
    )
    return out, {r.frame_id: r for r in out.flags.collect()}


def raster(spark, lon):
    cells = spark.createDataFrame(
        [("d", r, c, 5.0, 0) for r in range(4) for c in range(4)],
        "dem_id STRING, row INT, col INT, elev DOUBLE, nodata INT",
    )
    meta = spark.createDataFrame(
        [("d", 0.01, 0.0, lon, 0.0, -0.01, 44.02, 4, 4)],
        "dem_id STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE, width INT, height INT",
    )
    return {"dem_cells": cells, "dem_meta": meta, "dem_id": "d", "dem_pixel_m": 800.0}


AWAY = (44.0, 9.0, 100.0, 0.0)


def test_hazards_cover_the_whole_frame(spark):
    """Off the raster everything is nodata; frames without animals are present with the same mask."""
    poses = [AWAY, AWAY, None, (44.0, 9.0, 0.0, 0.0), AWAY]
    boxes = [(1, 1, 100, 90, 95, 105, 85, 95), (1, 4, 100, 90, 95, 105, 85, 95)]
    # a road of 11 pixels in the frame without telemetry, and one that lies in nodata anyway
    labels = [(1, 3, 1, 10, 0, 10), (1, 5, 1, 10, 0, 10)]
    out, got = job(spark, poses, boxes, labels, **raster(spark, 50.0))
    assert sorted(got) == [1, 2, 3, 4, 5]
    r = got[1]
    assert r.nodata and not r.slope and r.intersection_px == 49  # a circle of radius 4
    assert r.intersection_px + r.danger_px == W * H
    assert (got[2].intersection_px, got[2].danger_px, got[2].alert_msg) == (0, W * H, "")
    assert (got[3].intersection_px, got[3].danger_px) == (0, 11)
    assert (got[4].intersection_px, got[4].danger_px, got[4].alert_msg) == (0, 0, "")
    assert got[5].danger_px == W * H
    assert [(a.frame_id, a.alert_msg) for a in out.alerts.collect()] == [(1, r.alert_msg)]


def test_segments_outside_ground_layers_are_added_once(spark):
    """Inside raster and fence only the road counts; under a fence far away every pixel does."""
    labels = [(1, 1, 1, 90, 0, 199), (1, 1, 2, 90, 50, 99)]
    boxes = [(1, 1, 100, 90, 95, 105, 85, 95)]
    near = [(8.9, 43.9), (9.1, 43.9), (9.1, 44.1), (8.9, 44.1)]
    far = [(x + 5, y) for x, y in near]
    from drovera.operators import geo

    _, got = job(spark, [AWAY], boxes, labels, ring=geo.ring_literal(near), **raster(spark, 8.98))
    r = got[1]
    assert r.roads and r.vehicles and not (r.geofence or r.nodata or r.slope)
    assert r.intersection_px + r.danger_px == 200
    _, got = job(spark, [AWAY], boxes, labels, ring=geo.ring_literal(far), **raster(spark, 8.98))
    r = got[1]
    assert r.roads and r.vehicles and r.geofence
    assert r.intersection_px + r.danger_px == W * H


def test_frames_without_a_pose_lie_in_no_ground_layer(spark):
    from drovera.operators import geo

    far = geo.ring_literal([(13.9, 43.9), (14.1, 43.9), (14.1, 44.1)])
    boxes = [(1, i, 100, 90, 95, 105, 85, 95) for i in (1, 2, 3)]
    labels = [(1, 2, 1, 90, 96, 120)]
    poses = [AWAY, None, (44.0, 9.0, 0.0, 0.0)]
    for ground in ({"ring": far}, {"ring": far, **raster(spark, 50.0)}, raster(spark, 50.0)):
        _, got = job(spark, poses, boxes, labels, **ground)
        assert got[1].intersection_px == 49 and got[1].intersection_px + got[1].danger_px == W * H
        for r in (got[2], got[3]):
            assert not (r.geofence or r.nodata or r.slope)
        # without telemetry the circle's radius follows the boxes
        assert got[2].roads and got[2].intersection_px + got[2].danger_px == 25
        assert (got[3].intersection_px, got[3].danger_px) == (0, 0)


def test_no_lists_meet_the_tiles(spark, monkeypatch):
    """Rows that carry lists over the join with tiles would carry a copy of their tile as well."""
    from drovera.operators import geo

    met, bits = [], danger.Ground._bits
    monkeypatch.setattr(danger.Ground, "_bits", lambda self, cells: met.append(cells) or bits(self, cells))
    ring = geo.ring_literal([(8.9, 43.9), (9.1, 43.9), (9.1, 44.1), (8.9, 44.1)])
    frames = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 0.0, 0.0, 44.0, None)], "flight_id BIGINT, frame_id BIGINT, aff_a DOUBLE, "
        "aff_b DOUBLE, aff_c DOUBLE, aff_d DOUBLE, aff_e DOUBLE, aff_f DOUBLE, fence ARRAY<STRUCT<ax: DOUBLE, ay: DOUBLE, bx: DOUBLE, by: DOUBLE>>")
    segments = spark.createDataFrame([(1, 1, 0, 5, 0, 9, True, False, False)],
        "flight_id BIGINT, frame_id BIGINT, _band BIGINT, y INT, x0 INT, x1 INT, safe BOOLEAN, roads BOOLEAN, vehicles BOOLEAN")
    given = raster(spark, 50.0)
    ground = danger.ground_of(ring=ring, width=W, height=H, **given)
    ground.flags(segments, frames)
    assert len(met) == 1 and "_beyond" in met[0].columns
    assert not any(f.dataType.typeName() == "array" for f in met[0].schema)
