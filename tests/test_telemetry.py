from __future__ import annotations

import random

import pytest

from drovera import constants as C
from drovera.operators import telemetry as T
from drovera.sources import readers

MSG = "flight_id BIGINT, seq BIGINT, ts_us BIGINT, topic STRING, payload STRING"


def test_decode_and_snapshot(spark):
    rows = [
        (1, 0, 10, "telemetry/rel_alt", "12.5"), (1, 1, 20, "telemetry/unknown", "1"),
        (1, 2, 30, "telemetry/latitude", "oops"), (1, 3, 40, "telemetry/latitude", " 4.5e1 "),
        (1, 4, 40, "telemetry/gb_yaw", "1.5f"), (1, 5, 50, "telemetry/rel_alt", "13"),
        (2, 0, 15, "telemetry/longitude", "-7"), (2, 1, 16, "telemetry/longitude", "0x10"),
    ]
    df = T.decode_telemetry(spark.createDataFrame(rows, MSG))
    got = sorted(tuple(r) for r in T.telemetry_snapshot(df, block=2).select(
        "flight_id", "seq", "latitude", "longitude", "rel_alt", "gb_yaw").collect())
    t = C.TELEMETRY_TEMPLATE
    assert got == [
        (1, 0, t["latitude"], t["longitude"], 12.5, 270.0),
        (1, 3, 45.0, t["longitude"], 12.5, 270.0),
        (1, 5, 45.0, t["longitude"], 13.0, 270.0),
        (2, 0, t["latitude"], -7.0, 40.0, 270.0),
    ]


def nearest(frames, tele, tol):
    out = {}
    for f, i, t in frames:
        best = None
        for g, s, u, v in sorted(tele, key=lambda r: (r[2], r[1])):
            if g == f and (best is None or abs(u - t) < best[0]):
                best = (abs(u - t), v)
        out[f, i] = best if best and best[0] <= tol else (None, None)
    return out


def test_asof_nearest_matches_a_scan(spark):
    rnd = random.Random(3)
    tele, frames = [], []
    for f in (1, 2, 3):
        for s in range({1: 300, 2: 20, 3: 0}[f]):
            tele.append((f, s, rnd.randint(0, 2000) // 5 * 5, float(f * 1000 + s)))
        frames += [(f, i, rnd.randint(-50, 2100)) for i in range(150)]
    frames += [(1, 1000, 10_000), (2, 1001, -10_000)]
    # arrival order is time order
    tele = [(f, n, t, v) for n, (f, _, t, v) in enumerate(sorted(tele, key=lambda r: (r[0], r[2])))]
    l = spark.createDataFrame(frames, "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT")
    r = spark.createDataFrame(tele, "flight_id BIGINT, seq BIGINT, ts_us BIGINT, v DOUBLE")
    for tol, width, target in ((15, 40, 5), (0, 500, 10_000), (400, 30, 7)):
        got = T.asof_nearest(l, r, right_cols=("v",), tol_us=tol, block_us=width, target_rows=target)
        rows = got.collect()
        assert len(rows) == len(frames)
        have = {(x.flight_id, x.frame_id): (x.match_dt_us, x.telemetry and x.telemetry.v) for x in rows}
        assert have == nearest(frames, tele, tol)


def test_tie_goes_to_the_earlier_and_tolerance_is_inclusive(spark):
    l = spark.createDataFrame([(1, 1, 100), (1, 2, 265), (1, 3, 266)], "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT")
    r = spark.createDataFrame([(1, 0, 90, 1.0), (1, 1, 110, 2.0), (1, 2, 115, 3.0)], "flight_id BIGINT, seq BIGINT, ts_us BIGINT, v DOUBLE")
    rows = T.asof_nearest(l, r, right_cols=("v",), tol_us=150).collect()
    got = {x.frame_id: x.telemetry and x.telemetry.v for x in rows}
    assert got == {1: 1.0, 2: 3.0, 3: None}


def test_streak_and_last_n(spark):
    rnd = random.Random(5)
    rows = [(f, i * 3, rnd.choice([None, 5])) for f in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "flight_id BIGINT, frame_id BIGINT, match_dt_us BIGINT")
    got = {(r.flight_id, r.frame_id): r.miss_streak for r in T.miss_streak(df, block=10).collect()}
    run = {}
    for f, i, m in rows:
        run[f] = 0 if m is not None else run.get(f, 0) + 1
        assert got[f, i] == run[f]
    q = {r.flight_id: (r.frames, r.failed_matches) for r in T.match_quality(df).collect()}
    assert q == {f: (200, sum(m is None for g, _, m in rows if g == f)) for f in (1, 2)}
    top = T.last_n(df, order=("frame_id",), n=3).collect()
    assert sorted((r.flight_id, r.frame_id) for r in top) == [(f, i) for f in (1, 2) for i in (591, 594, 597)]


def test_kafka_records_become_messages(spark):
    rows = [("4", "12.5", 0, [("other", "x"), ("topic", "telemetry/latitude")]), ("4", "31", 1, [("topic", "telemetry/rel_alt")]),
            ("4", "9", 2, None), ("4", "9", 3, [])]
    kafka = spark.createDataFrame(rows, "key STRING, value STRING, offset BIGINT, h ARRAY<STRUCT<key: STRING, value: STRING>>").selectExpr(
        "CAST(key AS BINARY) AS key", "CAST(value AS BINARY) AS value", "'flights' AS topic", "offset",
        "timestamp_seconds(offset) AS timestamp", "CAST(h AS ARRAY<STRUCT<key: STRING, value: BINARY>>) AS headers")
    messages = readers.telemetry_from_kafka(kafka)
    assert [(r.flight_id, r.seq, r.ts_us) for r in messages.collect()] == [(4, i, i * 1_000_000) for i in range(4)]
    got = sorted((r.seq, r.field, r.value) for r in T.decode_telemetry(messages).collect())
    assert got == [(0, "latitude", 12.5), (1, "rel_alt", 31.0)]
    with pytest.raises(ValueError):
        readers.telemetry_from_kafka(kafka.drop("headers"))
