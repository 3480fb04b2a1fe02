from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from drovera.operators import alerts as A
from drovera.operators import anomaly
from drovera.plans import danger
from drovera.sources import readers, sinks

ROW = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, alert_msg STRING"


def greedy(rows, cooldown):
    out, last = [], {}
    for f, i, t, m in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if m and (f not in last or t - last[f] >= cooldown):
            last[f] = t
            out.append((f, i))
    return sorted(out)


@pytest.mark.parametrize("seed,cooldown,width,target", [(1, 10, 40, 10_000), (2, 25, 10, 3), (3, 7, 1000, 5), (4, 1, 8, 2)])
def test_cooldown_matches_the_greedy_rule(spark, seed, cooldown, width, target):
    rnd = random.Random(seed)
    rows = []
    for f, n in ((1, 500), (2, 40), (3, 1)):
        t = 0
        for i in range(n):
            t += rnd.choice([0, 1, 1, 2, 3, cooldown, cooldown - 1, 60 if rnd.random() < 0.1 else 1])
            rows.append((f, i, t, rnd.choice(["", "x", "y"]) if n > 1 else "x"))
    df = spark.createDataFrame(rows, ROW)
    got = A.alert_cooldown(df, cooldown_us=cooldown, block_us=width, target_rows=target)
    assert sorted((r.flight_id, r.frame_id) for r in got.collect()) == greedy(rows, cooldown)


def test_cooldown_of_nothing(spark):
    assert A.alert_cooldown(spark.createDataFrame([(1, 1, 5, "")], ROW)).count() == 0


def test_sessions(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.randint(0, 3000)) for k in (1, 1, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "flight_id BIGINT, ts_us BIGINT")
    got = sorted((r.flight_id, r.start_us, r.last_us, r.events) for r in A.session_close(df, gap_us=20, block_us=100, target_rows=4).collect())
    want = []
    for k in (1, 2):
        ts = sorted(t for q, t in rows if q == k)
        cur = [ts[0]]
        for t in ts[1:]:
            if t - cur[-1] >= 20:
                want.append((k, cur[0], cur[-1], len(cur)))
                cur = []
            cur.append(t)
        want.append((k, cur[0], cur[-1], len(cur)))
    assert got == sorted(want)


def test_throughput_blocks(spark):
    rows = [(1, i * 2, i % 7, 0.001 * i) for i in range(25)]
    df = spark.createDataFrame(rows, "flight_id BIGINT, frame_id BIGINT, backlog INT, proc_s DOUBLE")
    got = sorted(tuple(r)[1:] for r in A.stage_throughput(df, fps=10, block=6).collect())
    assert [(g[0], g[1], g[2]) for g in got] == [(0, 10, 6), (1, 10, 6), (2, 5, 6)]
    assert got[1][3] == pytest.approx(14.5) and got[1][4] == pytest.approx(19.0)


def test_messages_and_summary(spark):
    rows = [(1, 5, 7, True, "confirmed_ae"), (1, 5, 3, True, "confirmed_both"), (1, 5, 9, False, "confirmed_soc"),
            (1, 5, 4, True, "elevated_ae"), (1, 6, 1, True, "ok")]
    df = spark.createDataFrame(rows, "flight_id BIGINT, frame_id BIGINT, track_id BIGINT, is_visible BOOLEAN, state STRING")
    assert {r.frame_id: r.alert_msg for r in A.anomaly_message(df).collect()} == {5: "Anomaly: tracks [3, 7]", 6: ""}
    hud = {r.frame_id: r.hud for r in anomaly.frame_summary(df).collect()}
    assert hud == {5: "Frame 5 | tracks=3 | elevated=1 | confirmed=2", 6: "Frame 6 | tracks=1 | elevated=0 | confirmed=0"}
    lab = anomaly.track_label(df.withColumns({"ae_smooth": F.lit(1.256), "soc_smooth": F.lit(2.0)})).collect()
    assert lab[0].label == "ID:7 ae=1.26 soc=2.00" and lab[0].colour == "0,0,255"


def test_payload_log_and_rows(spark, tmp_path):
    a = spark.createDataFrame([(1, 2, 1_700_000_000_250_000, "Roads", b"\x01\x02", 1920, 1080), (1, 3, 1_700_000_001_000_000, "Slope", None, 1920, 1080)],
                              ROW + ", image BINARY, orig_w INT, orig_h INT")
    p = A.alert_payload(a).orderBy("frame_id").collect()
    assert p[0].datetime == "2023-11-14T22:13:20.250000" and p[1].datetime == "2023-11-14T22:13:21"
    assert p[0].image == "AQI=" and p[1].image is None and p[0].timestamp == 1_700_000_000.25
    assert json.loads(A.payload_json(A.alert_payload(a)).first().value)["compression"] == "jpeg"
    path = str(tmp_path / "log")
    sinks.write_alert_log(a, path)
    sinks.write_alert_log(a, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == 4 and list(lines[0]) == ["frame_id", "alert_msg", "timestamp", "datetime"]
    rows = sinks.alert_rows(A.alert_payload(a))
    assert bytes(rows.orderBy("frame_id").first().image_data) == b"\x01\x02"
    stored = rows.filter("frame_id = 2")
    assert [r.frame_id for r in sinks.new_alert_rows(rows.unionByName(rows), stored).collect()] == [3]


def log_record(n, diff, wall, lat, lon, rel, up, yaw, pitch, roll):
    """A record in the format of the log, with the given invented values."""
    return (
        f"{n}\n00:00:00,000 --> 00:00:00,040\n<font size=\"20\">FrameCnt: {n}, DiffTime: {diff}ms\n{wall}\n"
        f"[iso: 400] [latitude: {lat}] [longitude: {lon}] [rel_alt: {rel} abs_alt: {up}] "
        f"[gb_yaw: {yaw} gb_pitch: {pitch} gb_roll: {roll}] </font>\n\n"
    )


RECORDS = [
    (7, 40, "2021-03-02 08:15:00.250", -12.5, 131.04, 61.2, 75.9, 12.5, -45.0, 1.5),
    (8, 41, "2021-03-02 08:15:00.291", -12.625, 131.1, 60.75, 75.4, -170.25, -44.5, -0.5),
    (9, 39, "2021-03-02 08:15:00.330", 0.0, -0.125, 0.0, 14.0, 0.0, 90.0, 0.0),
]


def test_flight_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(log_record(*r) for r in RECORDS))
    got = sorted(readers.read_flight_log(spark, str(tmp_path / "log.txt")).collect(), key=lambda r: r.frame_cnt)
    assert len(got) == len(RECORDS)
    for r, (n, diff, wall, *numbers) in zip(got, RECORDS):
        assert (r.frame_cnt, r.diff_ms, str(r.wall_ts)) == (n, diff, wall + "000")
        assert [r.latitude, r.longitude, r.rel_alt, r.abs_alt, r.gb_yaw, r.gb_pitch, r.gb_roll] == numbers


def test_frames_without_visible_tracks_count_zero(spark):
    df = spark.createDataFrame([(1, 2, "confirmed_ae", False), (1, 3, "elevated_soc", True)],
        "flight_id BIGINT, frame_id BIGINT, state STRING, is_visible BOOLEAN")
    frames = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "flight_id BIGINT, frame_id BIGINT")
    got = sorted((r.frame_id, r.tracks, r.elevated, r.confirmed) for r in anomaly.frame_summary(df, frames).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 1, 0)]


def test_frames_without_states_have_lines_and_lists(spark):
    df = spark.createDataFrame([(1, 2, 7, "confirmed_ae", True, False, True), (1, 2, 3, "confirmed_ae", True, False, False), (1, 3, 9, "ok", False, False, True)],
        "flight_id BIGINT, frame_id BIGINT, track_id BIGINT, state STRING, ae_up BOOLEAN, soc_up BOOLEAN, is_visible BOOLEAN")
    frames = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "flight_id BIGINT, frame_id BIGINT")
    got = {(r.flight_id, r.frame_id): r.alert_msg for r in A.anomaly_message(df, frames=frames).collect()}
    assert got == {(1, 1): "", (1, 2): "Anomaly: tracks [7]", (1, 3): "", (2, 1): ""}
    lists = {(r.flight_id, r.frame_id): (r.confirmed_ae_tracks, r.ok_tracks, r.ok_ae_tracks) for r in anomaly.ids_by_state(df, frames=frames).collect()}
    assert lists == {(1, 1): ([], [], []), (1, 2): ([3, 7], [], []), (1, 3): ([], [9], [9]), (2, 1): ([], [], [])}


def test_dem_sources(spark, tmp_path):
    elev = spark.createDataFrame([("d", 0, 0, 1.0), ("d", 0, 1, 2.0)], "dem_id STRING, row INT, col INT, elev DOUBLE")
    mask = spark.createDataFrame([("d", 0, 1, 1)], "dem_id STRING, row INT, col INT, nodata INT")
    e, m = str(tmp_path / "e"), str(tmp_path / "m")
    elev.write.parquet(e)
    mask.write.parquet(m)
    assert readers.read_dem_cells(spark, None, m) is None
    assert readers.read_dem_cells(spark, str(tmp_path / "none")) is None
    assert {r.col: r.nodata for r in readers.read_dem_cells(spark, e, m).collect()} == {0: 0, 1: 1}
    assert {r.nodata for r in readers.read_dem_cells(spark, e, str(tmp_path / "none")).collect()} == {0}


def test_cell_width(spark):
    meta = spark.createDataFrame([("d", 0.001, 0.0, 10.0, 0.0, -0.001, 45.05, 100, 100, "x")],
        "dem_id STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE, width INT, height INT, crs STRING")
    assert danger.cell_width_m(meta).first().pixel_m == pytest.approx(78.85, abs=0.05)


def test_ledger_publishes_a_replayed_batch_once():
    """The statements in an in-process database; the staging rows stand for what Spark appends."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE alerts (flight_id BIGINT, frame_id BIGINT, alert_msg VARCHAR)")
    con.execute("CREATE TABLE alerts_ledger (stream VARCHAR, epoch BIGINT)")
    con.execute("CREATE TABLE alerts_staged AS SELECT *, '' AS stream, 0::BIGINT AS epoch FROM alerts")
    columns = ["flight_id", "frame_id", "alert_msg"]

    def batch(epoch, rows, stream="a's", publish=True):
        for r in rows:
            con.execute("INSERT INTO alerts_staged VALUES (?, ?, ?, ?, ?)", [*r, stream, epoch])
        if publish:
            con.execute("BEGIN")
            for statement in sinks.ledger_statements("alerts", epoch, stream, columns):
                con.execute(statement)
            con.execute("COMMIT")

    batch(0, [(1, 1, "x"), (1, 1, "x"), (1, 2, "y")])
    batch(1, [(1, 3, "z")], publish=False)  # lost before it was published
    batch(1, [(1, 3, "z"), (2, 1, "w")])  # and again, its old rows still staged
    batch(1, [(1, 3, "z"), (2, 1, "w"), (9, 9, "no")])  # and again after it was
    batch(0, [(1, 2, "other")], stream="b")  # stored by another stream
    assert sorted(con.execute("SELECT * FROM alerts").fetchall()) == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "w")]
    assert sorted(con.execute("SELECT * FROM alerts_ledger").fetchall()) == [("a's", 0), ("a's", 1), ("b", 0)]
    assert con.execute("SELECT count(*) FROM alerts_staged").fetchone() == (0,)
    conditions = sinks.key_predicates(5, 40, 4)
    hits = [f for f in range(50) if sum(con.execute(f"SELECT {c.replace('flight_id', str(f))}").fetchone()[0] for c in conditions) == 1]
    assert hits == list(range(5, 41))


def test_slow_averages_scan_in_levels(spark):
    rnd = random.Random(5)
    rows = [(f, n, rnd.random()) for f in (1, 2) for n in range(300)]
    df = spark.createDataFrame(rows, "flight_id BIGINT, _n BIGINT, x DOUBLE")
    for rate, block in ((1e-6, 4), (0.01, 7), (0.5, 1000), (700.0, 3), (1.2, 1)):
        got = {(r.flight_id, r._n): r.x for r in anomaly.affine_scan(df, ["flight_id"], ["x"], rate=rate, block=block).collect()}
        state = {}
        for f, n, x in rows:
            state[f] = state.get(f, 0.0) * math.exp(-rate) + x
            assert abs(got[f, n] - state[f]) < 1e-9 * max(1, abs(state[f])), (rate, block, n)


def test_mosaic_grid_has_no_single_maker(spark, monkeypatch):
    from drovera.operators import raster

    monkeypatch.setattr(raster, "GRID_CELLS", 20_000)
    cells = spark.createDataFrame([("d", -3, 5, 1.0, 1), ("d", 600, 400, 2.0, 1)], "dem_id STRING, row INT, col INT, elev DOUBLE, source_rank INT")
    out = raster.mosaic_dem(cells)
    assert out.count() == 604 * 396 and out.filter("nodata = 0").count() == 2
    assert out.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first() == (-3, 600, 5, 400)
