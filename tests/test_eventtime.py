"""Event-time logs over several micro-batches: late rows, expired flights, replayed batches."""

from __future__ import annotations

import random

from drovera.operators import alerts, telemetry
from drovera.streaming import eventtime

FIELDS = ("latitude", "longitude", "rel_alt", "gb_yaw")
DECODED = "flight_id BIGINT, seq BIGINT, ts_us BIGINT, field STRING, value DOUBLE"


def feed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def shuffled(rows, size, reach, seed):
    """Rows in batches of ``size``, each row up to ``reach`` places from its own."""
    rnd = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: i + rnd.uniform(0, reach))
    return [[rows[i] for i in order[a : a + size]] for a in range(0, len(rows), size)]


def judge(batches, delay):
    """(rows on time, late rows with their batch) by a plain loop."""
    marks, fine, late = {}, [], []
    for epoch, rows in enumerate(batches):
        for r in rows:
            if r[0] in marks and r[2] < marks[r[0]] - delay:
                late.append((epoch, r))
            else:
                fine.append(r)
        for r in rows:
            marks[r[0]] = max(marks.get(r[0], r[2]), r[2])
    return fine, late


def test_snapshots_of_disordered_messages(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i % 3, i, 10 * i, rnd.choice(FIELDS), rnd.random()) for i in range(240)]
    batches = shuffled(rows, 40, 60, 2)
    log = eventtime.snapshot_log(str(tmp_path / "log"), delay_us=150)
    got = log.drain(feed(spark, str(tmp_path / "in"), batches, DECODED))
    fine, late = judge(batches, 150)
    assert 0 < len(late) < 120
    assert sorted((r.epoch, r.flight_id, r.seq) for r in got.late.collect()) == sorted((e, r[0], r[1]) for e, r in late)
    assert {r.flight_id: r.late_rows for r in got.late_counts().collect()} == {f: sum(r[0] == f for _, r in late) for f in {r[0] for _, r in late}}
    want = telemetry.telemetry_snapshot(spark.createDataFrame(fine, DECODED))
    assert sorted(tuple(r) for r in got.rows.drop("epoch").collect()) == sorted(tuple(r) for r in want.collect())
    assert len({r.epoch for r in got.rows.collect()}) > 3 and got.closed.count() == 0


def test_expired_flights_start_again(spark, tmp_path):
    one = [(1, i, 10 * i, "rel_alt", float(i)) for i in range(5)]
    other = [(2, i, 1000 + 10 * i, "rel_alt", 1.0) for i in range(5)]
    back = [(1, 9, 2000, "latitude", 7.0), (2, 9, 1990, "latitude", 8.0)]
    log = eventtime.snapshot_log(str(tmp_path / "log"), delay_us=25, ttl_us=500, )
    got = log.drain(feed(spark, str(tmp_path / "in"), [one, other, back], DECODED))
    # the first flight closes with the second batch, its pending rows are finished there
    assert [(r.flight_id, r.last_us, r.epoch) for r in got.closed.collect()] == [(1, 40, 1)]
    rows = {(r.flight_id, r.seq): r for r in got.rows.collect()}
    assert len(rows) == 12 and rows[1, 4].epoch == 1 and rows[1, 2].epoch <= 1
    template = eventtime.C.TELEMETRY_TEMPLATE
    assert rows[1, 9].rel_alt == template["rel_alt"] and rows[2, 9].rel_alt == 1.0
    assert got.late.count() == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [(1, i, 10 * i, random.Random(i).choice(FIELDS), float(i)) for i in range(90)]
    log = eventtime.snapshot_log(str(tmp_path / "log"), delay_us=35)
    parts = [spark.createDataFrame(rows[a : a + 30], DECODED) for a in (0, 30, 60)]
    for epoch, part in enumerate(parts):
        log.batch(part, epoch)
        log.batch(part, epoch)  # the same batch after a failure
    log.batch(parts[0].limit(0), 3, flush=True)
    got = spark.read.parquet(str(tmp_path / "log/rows")).drop("epoch")
    want = telemetry.telemetry_snapshot(spark.createDataFrame(rows, DECODED))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_cooldown_of_disordered_alerts(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i % 2, i, 3 * i + rnd.randint(0, 2), rnd.choice(["", "a", "b"])) for i in range(200)]
    schema = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, alert_msg STRING"
    batches = shuffled(rows, 50, 20, 4)
    log = eventtime.cooldown_log(str(tmp_path / "log"), cooldown_us=20, delay_us=90)
    got = log.drain(feed(spark, str(tmp_path / "in"), batches, schema))
    fine, late = judge(batches, 90)
    assert got.late.count() == len(late)
    want = alerts.alert_cooldown(spark.createDataFrame(fine, schema), cooldown_us=20)
    cols = ("flight_id", "frame_id", "ts_us", "alert_msg")
    assert sorted(tuple(r) for r in got.rows.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())
