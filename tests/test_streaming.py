"""Streams fed in several micro-batches give the batch answers."""

from __future__ import annotations

import random

import pytest

from drovera.operators import alerts, telemetry
from drovera.streaming import stateful
from drovera.streaming.run import drain


@pytest.fixture(autouse=True)
def rocksdb(spark):
    stateful.use_rocksdb(spark)


def as_stream(spark, df, path, order, parts=4):
    """One file per part, in time order, read one file per micro-batch."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshots_and_cooldown(spark, tmp_path):
    rnd = random.Random(1)
    msgs = [(f, i, 10 * i + f, rnd.choice(["latitude", "rel_alt", "gb_yaw"]), rnd.random()) for i in range(80) for f in (1, 2)]
    df = spark.createDataFrame(msgs, "flight_id BIGINT, seq BIGINT, ts_us BIGINT, field STRING, value DOUBLE")
    stream = as_stream(spark, df, str(tmp_path / "m"), "ts_us")
    assert rows_of(drain(stateful.locf(stream), "t1")) == rows_of(telemetry.telemetry_snapshot(df))
    cand = [(f, i, 3 * i + rnd.randint(0, 2), rnd.choice(["", "a"])) for i in range(100) for f in (1, 2)]
    df = spark.createDataFrame(cand, "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, alert_msg STRING")
    stream = as_stream(spark, df, str(tmp_path / "c"), "ts_us")
    assert rows_of(drain(stateful.cooldown(stream, cooldown_us=20), "t2")) == rows_of(alerts.alert_cooldown(df, cooldown_us=20))


def test_asof_across_buckets(spark, tmp_path):
    rnd = random.Random(2)
    sec = 1_000_000
    frames = [(f, i, i * sec // 3 + rnd.randint(0, 200_000)) for i in range(90) for f in (1, 2)]
    tele = [(1, i, i * sec // 2 + rnd.randint(0, 90_000), float(i)) for i in range(60) if i % 9]
    end = 10_000 * sec
    l = spark.createDataFrame([*frames, (-1, -1, end)], "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT")
    r = spark.createDataFrame(tele, "flight_id BIGINT, seq BIGINT, ts_us BIGINT, v DOUBLE")
    out = drain(
        stateful.asof(as_stream(spark, l, str(tmp_path / "l"), "ts_us", 3), as_stream(spark, r, str(tmp_path / "r"), "ts_us", 3),
                      cols=("v",), bucket_us=2 * sec, watermark="20 seconds"), "t3")
    got = sorted((x.flight_id, x.frame_id, x.match_dt_us, x.v) for x in out.filter("flight_id > 0").collect())
    want = telemetry.asof_nearest(l, r, right_cols=("v",)).filter("flight_id > 0").collect()
    key = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted(got, key=key) == sorted(((x.flight_id, x.frame_id, x.match_dt_us, x.telemetry and x.telemetry.v) for x in want), key=key)
