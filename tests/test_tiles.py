"""Tiled rasters against cells."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from drovera.operators import tiles as T
from drovera.sources import readers, sinks

CELLS = "dem_id STRING, row INT, col INT, elev DOUBLE, nodata INT"


def some_cells(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = {(rnd.choice("ab"), rnd.randrange(-20, 40), rnd.randrange(-5, 60)): rnd.random() for _ in range(n)}
    found = [(k[0], k[1], k[2], v, i % 3) for i, (k, v) in enumerate(sorted(rows.items()))]
    return found, spark.createDataFrame(found, CELLS)


def test_cells_survive_packing(spark):
    rows, df = some_cells(spark)
    packed = T.tile_raster(df.union(df.limit(40)), values=["elev", "nodata"], tile=16)
    assert packed.count() == len({(d, r // 16, c // 16) for d, r, c, *_ in rows})
    back = T.cells_of(packed, values=["elev", "nodata"], tile=16)
    assert sorted(tuple(r) for r in back.select("dem_id", "row", "col", "elev", "nodata").collect()) == rows
    assert T.tile_raster(df.limit(0), values=["elev"], tile=16).count() == 0


def test_points_look_their_cells_up(spark):
    rows, df = some_cells(spark)
    have = {r[:3]: r[3:] for r in rows}
    asked = [(d, r, c) for d in "abc" for r in range(-22, 42, 3) for c in range(-7, 62, 2)]
    points = spark.createDataFrame(asked, "dem_id STRING, row INT, col INT")
    packed = T.tile_raster(df, values=["elev", "nodata"], tile=16)
    got = T.sample_tiles(points, packed, values={"elev": None, "nodata": F.lit(9)}, tile=16).collect()
    assert {(r.dem_id, r.row, r.col): (r.elev, r.nodata) for r in got} == {k: have.get(k, (None, 9)) for k in asked}


def test_windows_over_tile_borders(spark):
    rows, df = some_cells(spark)
    have = {r[:3]: r[3:] for r in rows}
    windows = spark.createDataFrame([(1, 1, "a", -3, 17, 10, 40), (1, 2, "b", 100, 101, 0, 1), (2, 1, "a", 5, 5, 5, 5)],
        "flight_id BIGINT, frame_id BIGINT, dem_id STRING, row0 INT, row1 INT, col0 INT, col1 INT")
    packed = T.tile_raster(df, values=["elev", "nodata"], tile=16)
    got = T.window_cells(windows, packed, values={"elev": F.lit(0.0), "nodata": F.lit(1)}, tile=16).collect()
    want = {
        (w.flight_id, w.frame_id, r, c): have.get((w.dem_id, r, c), (0.0, 1))
        for w in windows.collect() for r in range(w.row0, w.row1 + 1) for c in range(w.col0, w.col1 + 1)
    }
    assert {(r.flight_id, r.frame_id, r.row, r.col): (r.elev, r.nodata) for r in got} == want and len(got) == len(want)


def test_tile_files_are_pruned(spark, tmp_path):
    rows = [("a", r, c, float(r * 100 + c), 0) for r in range(64) for c in range(64)]
    path = str(tmp_path / "tiles")
    sinks.write_dem_tiles(T.tile_raster(spark.createDataFrame(rows, CELLS), values=["elev", "nodata"], tile=16), path)
    near = readers.read_dem_tiles(spark, path, rows=(20, 40), cols=(0, 10), tile=16)
    assert len(near.inputFiles()) == 16  # what the folder has
    plan = near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(tile_row" in plan and "tile_col" in plan
    assert {(r.tile_row, r.tile_col) for r in near.collect()} == {(1, 0), (2, 0)}
    assert near.select(F.input_file_name().alias("f")).distinct().count() == 2
    one = T.sample_tiles(spark.createDataFrame([("a", 30, 5)], "dem_id STRING, row INT, col INT"), near, values=["elev"], tile=16)
    assert one.first().elev == 3005.0


def test_descriptions_meet_every_row_once(spark):
    meta = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "dem_id STRING, a DOUBLE")
    rows = spark.range(500).select("id", F.when(F.col("id") % 50 == 0, "b").when(F.col("id") == 7, "c").otherwise("a").alias("dem_id"))
    got = T.with_meta(rows, meta, ["a"], by=["id"]).collect()
    assert sorted((r.id, r.a) for r in got) == [(i, 2.0 if i % 50 == 0 else 1.0) for i in range(500) if i != 7]


def test_flight_log_with_other_line_ends(spark, tmp_path):
    from test_alerts import RECORDS, log_record

    text = "".join(log_record(*r) for r in RECORDS)
    for name, form in (("crlf", text.replace("\n", "\r\n")), ("blanks", text.replace("\n\n", "\n \t\n\n"))):
        (tmp_path / name).write_bytes(form.encode())
        got = sorted(readers.read_flight_log(spark, str(tmp_path / name)).collect(), key=lambda r: r.frame_cnt)
        assert [(r.frame_cnt, r.diff_ms, r.latitude, r.gb_roll) for r in got] == [(n, d, v[0], v[-1]) for n, d, _, *v in RECORDS]
