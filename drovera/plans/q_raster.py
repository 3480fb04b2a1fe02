"""Elevation raster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster, tiles
from ..sources import readers, sinks
from ..streaming.run import scratch
from . import views as V
from .registry import ORACLES, query

_STORE_TILE = 32

# raster georeference, north up
META = {"a": 0.0001, "b": 0.0, "c": 8.88, "d": 0.0, "e": -0.0001, "f": 44.42}


def dem_meta(spark, d) -> DataFrame:
    """One row per raster; its height follows the table."""
    return V.dem_cells(spark, d).groupBy("dem_id").agg(
        *[F.lit(v).alias(k) for k, v in META.items()],
        F.lit(V.DEM_COLS).alias("width"),
        (F.max("row") + 1).alias("height"),
        F.lit("EPSG:4326").alias("crs"),
    )


@query(
    "raster_profile",
    f"""WITH {V.DEM} SELECT dem_id, "row" // 16 AS tile, count(*) AS size,
      count(*) FILTER (WHERE nodata = 1) AS nodata_count,
      round(count(*) FILTER (WHERE nodata = 1) / count(*) * 100, 6) AS nodata_pct, 'double' AS dtype,
      min(elev) AS min_elev, max(elev) AS max_elev FROM dem GROUP BY 1, 2""",
)
def profile(spark, d) -> DataFrame:
    cells = V.dem_cells(spark, d).withColumn("tile", F.expr("cast(row div 16 AS bigint)"))
    p = raster.raster_profile(cells, keys=("dem_id", "tile"))
    return p.withColumn("nodata_pct", F.round("nodata_pct", 6))


# two overlapping sources: parts from the left, and a shifted copy with other gaps and a sentinel
_MOSAIC = f"""{V.DEM}, src AS (
  SELECT dem_id, "row", col, CASE WHEN nodata = 0 THEN elev END AS elev, 1 AS source_rank FROM dem
  UNION ALL
  SELECT dem_id, "row" + 3, col + 7, CASE WHEN ("row" + col) % 5 = 0 THEN -9999 ELSE elev + 1000 END, 2 FROM dem)"""


@query(
    "mosaic_dem",
    f"""WITH {_MOSAIC}, best AS (
      SELECT dem_id, "row", col, arg_min(elev, source_rank) AS e FROM src WHERE elev IS NOT NULL AND elev <> -9999 GROUP BY 1, 2, 3),
    grid AS (SELECT dem_id, unnest(range(r0, r1 + 1)) AS "row", c0, c1 FROM (
      SELECT dem_id, min("row") r0, max("row") r1, min(col) c0, max(col) c1 FROM src GROUP BY 1) q),
    full_ AS (SELECT dem_id, "row", unnest(range(c0, c1 + 1)) AS col FROM grid)
    SELECT dem_id, "row", col, coalesce(e, 0.0) AS elev, CAST(e IS NULL AS BIGINT) AS nodata
    FROM full_ LEFT JOIN best USING (dem_id, "row", col)""",
)
def mosaic(spark, d) -> DataFrame:
    cells = V.dem_cells(spark, d)
    first = cells.select(
        "dem_id", "row", "col", F.when(F.col("nodata") == 0, F.col("elev")).alias("elev"),
        F.lit(1).alias("source_rank"),
    )
    second = cells.select(
        "dem_id", (F.col("row") + 3).alias("row"), (F.col("col") + 7).alias("col"),
        F.when((F.col("row") + F.col("col")) % 5 == 0, F.lit(-9999.0))
        .otherwise(F.col("elev") + 1000).alias("elev"),
        F.lit(2).alias("source_rank"),
    )
    m = raster.mosaic_dem(raster.union_sources(first, second), sentinel=-9999.0)
    return m.select(
        "dem_id", *[F.col(c).cast("bigint").alias(c) for c in ("row", "col")], "elev",
        F.col("nodata").cast("bigint").alias("nodata"),
    )


_PIXEL_M, _THRESHOLD = 9.5, 40.0


@query(
    "slope_mask",
    f"""WITH {V.DEM}, box AS (SELECT max("row") AS rm FROM dem), nbr AS (
      SELECT c."row", c.col, dr, dc, coalesce(n.elev, 0) AS e, n.elev IS NULL AS missing, c.elev AS own
      FROM dem c, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc), box
      LEFT JOIN dem n ON n."row" = least(greatest(c."row" + dr, 0), rm)
        AND n.col = least(greatest(c.col + dc, 0), {V.DEM_COLS - 1})),
    g AS (SELECT "row", col,
      sum(e * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / (8 * {_PIXEL_M}) AS dx,
      sum(e * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / (8 * {_PIXEL_M}) AS dy FROM nbr GROUP BY 1, 2)
    SELECT 'dem' AS dem_id, "row", col, round(dx, 6) AS dx, round(dy, 6) AS dy,
      CAST(dx * dx + dy * dy > power(tan(radians({_THRESHOLD})), 2) AS BIGINT) AS slope FROM g""",
)
def slope(spark, d) -> DataFrame:
    cells = V.dem_cells(spark, d)
    g = raster.slope_gradients(cells, pixel_m=_PIXEL_M, tile=16)
    m = raster.slope_mask(cells, pixel_m=_PIXEL_M, threshold_deg=_THRESHOLD, tile=16)
    both = g.select("dem_id", "row", "col", "dx", "dy").join(
        m.select("dem_id", "row", "col", "slope"), ["dem_id", "row", "col"]
    )
    return both.select(
        "dem_id", *[F.col(c).cast("bigint").alias(c) for c in ("row", "col")],
        F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"),
        F.col("slope").cast("bigint").alias("slope"),
    )


# poses in cell units, so that no position sits on a cell border
_POSE = {
    "col_c": "c_custkey % 53 - 1",
    "row_c": "(c_custkey * 7) % 47 - 3",
    "dx_c": "1 + c_custkey % 4",
    "dy_c": "c_custkey % 3",
}
_POSE_SQL = "po AS (SELECT c_custkey AS frame_id, " + ", ".join(f"{e} AS {n}" for n, e in _POSE.items()) + " FROM customer)"


def window_poses(spark, d) -> DataFrame:
    p = V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("frame_id"), F.lit("dem").alias("dem_id"),
        *[F.expr(e).alias(n) for n, e in _POSE.items()],
    )

    def lon(cells):
        return F.lit(META["c"]) + (cells + 0.5) * META["a"]

    def lat(cells):
        return F.lit(META["f"]) + (cells + 0.5) * META["e"]

    x, y, dx, dy = (F.col(c) for c in ("col_c", "row_c", "dx_c", "dy_c"))
    cols = {"longitude": lon(x), "latitude": lat(y)}
    for name, sx, sy in (("ul", -1, -1), ("ur", 1, -1), ("br", 1, 1), ("bl", -1, 1)):
        cols[f"{name}_lon"] = lon(x + sx * dx)
        cols[f"{name}_lat"] = lat(y + sy * dy)
    return p.withColumns(cols)


_WINDOW_SQL = f"""{V.DEM}, {_POSE_SQL}, w AS (
  SELECT frame_id, row_c, col_c, CAST(ceil(greatest(2 * dx_c, 2 * dy_c, 1) * 1.5) AS BIGINT) AS half FROM po),
win AS (SELECT *, row_c - half AS row0, row_c + half AS row1, col_c - half AS col0, col_c + half AS col1 FROM w)"""


def windows(spark, d) -> DataFrame:
    return raster.dem_window(window_poses(spark, d), dem_meta(spark, d), buffer_scale=1.0)


@query(
    "dem_window",
    f"""WITH {_WINDOW_SQL} SELECT frame_id, half AS half_size, 2 * half + 1 AS window_size, row0, row1, col0, col1,
      round(CAST({META['c']} + col0 * {META['a']} AS DOUBLE), 7) AS min_lon, round(CAST({META['f']} - (row1 + 1) * {META['a']} AS DOUBLE), 7) AS min_lat,
      round(CAST({META['c']} + (col1 + 1) * {META['a']} AS DOUBLE), 7) AS max_lon, round(CAST({META['f']} - row0 * {META['a']} AS DOUBLE), 7) AS max_lat,
      row0 >= 0 AND col0 >= 0 AND col1 < {V.DEM_COLS} AND row1 <= (SELECT max("row") FROM dem) AS on_raster FROM win""",
)
def window(spark, d) -> DataFrame:
    w = windows(spark, d)
    return w.select(
        "frame_id", *[F.col(c).cast("bigint").alias(c) for c in ("half_size", "window_size", "row0", "row1", "col0", "col1")],
        *[F.round(c, 7).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], "on_raster",
    )


@query(
    "dem_window_cells",
    f"""WITH {_WINDOW_SQL}, r AS (SELECT frame_id, unnest(range(row0, row1 + 1)) AS "row", col0, col1 FROM win),
    c AS (SELECT frame_id, "row", unnest(range(col0, col1 + 1)) AS col FROM r)
    SELECT frame_id, count(*) AS cells, round(sum(coalesce(elev, 0.0)), 4) AS elev_sum,
      CAST(sum(coalesce(nodata, 1)) AS BIGINT) AS nodata_cells
    FROM c LEFT JOIN dem USING ("row", col) GROUP BY 1""",
)
def window_cells(spark, d) -> DataFrame:
    c = raster.dem_window_cells(windows(spark, d), V.dem_cells(spark, d), window_keys=("frame_id",))
    return c.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("elev"), 4).alias("elev_sum"),
        F.sum("nodata").cast("bigint").alias("nodata_cells"),
    )


@query("dem_tile_windows", None)
def tile_windows(spark, d) -> DataFrame:
    """The same windows out of a tile store; only tiles that a window meets are read."""
    folder = scratch(spark, "tiles")
    packed = tiles.tile_raster(V.dem_cells(spark, d), values=["elev", "nodata"], tile=_STORE_TILE)
    sinks.write_dem_tiles(packed, folder)
    c = tiles.window_cells(
        windows(spark, d), readers.read_dem_tiles(spark, folder, tile=_STORE_TILE),
        values={"elev": F.lit(0.0), "nodata": F.lit(1)}, window_keys=("frame_id",), tile=_STORE_TILE,
    )
    return c.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("elev"), 4).alias("elev_sum"),
        F.sum("nodata").cast("bigint").alias("nodata_cells"),
    )


ORACLES["dem_tile_windows"] = ORACLES["dem_window_cells"]


# one camera frame, turned by about 20 degrees, laid over the raster; irrational-looking steps keep
# pixel centres off the cell borders
_AFF = {"aff_a": 3.7123e-06, "aff_b": 1.3517e-06, "aff_c": 8.8802131, "aff_d": -1.2931e-06,
        "aff_e": -3.6417e-06, "aff_f": 44.4198377}


@query(
    "sample_raster",
    f"""WITH {V.DEM}, pt AS (SELECT l_orderkey, l_linenumber, (l_partkey * 37 + l_suppkey) % 1280 AS x,
      (l_suppkey * 91 + l_partkey) % 720 AS y FROM lineitem),
    cell AS (SELECT x, y,
      CAST(floor(({_AFF['aff_a']} * (x + 0.5) + {_AFF['aff_b']} * (y + 0.5) + {_AFF['aff_c']} - {META['c']}) / {META['a']}) AS BIGINT) AS col,
      CAST(floor(({_AFF['aff_d']} * (x + 0.5) + {_AFF['aff_e']} * (y + 0.5) + {_AFF['aff_f']} - {META['f']}) / {META['e']}) AS BIGINT) AS "row" FROM pt)
    SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS points, any_value(elev) AS elev,
      CAST(any_value(nodata) AS BIGINT) AS nodata FROM cell LEFT JOIN dem USING ("row", col) GROUP BY x, y""",
)
def sample(spark, d) -> DataFrame:
    p = V.table(spark, d, "lineitem").select(
        F.lit("dem").alias("dem_id"),
        F.expr("(l_partkey * 37 + l_suppkey) % 1280").alias("x"),
        F.expr("(l_suppkey * 91 + l_partkey) % 720").alias("y"),
        *[F.lit(v).alias(k) for k, v in _AFF.items()],
    )
    # points of one pixel are counted before anything is joined
    p = p.groupBy(*p.columns).agg(F.count(F.lit(1)).alias("points"))
    s = raster.sample_raster(raster.pixel_to_cell(p, dem_meta(spark, d)), V.dem_cells(spark, d))
    return s.select(
        F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "points", "elev",
        F.col("nodata").cast("bigint").alias("nodata"),
    )


@query(
    "compute_once_per_pose",
    """SELECT o_orderkey AS frame_id, round(sqrt(o_custkey % 29 + 0.25) * 3.0, 6) AS layer FROM orders""",
)
def once_per_pose(spark, d) -> DataFrame:
    f = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame_id"),
        F.expr("cast(o_custkey % 29 AS double)").alias("latitude"),
        F.expr("CASE WHEN o_custkey % 29 > 14 THEN 1.5D END").alias("longitude"),
        F.lit(40.0).alias("rel_alt"), F.lit(270.0).alias("gb_yaw"),
    )
    out = raster.compute_once_per_pose(
        f, lambda p: p.withColumn("layer", F.sqrt(F.col("latitude") + 0.25) * 3.0)
    )
    return out.select("frame_id", F.round("layer", 6).alias("layer"))
