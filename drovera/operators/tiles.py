"""Rasters as tiles: one row per square of cells, with the cells packed into arrays.

A tile is the unit of storage, pruning and joining. Points carry the tile they fall into and look
their cell up by its place in the array, so a raster of any size is spread over its tiles and a
lookup shuffles at most one fat row per tile instead of one row per cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

TILE = 256
AT = ("tile_row", "tile_col")


def tile_of(index: Column | str, tile: int = TILE) -> Column:
    """Number of the tile that holds a row or column; also left of and above the origin."""
    c = F.col(index) if isinstance(index, str) else index
    return F.floor(c / tile).cast("int")


def _place(row: Column, col: Column, tile: int) -> Column:
    return (F.pmod(row.cast("bigint"), F.lit(tile)) * tile + F.pmod(col.cast("bigint"), F.lit(tile))).cast("int")


def tile_raster(
    cells: DataFrame, *, values: Sequence[str], keys: Sequence[str] = ("dem_id",), tile: int = TILE
) -> DataFrame:
    """Cells ``(keys, row, col, values)`` to tiles ``(keys, tile_row, tile_col, values)``.

    Each value becomes an array of the tile's cells by rows, null where a cell is absent; the array
    ends at the last present cell. A cell given twice counts once, with its smallest values. Tiles
    without cells do not exist.
    """
    place = _place(F.col("row"), F.col("col"), tile)
    at = [tile_of("row", tile).alias("tile_row"), tile_of("col", tile).alias("tile_col")]
    packed = cells.select(*keys, *at, F.struct(place.alias("i"), *values).alias("_v")).groupBy(*keys, *AT).agg(
        F.array_sort(F.collect_list("_v")).alias("_v")
    )
    once = F.filter("_v", lambda v, i: (i == 0) | (F.get("_v", i - 1)["i"] != v["i"]))
    packed = packed.withColumn("_v", once)

    def dense(name: str) -> Column:
        def cell(v: Column, i: Column) -> Column:
            gap = v["i"] - F.coalesce(F.get("_v", i - 1)["i"], F.lit(-1)) - 1
            absent = F.lit(None).cast(dict(cells.dtypes)[name])
            return F.concat(F.array_repeat(absent, gap), F.array(v[name]))

        # the place before the first is none, not the last
        return F.flatten(F.transform("_v", cell)).alias(name)

    return packed.select(*keys, *AT, *[dense(n) for n in values])


def cells_of(tiles: DataFrame, *, values: Sequence[str], keys: Sequence[str] = ("dem_id",), tile: int = TILE) -> DataFrame:
    """The cells of tiles, one row each; cells whose values are all null are absent."""
    zipped = F.posexplode(F.arrays_zip(*values)).alias("_i", "_v")
    rows = tiles.select(*keys, *AT, zipped)
    found = rows.select(
        *keys, (F.col("tile_row") * tile + F.floor(F.col("_i") / tile)).cast("int").alias("row"),
        (F.col("tile_col") * tile + F.col("_i") % tile).cast("int").alias("col"), *[F.col(f"_v.{n}").alias(n) for n in values],
    )
    return found.filter(F.coalesce(*[F.col(n).cast("string") for n in values]).isNotNull())


def sample_tiles(
    points: DataFrame, tiles: DataFrame, *, values: Mapping[str, Column | None] | Sequence[str],
    keys: Sequence[str] = ("dem_id",), row: str = "row", col: str = "col", tile: int = TILE,
) -> DataFrame:
    """Cell values for points that carry ``row`` and ``col``; null, or the given default, where there is no cell.

    The join key is the tile. Many points in one tile make one large side of a partition, which
    adaptive execution splits; the tile's row is only referred to, not copied.
    """
    default = dict(values) if isinstance(values, Mapping) else {n: None for n in values}
    at = points.withColumns({"tile_row": tile_of(row, tile), "tile_col": tile_of(col, tile)})
    named = tiles.select(*keys, *AT, *[F.col(n).alias(f"_t_{n}") for n in default])
    found = at.join(named, [*keys, *AT], "left")
    place = _place(F.col(row), F.col(col), tile)

    def value(name: str, other: Column | None) -> Column:
        got = F.get(F.col(f"_t_{name}"), place)
        return (got if other is None else F.coalesce(got, other)).alias(name)

    return found.select(*points.columns, *[value(n, o) for n, o in default.items()])


def with_meta(
    df: DataFrame, dem_meta: DataFrame, cols: Sequence[str], *, by: Sequence[str], keys: Sequence[str] = ("dem_id",), salts: int = 64
) -> DataFrame:
    """Rows with columns of their raster's description.

    A raster is one key with a third of all rows or more, so the description is copied and the rows
    are dealt to the copies by ``by``. Small descriptions are broadcast by Spark's own size check.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    copies = dem_meta.select(*keys, *cols, salt.alias("_salt"))
    dealt = df.withColumn("_salt", F.pmod(F.hash(*by), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def window_cells(
    windows: DataFrame, tiles: DataFrame, *, values: Mapping[str, Column], keys: Sequence[str] = ("dem_id",),
    window_keys: Sequence[str] = ("flight_id", "frame_id"), tile: int = TILE,
) -> DataFrame:
    """Cells ``row0..row1 x col0..col1`` of each window with defaults where the raster has none.

    A window is cut into its tiles before it meets them, so it is joined by tile and expands into
    cells afterwards.
    """
    edge = lambda name: F.col(name).cast("bigint")
    w = windows.select(
        *window_keys, *keys, *[edge(n).alias(n) for n in ("row0", "row1", "col0", "col1")],
        F.explode(F.sequence(tile_of("row0", tile), tile_of("row1", tile))).alias("tile_row"),
    ).withColumn("tile_col", F.explode(F.sequence(tile_of("col0", tile), tile_of("col1", tile))))
    met = spread(w, *window_keys, *AT).join(tiles.select(*keys, *AT, *values), [*keys, *AT], "left")

    def inside(low: str, high: str, at: str) -> Column:
        start = F.col(at).cast("bigint") * tile
        return F.sequence(F.greatest(F.col(low), start), F.least(F.col(high), start + (tile - 1)))

    lines = met.withColumn("row", F.explode(inside("row0", "row1", "tile_row")))
    first = F.greatest(F.col("col0"), F.col("tile_col").cast("bigint") * tile)
    last = F.least(F.col("col1"), F.col("tile_col").cast("bigint") * tile + (tile - 1))
    start, n = _place(F.col("row"), first, tile), (last - first + 1).cast("int")
    # one slice of every array per line, so the tile itself does not travel into the expansion
    cut = {f"_s_{name}": F.slice(F.col(name), start + 1, n) for name in values}
    lines = lines.select(*window_keys, *keys, "row", first.alias("_first"), F.sequence(F.lit(0), n - 1).alias("_n"), *[c.alias(k) for k, c in cut.items()])
    cells = lines.select("*", F.explode("_n").alias("_i")).drop("_n")
    return cells.select(
        *window_keys, *keys, "row", (F.col("_first") + F.col("_i")).alias("col"),
        *[F.coalesce(F.get(F.col(f"_s_{name}"), F.col("_i")), other).alias(name) for name, other in values.items()],
    )
