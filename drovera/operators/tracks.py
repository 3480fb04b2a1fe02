"""Per-track motion: keyframes, segments, velocity, neighbours, bridging and interpolation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import motion
from . import ordered as O

TRACK = ("flight_id", "track_id")
KEYFRAME = ("flight_id", "kf_seq")

# layout of a feature vector
FEATURES = (
    "vx_world", "vy_world", "rel_vx", "rel_vy", "speed", "rel_speed", "rel_x", "rel_y", "knn_dist",
)


def keyframe_sampling(
    frames: DataFrame,
    *,
    skip: int = C.FRAME_SKIP,
    keys: Sequence[str] = ("flight_id",),
    order: str = "frame_id",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """The first frame of a flight is a keyframe, then every (skip + 1)-th that arrives."""
    df = O.row_index(O.seq_blocks(frames, order, size=block), keys, [order], "_n").drop(O.BLK)
    at = F.col("_n") - 1
    return df.withColumns(
        {
            "is_keyframe": F.pmod(at, F.lit(skip + 1)) == 0,
            "kf_seq": F.expr(f"(_n - 1) div {skip + 1}"),
        }
    ).drop("_n")


def track_center(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}
    )


def _starts_segment(prev: Column, seq: str, max_age: int) -> Column:
    return F.coalesce(F.col(seq) - prev - 1 > max_age, F.lit(True))


def track_segments(
    tracks: DataFrame,
    *,
    max_age: int = C.INTERP_MAX_AGE,
    keys: Sequence[str] = TRACK,
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Segment number per track; an absence longer than ``max_age`` keyframes starts a new one."""
    df = O.with_halo(tracks, seq, size=block, back=max_age + 1)
    prev = F.lag(seq).over(O.block_window(keys, [seq]))
    df = df.withColumn("_new", _starts_segment(prev, seq, max_age).cast("int"))
    df = df.filter("_own").drop("_own")
    return O.running_sum(df, keys, [seq], {"segment": F.col("_new")}).drop("_new", O.BLK)


def world_velocity(
    tracks: DataFrame,
    keyframes: DataFrame | None = None,
    *,
    max_age: int = C.INTERP_MAX_AGE,
    keys: Sequence[str] = TRACK,
    keyframe_keys: Sequence[str] = KEYFRAME,
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Displacement since the previous sighting, in the current camera frame.

    The previous centre is warped by the current keyframe's homography (identity when null). The
    first sighting of a segment has velocity (0, 0). Look-back never exceeds ``max_age`` + 1
    keyframes, so a halo of that width replaces any carry between blocks.
    """
    df = O.with_halo(tracks, seq, size=block, back=max_age + 1)
    w = O.block_window(keys, [seq])
    df = df.withColumns({f"_p_{c}": F.lag(c).over(w) for c in (seq, "cx", "cy")})
    df = O.own_rows(df)
    if keyframes is None:
        df = df.withColumn("h", F.lit(None).cast("array<double>"))
    else:
        df = df.join(keyframes.select(*keyframe_keys, "h"), list(keyframe_keys), "left")
    wx, wy = motion.perspective_apply(F.col("h"), F.col("_p_cx"), F.col("_p_cy"))
    first = _starts_segment(F.col(f"_p_{seq}"), seq, max_age)
    return df.withColumns(
        {
            "vx": F.when(first, F.lit(0.0)).otherwise(F.col("cx") - wx),
            "vy": F.when(first, F.lit(0.0)).otherwise(F.col("cy") - wy),
            "new_segment": first,
        }
    ).drop("h", f"_p_{seq}", "_p_cx", "_p_cy")


# ---------------------------------------------------------------- nearest neighbours


def _mean(items: Column, value) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda acc, o: acc + value(o))
    return total / F.size(items)


def _relative(df: DataFrame, nb: str, size: float) -> dict[str, Column]:
    """Nine features from the own motion and the neighbour list; no neighbours, no offsets."""
    items = F.col(nb)
    alone = F.size(items) == 0
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))

    def off(own: Column, value) -> Column:
        return F.when(alone, F.lit(0.0)).otherwise(own - _mean(items, value))

    raw = {
        "vx_world": F.col("vx"),
        "vy_world": F.col("vy"),
        "rel_vx": off(F.col("vx"), lambda o: o["vx"]),
        "rel_vy": off(F.col("vy"), lambda o: o["vy"]),
        "speed": speed,
        "rel_speed": off(speed, lambda o: F.sqrt(o["vx"] * o["vx"] + o["vy"] * o["vy"])),
        "rel_x": off(F.col("cx"), lambda o: o["cx"]),
        "rel_y": off(F.col("cy"), lambda o: o["cy"]),
        "knn_dist": F.when(alone, F.lit(0.0)).otherwise(_mean(items, lambda o: F.sqrt(o["d2"]))),
    }
    return {n: (e / F.lit(size)).cast("float") for n, e in raw.items()}


_POINT = ("track_id", "cx", "cy", "vx", "vy")


#: Cells are squares of 2^level pixels; none is smaller than this.
FINEST_LEVEL = -6


def _neighbour_lists(df: DataFrame, spots: DataFrame, frame: Sequence[str], k: int, one_level: int) -> DataFrame:
    """Per distinct position of ``spots`` its k + 1 nearest tracks of ``df``, through a pyramid of square cells.

    Work is per distinct position, which needs its k + 1 nearest candidates (a track then leaves
    itself out); of the tracks sharing one position only the k + 1 smallest ids can ever be
    candidates. Cells start at the smallest coordinates of the keyframe and the top level is one
    cell around all of it, so there is no border that splits a keyframe for good.

    A position searches at the finest level whose own cell holds k + 1 candidates: the (k+1)-th
    distance is then at most the cell diagonal, sqrt(2) cells, and the surrounding 5 x 5 cells
    reach at least 2 cells far, so nothing nearer is missed. Positions that search at a level have
    fewer than k + 1 candidates in their next finer cell, hence at most 4k of them per cell, and
    each cell is read by 25 cells: a level costs at most 100 * k rows per candidate, linear in the
    size of the keyframe however dense a cluster is. Keyframes of ``one_level`` tracks or fewer have
    the top level only, which is the same search with one cell.
    """
    frame = list(frame)
    extent = df.groupBy(*frame).agg(
        F.count(F.lit(1)).alias("_n"), F.min("cx").alias("_ox"), F.min("cy").alias("_oy"),
        F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("_span"),
    )
    finest = F.lit(FINEST_LEVEL)
    # two above the logarithm rounded down: the whole keyframe fits, whatever the rounding
    top = F.greatest(F.coalesce(F.floor(F.log2("_span")).cast("int") + 2, finest), finest)
    extent = extent.withColumn("_top", top).withColumn(
        "_low", F.when(F.col("_n") <= one_level, F.col("_top")).otherwise(finest)
    )

    def in_cells(rows: DataFrame, *kept: str) -> DataFrame:
        def cell(level: Column) -> Column:
            edge = F.pow(F.lit(2.0), level)
            return F.struct(
                level.alias("lv"),
                F.floor((F.col("cx") - F.col("_ox")) / edge).alias("gx"),
                F.floor((F.col("cy") - F.col("_oy")) / edge).alias("gy"),
            )

        placed = rows.join(extent, frame)
        placed = placed.withColumn("_c", F.explode(F.transform(F.sequence("_low", "_top"), cell)))
        return placed.select(*frame, *kept, "_top", "_c.lv", "_c.gx", "_c.gy")

    point = F.struct(*[F.col(c) for c in _POINT])
    same_place = Window.partitionBy(*frame, "cx", "cy").orderBy("track_id")
    cand = (
        df.select(*frame, *_POINT)
        .withColumn("_rn", F.row_number().over(same_place))
        .filter(F.col("_rn") <= k + 1)
        .select(*frame, "cx", "cy", point.alias("_o"))
    )
    leveled = in_cells(cand, "_o").drop("_top")
    full = (
        leveled.groupBy(*frame, "lv", "gx", "gy")
        .agg(F.count(F.lit(1)).alias("_held"))
        .filter(F.col("_held") >= k + 1)
    )
    at = (
        in_cells(spots.select(*frame, "cx", "cy").distinct(), "cx", "cy")
        .join(full, [*frame, "lv", "gx", "gy"], "left")
        .filter(F.col("_held").isNotNull() | (F.col("lv") == F.col("_top")))
        .groupBy(*frame, "cx", "cy")
        .agg(F.min(F.struct("lv", "gx", "gy")).alias("_c"), F.first("_top").alias("_top"))
    )
    # the top level is a single cell
    steps = F.when(F.col("_c.lv") == F.col("_top"), F.array(F.lit(0))).otherwise(
        F.array(*[F.lit(i) for i in range(-2, 3)])
    )
    around = (
        at.withColumn("_i", F.explode(steps))
        .withColumn("_j", F.explode(steps))
        .select(
            *frame, F.col("cx").alias("_qx"), F.col("cy").alias("_qy"), "_c.lv",
            (F.col("_c.gx") + F.col("_i")).alias("gx"), (F.col("_c.gy") + F.col("_j")).alias("gy"),
        )
    )
    dx, dy = F.col("_o.cx") - F.col("_qx"), F.col("_o.cy") - F.col("_qy")
    near = around.join(leveled, [*frame, "lv", "gx", "gy"]).select(
        *frame, "_qx", "_qy",
        F.struct((dx * dx + dy * dy).alias("d2"), *[F.col(f"_o.{c}").alias(c) for c in _POINT])
        .alias("_p"),
    )
    nearest = Window.partitionBy(*frame, "_qx", "_qy").orderBy("_p.d2", "_p.track_id")
    return (
        near.withColumn("_rn", F.row_number().over(nearest))
        .filter(F.col("_rn") <= k + 1)
        .groupBy(*frame, "_qx", "_qy")
        .agg(F.array_sort(F.collect_list("_p")).alias("_l"))
        .withColumnsRenamed({"_qx": "cx", "_qy": "cy"})
    )


#: Tracks that a tile of a large keyframe has on average, and how many its densest neighbour may have.
PER_TILE, TILE_LIMIT = 256, 2048
#: How far a tile looks beyond itself, in edges, inside a keyframe and at its border: 25 tracks on average either way.
REACH, BORDER_REACH = 0.18, 0.36
#: Distances held at once by a task.
_PAIRS = 1_000_000


def _tile_search(k: int, own_columns: Sequence[str], out: StructType) -> Callable[[pa.Table], pa.Table]:
    """Neighbours of a tile's own tracks among all it was given; none for a track without k in reach."""
    target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def work(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].to_numpy(zero_copy_only=False)
        x, y, reach = column("cx"), column("cy"), float(table["_reach"][0].as_py()) ** 2
        ids = np.unique(column("track_id"), return_inverse=True)[1]
        mine = np.flatnonzero(column("_own").astype(bool))
        sizes, others, far = np.zeros(len(mine), np.int32), [], []
        step = max(1, _PAIRS // len(x))
        for at in range(0, len(mine) if len(x) > k else 0, step):
            me = mine[at : at + step, None]
            dx, dy = x - x[me], y - y[me]
            d2 = dx * dx + dy * dy
            d2[ids == ids[me]] = np.inf
            last = np.partition(d2, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero((d2 <= last[:, None]) & (last <= reach)[:, None])
            order = np.lexsort((ids[col], d2[row, col], row))
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[rank < k], col[rank < k]
            sizes[at : at + step] = np.bincount(row, minlength=len(me))
            others.append(col)
            far.append(d2[row, col])
        col = np.concatenate(others) if others else np.zeros(0, np.int64)
        d2 = np.concatenate(far) if far else np.zeros(0)
        near = [pa.array(d2)] + [table[c].combine_chunks().take(pa.array(col)) for c in _POINT]
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        items = pa.StructArray.from_arrays(near, ["d2", *_POINT])
        own = table.select(list(own_columns)).take(pa.array(mine))
        return own.append_column("_nb", pa.ListArray.from_arrays(offsets, items)).cast(target)

    return work


def _has_place() -> Column:
    bound = float(2 ** 52)
    return F.col("cx").between(-bound, bound) & F.col("cy").between(-bound, bound)


def keyframe_extents(tracks: DataFrame, *, frame: Sequence[str] = KEYFRAME) -> DataFrame:
    """Per keyframe the number of its tracks, of those that have a place, and the extent of these."""
    x, y = F.when(_has_place(), F.col("cx")), F.when(_has_place(), F.col("cy"))
    return tracks.groupBy(*frame).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(_has_place()).alias("_held"), F.min(x).alias("_ox"), F.min(y).alias("_oy"),
        (F.max(x) - F.min(x)).alias("_sx"), (F.max(y) - F.min(y)).alias("_sy"),
    )


def _in_tiles(
    df: DataFrame, frame: Sequence[str], rest: Sequence[str], k: int, size: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Tracks of large keyframes with their features, and the tracks this leaves open.

    ``df`` may bring its keyframes' extents (``keyframe_extents``).

    A keyframe is cut into tiles by its extent and number of tracks, and each tile gets the tracks
    within ``REACH`` around it as well (more at the keyframe's border, where half of the surroundings
    are empty). A track with k others in that distance has its nearest among them. The others are
    left open, and so are those beside a tile of over ``TILE_LIMIT`` tracks, so no tile is given
    more than nine times that. A track is copied about twice, three times at the border.

    Both results read the search, so its features are kept on disk (not the lists, which are several
    times as large); nothing runs before a result is asked for.
    """
    frame = list(frame)
    if "_held" not in df.columns:
        df = df.join(keyframe_extents(df, frame=frame).drop("_n"), frame)
    share = F.lit(float(PER_TILE)) / F.col("_held")
    edge = F.greatest(F.sqrt(F.col("_sx") * F.col("_sy") * share), F.greatest("_sx", "_sy") * share)
    placed = df.withColumn("_e", edge)
    for a in "xy":
        number = F.when(F.col("_e") > 0, F.greatest(F.floor(F.col(f"_s{a}") / F.col("_e")), F.lit(1))).otherwise(1)
        placed = placed.withColumn(f"_n{a}", number.cast("bigint")).withColumn(f"_w{a}", F.col(f"_s{a}") / F.col(f"_n{a}"))
    placed = placed.drop("_held", "_sx", "_sy")

    def tile(a: str, off: Column | float = 0.0) -> Column:
        place = F.floor((F.col(f"_u{a}") + off) / F.col(f"_w{a}")).cast("bigint")
        return F.when(F.col(f"_w{a}") > 0, F.least(F.greatest(place, F.lit(0)), F.col(f"_n{a}") - 1)).otherwise(F.lit(0)).cast("bigint")

    tiles = [*frame, "_tx", "_ty"]
    placed = placed.withColumns({"_ux": F.col("cx") - F.col("_ox"), "_uy": F.col("cy") - F.col("_oy")})
    placed = placed.withColumns({"_hx": tile("x"), "_hy": tile("y")})
    own_tile = [*frame, F.col("_hx").alias("_tx"), F.col("_hy").alias("_ty")]
    beside = F.sequence(F.lit(-1), F.lit(1))
    full = placed.groupBy(*own_tile).agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") > TILE_LIMIT)
    full = full.withColumn("_i", F.explode(beside)).withColumn("_j", F.explode(beside)).select(
        *frame, (F.col("_tx") + F.col("_i")).alias("_tx"), (F.col("_ty") + F.col("_j")).alias("_ty")
    ).distinct()

    e, half = F.col("_e") * BORDER_REACH, F.col("_e") * REACH
    border = F.lit(False)
    close = F.lit(True)
    for a in "xy":
        t, u, w = F.col(f"_t{a}"), F.col(f"_u{a}"), F.col(f"_w{a}")
        border = border | (t == 0) | (t == F.col(f"_n{a}") - 1)
        close = close & (u >= t * w - half) & (u <= (t + 1) * w + half)
    own = (F.col("_tx") == F.col("_hx")) & (F.col("_ty") == F.col("_hy"))
    copies = (
        placed.withColumn("_tx", F.explode(F.sequence(tile("x", -e), tile("x", e))))
        .withColumn("_ty", F.explode(F.sequence(tile("y", -e), tile("y", e))))
        .filter(border | close | own)
        .join(full, tiles, "left_anti")
        .select(
            *tiles, *_POINT, *[F.when(own, F.col(c)).alias(c) for c in rest], own.alias("_own"),
            # a little less than what is copied, for rounding
            (F.when(border, e).otherwise(half) * 0.98).alias("_reach"),
        )
    )
    near = StructType([StructField("d2", DoubleType()), *[df.schema[c] for c in _POINT]])
    out = StructType([*[df.schema[c] for c in (*frame, *_POINT, *rest)], StructField("_nb", ArrayType(near))])
    out = StructType([StructField(f.name, f.dataType) for f in out])
    found = copies.groupBy(*tiles).applyInArrow(_tile_search(k, [*frame, *_POINT, *rest], out), out)
    features = [e.alias(n) for n, e in _relative(found, "_nb", size).items()]
    own_columns = [*frame, *_POINT, *rest]
    found = found.select(*own_columns, (F.size("_nb") >= k).alias("_enough"), *features).persist(StorageLevel.DISK_ONLY)
    crowded = placed.select(*own_tile, *_POINT, *rest).join(full, tiles, "left_semi").drop("_tx", "_ty")
    return found.filter("_enough").drop("_enough"), found.filter("not _enough").select(*own_columns).unionByName(crowded)


def _small_keyframes(sized: DataFrame, frame: Sequence[str], rest: Sequence[str], k: int) -> DataFrame:
    """Tracks of keyframes of few tracks, each with its neighbours ``_nb``.

    The tracks of a keyframe are gathered into one list, which the caller bounds, and every track
    sorts that list by distance: one shuffle, nothing is joined.
    """
    own = [*_POINT, *rest, "_known"]
    gathered = sized.groupBy(*frame).agg(F.collect_list(F.struct(*own)).alias("_all"))
    points = F.transform(F.filter("_all", lambda o: o["_known"]), lambda o: F.struct(*[o[c].alias(c) for c in _POINT]))
    each = gathered.withColumn("_near", points).select(*frame, "_near", F.explode("_all").alias("_me"))
    me = F.col("_me")

    def with_distance(o: Column) -> Column:
        dx, dy = o["cx"] - me["cx"], o["cy"] - me["cy"]
        return F.struct((dx * dx + dy * dy).alias("d2"), *[o[c].alias(c) for c in _POINT])

    others = F.filter("_near", lambda o: o["track_id"] != me["track_id"])
    nearest = F.slice(F.array_sort(F.transform(others, with_distance)), 1, k)
    none = F.slice(F.transform("_near", with_distance), 1, 0)
    return each.select(
        *frame, *[me[c].alias(c) for c in (*_POINT, *rest)],
        F.when(F.coalesce(me["_known"], F.lit(False)), nearest).otherwise(none).alias("_nb"),
    )


def knn_features(
    tracks: DataFrame,
    *,
    k: int = C.KNN_K,
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    frame: Sequence[str] = KEYFRAME,
    one_level: int = 128,
    extents: DataFrame | None = None,
) -> DataFrame:
    """Nine motion features per track from its min(k, N - 1) nearest tracks of the same keyframe.

    Distance ties go to the smaller track id. Keyframes of up to ``one_level`` tracks compare all
    their tracks, larger ones search in tiles, and where a tile does not settle a track (bunched or
    lonely ones) in a pyramid of cells; the rows are the same for every value. A track whose position is null, NaN or beyond 2^52 has no neighbours
    and is nobody's: its offsets and distance are 0, its own motion stays.

    ``extents`` is ``keyframe_extents(tracks)``, read by every branch; a caller who has it at its true
    size (``session.sized``) spares the tracks a shuffle in each.
    """
    frame = list(frame)
    rest = [c for c in tracks.columns if c not in frame and c not in _POINT]
    extents = keyframe_extents(tracks, frame=frame) if extents is None else extents
    sized = tracks.withColumn("_known", _has_place()).join(extents, frame)
    small = _small_keyframes(sized.filter(F.col("_n") <= one_level), frame, rest, k)
    large = sized.filter(F.col("_n") > one_level)
    known = large.filter("_known").drop("_known", "_n")
    size = float(max(width, height))
    done, left = _in_tiles(known, frame, rest, k, size)
    known = known.select(*frame, *_POINT, *rest)
    # few rows as a rule, read by every step of the pyramid; nothing runs before the result is asked for
    left = left.persist(StorageLevel.DISK_ONLY)
    lists = _neighbour_lists(known.join(left.select(*frame).distinct(), frame, "left_semi"), left, frame, k, one_level)
    unknown = large.filter(~F.coalesce("_known", F.lit(False))).select(*frame, *_POINT, *rest)
    met = left.unionByName(unknown).join(lists, [*frame, "cx", "cy"], "left")
    me = F.col("track_id")
    mine = F.slice(F.filter("_l", lambda o: o["track_id"] != me), 1, k)
    none = F.array().cast(lists.schema["_l"].dataType)
    met = met.select(*frame, *_POINT, *rest, F.coalesce(mine, none).alias("_nb"))
    out = small.unionByName(met)
    return out.withColumns(_relative(out, "_nb", size)).drop("_nb").unionByName(done)


def bridge_gaps(
    features: DataFrame,
    keyframes: DataFrame,
    *,
    max_age: int = C.INTERP_MAX_AGE,
    keys: Sequence[str] = TRACK,
    seq: str = "kf_seq",
    keyframe_keys: Sequence[str] = KEYFRAME,
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Repeat the last feature row over short absences, also after the last sighting.

    A row covers the keyframes up to the next sighting, at most ``max_age`` of them. The join with
    the keyframes drops numbers the flight never reached and supplies their frame ids and times.
    """
    df = O.with_halo(features, seq, size=block, ahead=max_age + 1)
    nxt = F.lead(seq).over(O.block_window(keys, [seq]))
    df = O.own_rows(df.withColumn("_next", nxt))
    until = F.least(
        F.coalesce(F.col("_next") - 1, F.col(seq) + max_age), F.col(seq) + max_age
    )
    df = df.withColumn("_at", F.explode(F.sequence(F.col(seq), until)))
    df = df.withColumn("is_visible", F.col("_at") == F.col(seq))
    df = df.drop(seq, "_next").withColumnRenamed("_at", seq)
    meta = [c for c in ("frame_id", "ts_us") if c in keyframes.columns]
    return df.drop(*meta).join(
        keyframes.select(*keyframe_keys, *meta), list(keyframe_keys), "inner"
    )


def present_tracks(
    tracks: DataFrame, at: DataFrame, *, on: Sequence[str] = ("flight_id", "kf_seq", "track_id")
) -> DataFrame:
    """Tracks that also occur in ``at``."""
    return tracks.join(at.select(*on), list(on), "left_semi")


def absent_tracks(
    tracks: DataFrame, at: DataFrame, *, on: Sequence[str] = ("flight_id", "kf_seq", "track_id")
) -> DataFrame:
    """Tracks that do not occur in ``at``; their state would be closed."""
    return tracks.join(at.select(*on), list(on), "left_anti")


def interpolate_tracks(
    frames: DataFrame,
    tracks: DataFrame,
    *,
    keys: Sequence[str] = ("flight_id",),
    boxes: Sequence[str] = ("x1", "y1", "x2", "y2"),
    copied: Sequence[str] = ("confidence", "class_id"),
    flush_tail: bool = False,
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Boxes on the frames between two keyframes, for tracks present in both.

    ``frames`` carries ``is_keyframe``; ``tracks`` has rows on keyframes only. Passthrough frame i
    of n lies at alpha = i / (n + 1); ``copied`` columns keep the earlier keyframe's values. Frames
    before the first keyframe drop out, and so do those after the last one unless ``flush_tail``
    (then with the earlier keyframe's boxes). A frame without common tracks stays, with a null
    track.
    """
    keys = list(keys)
    numbered = O.running_sum(
        O.seq_blocks(frames, "frame_id", size=block),
        keys,
        ["frame_id"],
        {"_idx": F.lit(1), "_kf": F.col("is_keyframe").cast("int")},
    ).drop(O.BLK)
    k0 = numbered.filter("is_keyframe").select(
        *keys, "_kf", F.col("frame_id").alias("_f0"), F.col("_idx").alias("_i0")
    )
    k1 = k0.select(
        *keys, (F.col("_kf") - 1).alias("_kf"), F.col("_f0").alias("_f1"), F.col("_i0").alias("_i1")
    )
    pairs = k0.join(k1, [*keys, "_kf"], "left" if flush_tail else "inner")

    t0 = tracks.select(*keys, F.col("frame_id").alias("_f0"), "track_id", *boxes, *copied)
    t1 = tracks.select(
        *keys, F.col("frame_id").alias("_f1"), "track_id", *[F.col(b).alias(f"_n_{b}") for b in boxes]
    )
    common = pairs.select(*keys, "_kf", "_f0", "_f1").join(t0, [*keys, "_f0"])
    common = common.join(t1, [*keys, "_f1", "track_id"], "left" if flush_tail else "inner")
    if flush_tail:
        common = common.filter(F.col("_f1").isNull() | F.col(f"_n_{boxes[0]}").isNotNull())
    common = common.drop("_f0", "_f1")

    gaps = numbered.filter(~F.col("is_keyframe") & (F.col("_kf") >= 1)).drop("is_keyframe", "kf_seq")
    gaps = gaps.join(pairs.select(*keys, "_kf", "_i0", "_i1"), [*keys, "_kf"])
    alpha = (F.col("_idx") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    out = gaps.withColumn("alpha", alpha).drop("_idx", "_i0", "_i1")
    out = out.join(common, [*keys, "_kf"], "left")
    a = F.coalesce(F.col("alpha"), F.lit(0.0))
    mixed = {
        b: (1 - a) * F.col(b) + F.when(a == 0, F.lit(0.0)).otherwise(a * F.col(f"_n_{b}"))
        for b in boxes
    }
    return out.withColumns(mixed).drop("_kf", *[f"_n_{b}" for b in boxes])
