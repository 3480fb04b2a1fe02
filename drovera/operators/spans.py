"""Binary image masks as row spans (layer, y, x0..x1 inclusive) and their algebra.

All set operations run as one sweep: every span contributes an opening and a closing event, a
running sum along the image row tells which masks cover a position, and output runs start and end
where the predicate flips. There is no overlap join, so nothing is paired; a task holds the events
of one image row, which the frame width bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..session import spread
from . import runs

FRAME = ("flight_id", "frame_id")
#: Image rows dealt together; a long has a bit for each.
BAND = 64
#: Rows of circles and spans that are drawn together.
SLICE = 2_500
WindowCols = Mapping[str, Column]


def box_geometry(
    raw: DataFrame, *, keys: Sequence[str] = (*FRAME, "det_id"), xywh: str = "xywh", xyxy: str = "xyxy"
) -> DataFrame:
    """Truncated integer centre (from xywh) and corners (from xyxy) of each detection."""
    part = {"cx": (xywh, 0), "cy": (xywh, 1), "x1": (xyxy, 0), "y1": (xyxy, 1),
            "x2": (xyxy, 2), "y2": (xyxy, 3)}
    return raw.select(
        *keys,
        F.col("class_id").cast("int").alias("class_id"),
        *[F.get(col, F.lit(i)).cast("int").alias(name) for name, (col, i) in part.items()],
    )


def _circles(
    boxes: DataFrame, width: int, height: int, keys: Sequence[str], cx: str, cy: str, radius: str
) -> DataFrame:
    """Distinct circles that reach into the frame, as _x, _y, _r."""
    r, x, y = F.col("_r"), F.col("_x"), F.col("_y")
    return (
        boxes.select(*keys, F.col(cx).alias("_x"), F.col(cy).alias("_y"), F.col(radius).alias("_r"))
        .filter(r > 0)
        .filter((y + r >= 0) & (y - r < height) & (x + r >= 0) & (x - r < width))
        .distinct()
    )


def safety_spans(
    boxes: DataFrame,
    *,
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    keys: Sequence[str] = FRAME,
    cx: str = "cx",
    cy: str = "cy",
    radius: str = "safety_radius_px",
    layer: str = "safety",
    dealt: bool = False,
) -> DataFrame:
    """Filled circles clipped to the frame; a radius of zero or less draws nothing.

    Row dy of a circle reaches floor(sqrt(r^2 - dy^2)) pixels to each side, which is where the
    integer midpoint circle ends too. Equal circles are dropped first: what remains per frame is
    bounded by its pixel count even if one frame holds most of the boxes.

    With ``dealt`` circles are shuffled by frame and band of rows before they are drawn, and the
    spans keep their ``_band``: ``span_intersect``, ``mask_difference`` and ``danger_flags`` then leave out
    the spans of rows where the other mask has none before these are shuffled and sorted.
    """
    r, x, y = F.col("_r"), F.col("_x"), F.col("_y")
    circles = _circles(boxes, width, height, keys, cx, cy, radius)
    top, bottom = F.greatest(y - r, F.lit(0)), F.least(y + r, F.lit(height - 1))
    band = []
    if dealt:
        bands = F.sequence(F.floor(top / BAND), F.floor(bottom / BAND))
        lines = spread(circles.withColumn("_band", F.explode(bands)), *keys, "_band")
        band = ["_band"]
        top = F.greatest(top, (F.col("_band") * BAND).cast("int"))
        bottom = F.least(bottom, (F.col("_band") * BAND + (BAND - 1)).cast("int"))
    else:
        lines = spread(circles, *keys, "_x", "_y")
    lines = lines.withColumn("y", F.explode(F.sequence(top, bottom)))
    dy = F.col("y") - y
    half = F.floor(F.sqrt((r * r - dy * dy).cast("double"))).cast("int")
    return (
        lines.withColumn("_h", half)
        .select(
            *keys, *band,
            F.lit(layer).alias("layer"),
            F.col("y").cast("int").alias("y"),
            F.greatest(x - F.col("_h"), F.lit(0)).cast("int").alias("x0"),
            F.least(x + F.col("_h"), F.lit(width - 1)).cast("int").alias("x1"),
        )
        .filter(F.col("x0") <= F.col("x1"))
    )


def _events(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]], keys: Sequence[str]) -> DataFrame:
    """Opening and closing events of spans; the deltas are 1 for every mask a span belongs to.

    Spans are shuffled by image row and only then doubled into events.
    """
    stacked = None
    for df, deltas in parts:
        s = df.select(*keys, "y", "x0", "x1", *[e.alias(n) for n, e in deltas.items()])
        stacked = s if stacked is None else stacked.unionByName(s)
    names = list(parts[0][1])
    ends = F.array(
        F.struct(F.col("x0").alias("x"), F.lit(1).alias("s")),
        F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("s")),
    )
    rows = stacked.repartition(*keys, "y")
    return rows.select(*keys, "y", *names, F.explode(ends).alias("_e")).select(
        *keys, "y", F.col("_e.x").alias("x"), *[(F.col(n) * F.col("_e.s")).alias(n) for n in names]
    )


def _selective_first(row: Sequence[str]) -> list[str]:
    """The columns with the flight last: a sort compares the first column's bytes alone where they differ, and flights are few."""
    return sorted(row, key=lambda c: c == FRAME[0])


def _flips(events: DataFrame, keys: Sequence[str], flag: Callable[[WindowCols], Column],
           names: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*_selective_first([*keys, "y"])).orderBy("x")
    on = flag({n: F.sum(n).over(w) > 0 for n in names})
    runs = events.withColumn("_on", on)
    runs = runs.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False)))
    runs = runs.filter(F.col("_on") != F.col("_was"))
    runs = runs.withColumn("_next", F.lead("x").over(w))
    return runs.filter("_on").select(
        *keys, "y", F.col("x").cast("int").alias("x0"), (F.col("_next") - 1).cast("int").alias("x1")
    )


def _combine(a: DataFrame, b: DataFrame, keys: Sequence[str],
             flag: Callable[[WindowCols], Column]) -> DataFrame:
    in_a = {"_a": F.lit(1), "_b": F.lit(0)}
    in_b = {"_a": F.lit(0), "_b": F.lit(1)}
    return _flips(_events([(a, in_a), (b, in_b)], keys), keys, flag, ("_a", "_b"))


def _met(spans: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans dealt by band, with ``_met``: whether ``other`` has spans in their image row.

    What ``other`` has is one long per frame and band with a bit per row, dealt in the same way. Rows
    without a key meet each other in the sweep but not in a join, so they all count as met.
    """
    at = F.expr(f"cast(pmod(y, {BAND}) as int)")
    rows = spread(other.select(*keys, F.floor(F.col("y") / BAND).alias("_band"), at.alias("_at")), *keys, "_band")
    held = rows.groupBy(*keys, "_band").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("_rows"))
    # the drawn spans are many and need not be sorted for this
    met = spans.join(held.hint("shuffle_hash"), [*keys, "_band"], "left")
    nameless = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    bit = F.expr(f"shiftrightunsigned(_rows, cast(pmod(y, {BAND}) as int)) & 1L = 1L")
    return met.withColumn("_met", nameless | F.coalesce(bit, F.lit(False))).drop("_rows")


def _where_met(spans: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``spans``, if dealt by band, without those of image rows where ``other`` has none (``_met``); else as given."""
    if "_band" not in spans.columns:
        return spans
    return _met(spans, other, keys).filter("_met").drop("_met", "_band")


def span_intersect(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = FRAME) -> DataFrame:
    """Logical AND of two masks."""
    a, b = _where_met(a, b, keys), _where_met(b, a, keys)
    return _combine(a, b, keys, lambda m: m["_a"] & m["_b"])


def mask_difference(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pixels of ``a`` that are not in ``b``."""
    b = _where_met(b, a, keys)
    return _combine(a, b, keys, lambda m: m["_a"] & ~m["_b"])


def mask_union(spans: DataFrame, *, keys: Sequence[str] = FRAME) -> DataFrame:
    """Logical OR of all spans of a key, as maximal runs. Add ``layer`` to the keys to keep layers
    apart."""
    return _flips(_events([(spans, {"_a": F.lit(1)})], keys), keys, lambda m: m["_a"], ("_a",))


def mask_complement(
    spans: DataFrame, rows: DataFrame, *, width: int, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Pixels of the listed image rows outside the mask."""
    full = rows.select(*keys, "y", F.lit(0).alias("x0"), F.lit(width - 1).alias("x1"))
    return mask_difference(full, spans, keys=keys)


def mask_area(spans: DataFrame, *, keys: Sequence[str] = (*FRAME, "layer")) -> DataFrame:
    """Pixels per mask; the spans must be disjoint (see ``mask_union``)."""
    return spans.groupBy(*keys).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area_px")
    )


def label_rows_to_spans(
    rows: DataFrame, *, keys: Sequence[str] = FRAME, labels: str = "labels"
) -> DataFrame:
    """Run-length encoding of label rows (one array of class ids per image row)."""
    n = F.size(labels)
    breaks = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(labels, i) != F.get(labels, i - 1)),
    )
    ends = F.concat(F.transform(F.slice("_b", 2, F.size("_b")), lambda i: i - 1), F.array(n - 1))
    runs = F.zip_with(
        "_b", ends, lambda s, e: F.struct(s.alias("x0"), e.alias("x1"), F.get(labels, s).alias("c"))
    )
    return (
        rows.filter(n > 0)
        .withColumn("_b", breaks)
        .select(*keys, "y", F.explode(runs).alias("_r"))
        .select(*keys, F.col("_r.c").alias("class_id"), "y", "_r.x0", "_r.x1")
    )


def segmentation_layers(
    label_spans: DataFrame,
    *,
    suppress: Collection[int] = (),
    layers: Mapping[int, str] = C.SEGMENT_LAYERS,
    keys: Sequence[str] = FRAME,
) -> DataFrame:
    """Class spans to hazard layers; suppressed classes count as background."""
    kept = {k: v for k, v in layers.items() if k not in set(suppress)}
    pairs = [F.lit(x) for kv in kept.items() for x in kv]
    if not kept:
        return label_spans.filter(F.lit(False)).select(
            *keys, F.lit("").alias("layer"), "y", "x0", "x1"
        )
    name = F.element_at(F.create_map(*pairs), F.col("class_id"))
    return label_spans.filter(F.col("class_id").isin(*kept)).select(
        *keys, name.alias("layer"), "y", "x0", "x1"
    )


def _where_layered(safety: DataFrame, layers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``safety``, if dealt by band, as it meets ``layers``: of the rows without layers one pixel for each frame and band.

    Those rows count in nothing, but a frame that has only such rows is still a frame. Added up where the join
    has put them, so nothing is shuffled for it.
    """
    if "_band" not in safety.columns:
        return safety
    met = _met(safety, layers, keys)
    here = {c: F.when(F.col("_met"), F.col(c)).alias(f"_m_{c}") for c in ("y", "x0", "x1")}
    # a smallest row without layers stands for them all
    kept = met.select(*keys, "_band", *here.values(), F.col("y")).groupBy(*keys, "_band", *[f"_m_{c}" for c in here]).agg(F.min("y").alias("_y"))
    zero = F.lit(0)
    return kept.select(*keys, F.col("_y").alias("y"), *[F.coalesce(f"_m_{c}", zero).alias(c) for c in ("x0", "x1")])


def danger_flags(
    safety: DataFrame,
    layers: DataFrame,
    *,
    keys: Sequence[str] = FRAME,
    names: Sequence[str] = tuple(n for n, _ in C.DANGER_LABELS),
) -> DataFrame:
    """Which layers touch a safety circle, and how large the masks are, per frame.

    One sweep carries the safety mask and all layers together. ``intersection_px`` counts danger
    inside safety circles, ``danger_px`` the danger outside them. Of drawn circles that are dealt by band
    (``safety_spans``) only the rows that have layers are shuffled to the sweep.
    """
    cols = {"_safe": F.lit(0), **{f"_l_{n}": (F.col("layer") == n).cast("int") for n in names}}
    only = {"_safe": F.lit(1), **{f"_l_{n}": F.lit(0) for n in names}}
    named = layers.filter(F.col("layer").isin(*names))
    ev = _events([(named, cols), (_where_layered(safety, named, keys), only)], keys)
    return _flag_sweep(ev, keys, names, [*keys, "y"])


def _segments(events: DataFrame, names: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Stretches of a row between events, with what covers them: ``row x _len _safe _l_...``."""
    cols = ["_safe", *[f"_l_{n}" for n in names]]
    w = Window.partitionBy(*_selective_first(row)).orderBy("x")
    # of several events at one position only the last has a length, and it has seen them all
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select(
        *row, "x",
        (F.lead("x").over(w) - F.col("x")).alias("_len"),
        *[(F.sum(c).over(so_far) > 0).alias(c) for c in cols],
    ).filter(F.col("_len") > 0)


def _flag_sweep(
    events: DataFrame, keys: Sequence[str], names: Sequence[str], row: Sequence[str],
    partial: Collection[str] = (),
) -> DataFrame:
    seg = _segments(events, names, row)
    whole, part = F.lit(False), F.lit(False)
    for n in names:
        if n in partial:
            part = part | F.col(f"_l_{n}")
        else:
            whole = whole | F.col(f"_l_{n}")
    danger, safe = whole | part, F.col("_safe")
    return seg.groupBy(*keys).agg(
        *[F.max(F.col("_safe") & F.col(f"_l_{n}")).alias(n) for n in names],
        F.sum(F.when(danger & F.col("_safe"), F.col("_len")).otherwise(0))
        .cast("bigint").alias("intersection_px"),
        F.sum(
            F.when(whole & ~part & ~safe, F.col("_len")).when(part & safe, -F.col("_len")).otherwise(0)
        ).cast("bigint").alias("danger_px"),
    )


def _dealt(
    boxes: DataFrame, layers: DataFrame, width: int, height: int, keys: Sequence[str], cx: str, cy: str,
    radius: str, names: Sequence[str], band: int,
) -> DataFrame:
    """Circles ``_x _y _r`` and layer spans ``y x0 x1`` by frame and band of rows, in as many rows as there are of them."""
    keys = list(keys)
    r, y = F.col("_r"), F.col("_y")
    top, bottom = F.greatest(y - r, F.lit(0)), F.least(y + r, F.lit(height - 1))
    per_band = F.sequence(F.floor(top / band), F.floor(bottom / band))
    layer_cols = [f"_l_{n}" for n in names]
    drawn = _circles(boxes, width, height, keys, cx, cy, radius).select(
        *keys, F.explode(per_band).alias("_band"), F.lit(1).alias("_safe"),
        *[F.lit(0).alias(c) for c in layer_cols], "_x", "_y", "_r",
        *[F.lit(None).cast("int").alias(c) for c in ("y", "x0", "x1")],
    )
    given = layers.filter(F.col("layer").isin(*names)).select(
        *keys, F.floor(F.col("y") / band).alias("_band"), F.lit(0).alias("_safe"),
        *[(F.col("layer") == n).cast("int").alias(c) for n, c in zip(names, layer_cols)],
        *[F.lit(None).cast("int").alias(c) for c in ("_x", "_y", "_r")], "y", "x0", "x1",
    )
    return spread(drawn.unionByName(given), *keys, "_band")


def _circle_events(
    boxes: DataFrame, layers: DataFrame, width: int, height: int, keys: Sequence[str], cx: str, cy: str,
    radius: str, names: Sequence[str], band: int,
) -> DataFrame:
    """Events of circles, drawn after the shuffle, and of layer spans, by frame and band of rows."""
    keys = list(keys)
    r, x, y = F.col("_r"), F.col("_x"), F.col("_y")
    top, bottom = F.greatest(y - r, F.lit(0)), F.least(y + r, F.lit(height - 1))
    layer_cols = [f"_l_{n}" for n in names]
    rows = _dealt(boxes, layers, width, height, keys, cx, cy, radius, names, band)
    first = F.greatest(top, F.col("_band") * band).cast("int")
    last = F.least(bottom, F.col("_band") * band + (band - 1)).cast("int")

    def line(at: Column) -> Column:
        half = F.floor(F.sqrt((r * r - (at - y) * (at - y)).cast("double"))).cast("int")
        return F.struct(
            at.alias("y"), F.greatest(x - half, F.lit(0)).cast("int").alias("x0"),
            F.least(x + half, F.lit(width - 1)).cast("int").alias("x1"),
        )

    span = F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")])
    drawn_lines = F.when(r.isNotNull(), F.transform(F.sequence(first, last), line))
    rows = rows.withColumn("_s", F.explode(F.coalesce(drawn_lines, F.array(span))))
    rows = rows.filter(F.col("_s.x0") <= F.col("_s.x1"))
    ends = F.array(
        F.struct(F.col("_s.x0").alias("x"), F.lit(1).alias("s")),
        F.struct((F.col("_s.x1") + 1).alias("x"), F.lit(-1).alias("s")),
    )
    cols = ["_safe", *layer_cols]
    return rows.select(
        *keys, "_band", F.col("_s.y").alias("y"), *cols, F.explode(ends).alias("_e")
    ).select(
        *keys, "_band", "y", F.col("_e.x").alias("x"), *[(F.col(c) * F.col("_e.s")).alias(c) for c in cols]
    )


def circle_danger_flags(
    boxes: DataFrame,
    layers: DataFrame,
    *,
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    keys: Sequence[str] = FRAME,
    cx: str = "cx",
    cy: str = "cy",
    radius: str = "safety_radius_px",
    names: Sequence[str] = tuple(n for n, _ in C.DANGER_LABELS),
    partial: Collection[str] = (),
    band: int = 64,
) -> DataFrame:
    """``danger_flags`` straight from boxes: circles are shuffled whole and drawn afterwards.

    A frame is cut into bands of ``band`` image rows. A circle goes to the bands it touches (two,
    mostly) instead of travelling as one span per image row, and one crowded frame still spreads
    over several tasks.

    Layers named in ``partial`` need spans only under circles and under the other layers. Their
    area enters ``danger_px`` as what it adds to the area of their union over the whole frame,
    which the caller adds (and which may be negative before that).
    """
    events = _circle_events(boxes, layers, width, height, keys, cx, cy, radius, names, band)
    return _flag_sweep(events, list(keys), names, [*keys, "_band", "y"], partial)


def circle_segments(
    boxes: DataFrame,
    layers: DataFrame,
    *,
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    keys: Sequence[str] = FRAME,
    cx: str = "cx",
    cy: str = "cy",
    radius: str = "safety_radius_px",
    names: Sequence[str] = tuple(C.SEGMENT_LAYERS.values()),
    band: int = 64,
    beside: DataFrame | None = None,
) -> DataFrame:
    """What circles and layers cover, parted into disjoint runs, one row per frame and band: ``keys _band segments``.

    ``segments`` holds ``runs.SPAN`` records whose bits are ``safe`` and then a bit per layer; ``segment_rows``
    lists them. Circles and spans are dealt whole by frame and band of ``band`` image rows, as
    ``frame_bands`` deals frames; a task sorts them, draws some thousand at a time and sweeps them as arrays.
    ``beside`` has at most one row per frame and band, whose columns come along (null where it has none).
    """
    keys = list(keys)
    rows = _dealt(boxes, layers, width, height, keys, cx, cy, radius, names, band)
    by = [*keys, "_band"]
    extra = [] if beside is None else [c for c in beside.columns if c not in by]
    if beside is not None:
        rows = rows.join(spread(beside, *by), by, "left")
    rows = rows.sortWithinPartitions(*_selective_first(by))
    on = reduce(Column.__add__, [F.col(c) * (1 << k) for k, c in enumerate(["_safe", *[f"_l_{n}" for n in names]])])
    rows = rows.select(*by, *extra, on.cast("int").alias("_on"), "_x", "_y", "_r", "y", "x0", "x1")
    out = rows.select(*by, *extra, F.lit(None).cast("binary").alias("segments")).schema
    masks, head = 1 + len(names), [*by, *extra]

    def laid(batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans ``(group, y, x0, x1, on)`` of a batch, circles drawn; a span in no image row is in row 0 of its own band."""
        given = lambda n: batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        round_ = batch.column("_r").is_valid().to_numpy(zero_copy_only=False)
        on, b = given("_on"), given("_band") * band
        c = np.nonzero(round_)[0]
        x, y, r = (given(n)[c] for n in ("_x", "_y", "_r"))
        top, bottom = np.maximum(np.maximum(y - r, 0), b[c]), np.minimum(np.minimum(y + r, height - 1), b[c] + band - 1)
        circle, at, x0, x1 = runs.drawn(x, y, r, top=top, bottom=bottom, width=width)
        whole = np.logical_and.reduce([batch.column(n).is_valid().to_numpy(zero_copy_only=False) for n in ("x0", "x1")])
        g = np.nonzero(~round_ & whole & (given("x0") <= given("x1")))[0]
        own = np.concatenate([c[circle], g])
        return (group[own], np.concatenate([at, given("y")[g]]), np.concatenate([x0, given("x0")[g]]),
                np.concatenate([x1, given("x1")[g]]), on[own])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, None  # the frame and band that may go on, and its spans so far, parted

        def shown(named: pa.RecordBatch, got: tuple[np.ndarray, ...], rows_of: np.ndarray) -> pa.RecordBatch:
            group, y, x0, x1, on = got
            record = np.empty(len(group), dtype=runs.SPAN)
            record["y"], record["x0"], record["x1"], record["on"] = y, x0, x1, on
            counts = np.bincount(group, minlength=len(rows_of))
            ends = np.cumsum(np.append(0, counts)).astype(np.int32) * runs.SPAN.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(record.tobytes())])
            at = pa.array(rows_of)
            return pa.RecordBatch.from_arrays([*[named.column(n).take(at) for n in head], data], [*head, "segments"])

        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                group = runs.groups_of(batch, by)
                spans = laid(batch, group)
                if first is not None:
                    row = lambda b, i: [b.column(n)[i].as_py() for n in by]
                    if row(first, 0) == row(batch, 0):
                        spans = tuple(np.concatenate([h, s]) for h, s in zip(held, spans))
                    else:
                        yield shown(first, held, np.zeros(1, dtype=np.int64))
                got = runs.parted(*spans, masks=masks)
                last = group[-1]
                done = got[0] < last
                if last:
                    heads = np.nonzero(np.append(True, group[1:] != group[:-1]))[0][:last]
                    yield shown(batch, tuple(v[done] for v in got), heads)
                first = batch.slice(batch.num_rows - 1)
                held = (np.zeros(np.count_nonzero(~done), dtype=np.int64), *[v[~done] for v in got[1:]])
        if first is not None:
            yield shown(first, held, np.zeros(1, dtype=np.int64))

    return rows.mapInArrow(work, out)


def segment_rows(packed: DataFrame, *, names: Sequence[str] = tuple(C.SEGMENT_LAYERS.values())) -> DataFrame:
    """The runs of ``circle_segments``, one row each: ``y x0 x1 safe`` and a flag per layer instead of ``segments``."""
    rest = [c for c in packed.columns if c != "segments"]
    flags = ["safe", *names]
    longs = [F.lit(None).cast("int").alias(n) for n in ("y", "x0", "x1")]
    out = packed.select(*rest, *longs, *[F.lit(None).cast("boolean").alias(n) for n in flags]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column("segments").to_pylist()
            at = pa.array(np.repeat(np.arange(len(kept)), [len(v) // runs.SPAN.itemsize for v in kept]))
            got = np.frombuffer(b"".join(kept), dtype=runs.SPAN)
            made = [pa.array(np.ascontiguousarray(got[n])) for n in ("y", "x0", "x1")]
            made += [pa.array((got["on"] >> k) & 1 == 1) for k in range(len(flags))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in rest], *made], out.names)

    return packed.mapInArrow(work, out)


def frame_bands(frames: DataFrame, *, height: int = C.PROCESSING_SHAPE[1], band: int = 64) -> DataFrame:
    """Each frame once per band of image rows."""
    return frames.withColumn("_band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((height - 1) // band).cast("bigint"))))


def danger_types(labels: Sequence[tuple[str, str]] = C.DANGER_LABELS) -> Column:
    """Labels of the raised flags in their fixed order."""
    return F.array_compact(
        F.array(*[F.when(F.col(n), F.lit(text)) for n, text in labels])
    )


def danger_message(
    flags: DataFrame, *, labels: Sequence[tuple[str, str]] = C.DANGER_LABELS, out: str = "alert_msg"
) -> DataFrame:
    return flags.withColumn(out, F.array_join(danger_types(labels), " & "))


def class_counts(
    frames: DataFrame,
    detections: DataFrame,
    *,
    classes: Mapping[int, str],
    keys: Sequence[str] = FRAME,
) -> DataFrame:
    """Detections per known class per frame, absent classes as 0, with the display line.

    Frames and detections are stacked and counted in one aggregation: frames without detections
    survive, and no frame-by-class product is joined.
    """
    stacked = frames.select(*keys, F.lit(None).cast("int").alias("class_id")).unionByName(
        detections.select(*keys, F.col("class_id").cast("int").alias("class_id"))
    )
    counts = stacked.groupBy(*keys).agg(
        *[F.count_if(F.col("class_id") == i).alias(f"_n{i}") for i in classes]
    )
    entry = F.array(
        *[
            F.struct(F.lit(i).alias("class_id"), F.lit(name).alias("name"), F.col(f"_n{i}").alias("n"))
            for i, name in classes.items()
        ]
    )
    out = counts.select(*keys, F.explode(entry).alias("_c")).select(
        *keys, "_c.class_id", "_c.name", F.col("_c.n").alias("n")
    )
    return out.withColumn("line", F.format_string("N. %s: %d", "name", "n"))
