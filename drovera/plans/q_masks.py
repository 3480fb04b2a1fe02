"""Detection and mask queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import spans
from . import views as V
from .registry import query


def safety(spark, d, dealt: bool = False) -> DataFrame:
    return spans.safety_spans(V.boxes(spark, d), width=V.MASK_W, height=V.MASK_H, dealt=dealt)


def _runs(px: str, keys: str) -> str:
    """Maximal runs of a table of pixels."""
    return f"""runs AS (
      SELECT {keys}, y, min(x) AS x0, max(x) AS x1 FROM (
        SELECT *, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS g FROM {px}) q
      GROUP BY {keys}, y, g)"""


_SUMMARY = """count(*) AS spans, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area_px,
  CAST(sum(y * 31 + x0 * 7 + x1 * 3) AS BIGINT) AS mix"""


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area_px"),
        F.sum(F.col("y") * 31 + F.col("x0") * 7 + F.col("x1") * 3).cast("bigint").alias("mix"),
    )


@query(
    "box_geometry",
    """SELECT l_orderkey AS frame_id, CAST(trunc(l_extendedprice / 100) AS BIGINT) AS cx,
      CAST(trunc(l_extendedprice / 130) AS BIGINT) AS cy, CAST(trunc(l_extendedprice / 100 - l_quantity / 2) AS BIGINT) AS x1,
      CAST(trunc(l_extendedprice / 130 - l_quantity / 2) AS BIGINT) AS y1,
      CAST(trunc(l_extendedprice / 100 + l_quantity / 2) AS BIGINT) AS x2,
      CAST(trunc(l_extendedprice / 130 + l_quantity / 2) AS BIGINT) AS y2 FROM lineitem""",
)
def geometry(spark, d) -> DataFrame:
    raw = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.lit(0.0).alias("class_id"),
        F.expr("array(l_extendedprice / 100, l_extendedprice / 130, l_quantity, l_quantity)").alias("xywh"),
        F.expr("""array(l_extendedprice / 100 - l_quantity / 2, l_extendedprice / 130 - l_quantity / 2,
          l_extendedprice / 100 + l_quantity / 2, l_extendedprice / 130 + l_quantity / 2)""").alias("xyxy"),
    )
    g = spans.box_geometry(raw, keys=("frame_id",))
    return g.select("frame_id", *[F.col(c).cast("bigint").alias(c) for c in ("cx", "cy", "x1", "y1", "x2", "y2")])


@query(
    "class_counts",
    f"""WITH {V.BOXES}, k AS (SELECT o_orderkey AS frame_id, c AS class_id, name
      FROM orders, (VALUES (0, 'Sheep'), (1, 'Goat'), (2, 'Dog')) v(c, name)),
    n AS (SELECT frame_id, class_id, count(*) AS n FROM bx GROUP BY 1, 2)
    SELECT k.frame_id, CAST(k.class_id AS BIGINT) AS class_id, coalesce(n, 0) AS n,
      'N. ' || name || ': ' || coalesce(n, 0) AS line FROM k LEFT JOIN n USING (frame_id, class_id)""",
)
def counts(spark, d) -> DataFrame:
    frames = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"))
    dets = V.box_lines(spark, d, "frame_id", "class_id")
    c = spans.class_counts(frames, dets, classes={0: "Sheep", 1: "Goat", 2: "Dog"}, keys=("frame_id",))
    return c.select("frame_id", F.col("class_id").cast("bigint").alias("class_id"), "n", "line")


@query(
    "safety_spans",
    f"""WITH {V.BOXES}, sp AS (SELECT DISTINCT flight_id, frame_id, cx, cy, r FROM bx WHERE r > 0),
    l AS (SELECT *, unnest(range(greatest(cy - r, 0), least(cy + r, {V.MASK_H - 1}) + 1)) AS y FROM sp),
    s AS (SELECT flight_id, frame_id, y, greatest(cx - CAST(floor(sqrt(r * r - (y - cy) * (y - cy))) AS INT), 0) AS x0,
      least(cx + CAST(floor(sqrt(r * r - (y - cy) * (y - cy))) AS INT), {V.MASK_W - 1}) AS x1 FROM l)
    SELECT flight_id, frame_id, {_SUMMARY} FROM s GROUP BY 1, 2""",
)
def circles(spark, d) -> DataFrame:
    return _summary(safety(spark, d), "flight_id", "frame_id")


@query(
    "mask_union_area",
    f"""WITH {V.BOXES}, {V.LAYER_PX}, {_runs('lay', 'flight_id, frame_id, layer')}
    SELECT flight_id, frame_id, layer, {_SUMMARY} FROM runs GROUP BY 1, 2, 3""",
)
def union_area(spark, d) -> DataFrame:
    keys = ("flight_id", "frame_id", "layer")
    return _summary(spans.mask_union(V.layer_spans(spark, d), keys=keys), *keys)


@query(
    "mask_area",
    f"""WITH {V.BOXES}, {V.LAYER_PX} SELECT flight_id, frame_id, layer, count(*) AS area_px FROM lay GROUP BY 1, 2, 3""",
)
def area(spark, d) -> DataFrame:
    keys = ("flight_id", "frame_id", "layer")
    return spans.mask_area(spans.mask_union(V.layer_spans(spark, d), keys=keys), keys=keys)


@query(
    "span_intersect",
    f"""WITH {V.SAFETY_PX}, {V.LAYER_PX}, both_ AS (
      SELECT DISTINCT flight_id, frame_id, y, x FROM safe JOIN lay USING (flight_id, frame_id, y, x)),
    {_runs('both_', 'flight_id, frame_id')} SELECT flight_id, frame_id, {_SUMMARY} FROM runs GROUP BY 1, 2""",
)
def intersect(spark, d) -> DataFrame:
    s = spans.span_intersect(safety(spark, d, dealt=True), V.layer_spans(spark, d))
    return _summary(s, "flight_id", "frame_id")


@query(
    "mask_difference",
    f"""WITH {V.SAFETY_PX}, {V.LAYER_PX}, u AS (SELECT DISTINCT flight_id, frame_id, y, x FROM lay),
    rest AS (SELECT u.* FROM u ANTI JOIN safe USING (flight_id, frame_id, y, x)),
    {_runs('rest', 'flight_id, frame_id')} SELECT flight_id, frame_id, {_SUMMARY} FROM runs GROUP BY 1, 2""",
)
def difference(spark, d) -> DataFrame:
    s = spans.mask_difference(V.layer_spans(spark, d), safety(spark, d, dealt=True))
    return _summary(s, "flight_id", "frame_id")


_NAMES = [n for n, _ in C.DANGER_LABELS]


_FLAG_SQL = (
    f"""WITH {V.SAFETY_PX}, {V.LAYER_PX}, d AS (SELECT * FROM lay WHERE layer <> 'other'),
    hit AS (SELECT d.*, s.x IS NOT NULL AS safe FROM d LEFT JOIN safe s USING (flight_id, frame_id, y, x)),
    px AS (SELECT flight_id, frame_id, y, x, bool_or(safe) AS safe FROM hit GROUP BY 1, 2, 3, 4),
    area AS (SELECT flight_id, frame_id, count(*) FILTER (WHERE safe) AS intersection_px,
      count(*) FILTER (WHERE NOT safe) AS danger_px FROM px GROUP BY 1, 2),
    flag AS (SELECT flight_id, frame_id, """
    + ", ".join(f"bool_or(safe AND layer = '{n}') AS {n}" for n in _NAMES)
    + """ FROM hit GROUP BY 1, 2),
    fr AS (SELECT flight_id, frame_id FROM area UNION SELECT flight_id, frame_id FROM safe)
    SELECT flight_id, frame_id, """
    + ", ".join(f"coalesce({n}, false) AS {n}" for n in _NAMES)
    + """, coalesce(intersection_px, 0) AS intersection_px, coalesce(danger_px, 0) AS danger_px,
      array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN {n} THEN '{t}' END" for n, t in C.DANGER_LABELS)
    + """], lambda v: v IS NOT NULL), ' & ') AS alert_msg
    FROM fr LEFT JOIN area USING (flight_id, frame_id) LEFT JOIN flag USING (flight_id, frame_id)"""
)


@query("danger_flags", _FLAG_SQL)
def flags(spark, d) -> DataFrame:
    f = spans.circle_danger_flags(
        V.boxes(spark, d), V.layer_spans(spark, d), width=V.MASK_W, height=V.MASK_H
    )
    return spans.danger_message(f)


@query("danger_flags_from_spans", _FLAG_SQL)
def flags_from_spans(spark, d) -> DataFrame:
    f = spans.danger_flags(safety(spark, d, dealt=True), V.layer_spans(spark, d))
    return spans.danger_message(f)


@query(
    "segmentation_layers",
    f"""WITH {V.BOXES} SELECT flight_id, frame_id, CASE layer_no WHEN 1 THEN 'roads' ELSE 'vehicles' END AS layer,
      CAST(ly AS BIGINT) AS y, CAST(lx0 AS BIGINT) AS x0, CAST(lx1 AS BIGINT) AS x1 FROM bx WHERE layer_no IN (1, 2)""",
)
def segmentation(spark, d) -> DataFrame:
    b = V.box_lines(spark, d, "flight_id", "frame_id", "layer_no", "ly", "lx0", "lx1")
    s = b.select("flight_id", "frame_id", F.col("layer_no").alias("class_id"),
                 F.col("ly").alias("y"), F.col("lx0").alias("x0"), F.col("lx1").alias("x1"))
    s = spans.segmentation_layers(s, suppress=(3, 4))
    return s.select("flight_id", "frame_id", "layer", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x0", "x1")])


@query(
    "label_runs",
    """WITH px AS (SELECT vec_id AS frame_id, i - 1 AS x, CASE WHEN embedding[i] > 0.1 THEN 2
        WHEN embedding[i] > -0.05 THEN 1 ELSE 0 END AS c
      FROM embeddings, (SELECT unnest(range(1, 65)) AS i) r),
    g AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY x)
      - row_number() OVER (PARTITION BY frame_id, c ORDER BY x) AS run FROM px)
    SELECT frame_id, CAST(c AS BIGINT) AS class_id, CAST(min(x) AS BIGINT) AS x0, CAST(max(x) AS BIGINT) AS x1
    FROM g GROUP BY frame_id, c, run""",
)
def label_runs(spark, d) -> DataFrame:
    rows = V.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame_id"),
        F.lit(0).alias("y"),
        F.transform(
            "embedding",
            lambda v: F.when(v > F.lit(0.1).cast("float"), 2).when(v > F.lit(-0.05).cast("float"), 1).otherwise(0),
        ).alias("labels"),
    )
    s = spans.label_rows_to_spans(rows, keys=("frame_id",))
    return s.select("frame_id", *[F.col(c).cast("bigint").alias(c) for c in ("class_id", "x0", "x1")])
