"""The two end-to-end jobs, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import geo, scoring
from ..operators import tracks as T
from ..session import free
from ..settings import AnomalySettings, HazardSettings
from ..streaming import danger as live
from ..streaming import monitor, stateful
from ..streaming.run import drain, scratch
from . import danger, health
from . import views as V
from .q_anomaly import _EMA, ALPHA, MIN_HERD, MIN_UPDATES
from .q_geo import direct_sql
from .q_raster import META
from .registry import query

AE_MEAN, AE_STD = 0.05, 0.02
SETTINGS = AnomalySettings(
    ae_threshold=1.0, social_threshold=3.1, smoothing_window=3, min_duration=2, ema_alpha=ALPHA,
    min_updates=MIN_UPDATES, min_herd=MIN_HERD, sequence_length=4, knn_k=V.KNN_K, max_age=V.MAX_AGE,
)
_L = SETTINGS.sequence_length

_SCORES = (
    _EMA
    + f""", bg AS (SELECT *, kf_seq - row_number() OVER (PARTITION BY flight_id, track_id ORDER BY kf_seq) AS bseg FROM bf),
    ba AS (SELECT *, CASE WHEN row_number() OVER w >= {_L} THEN
        (avg(({' + '.join(f'CAST({f} AS DOUBLE) * {f}' for f in T.FEATURES[:6])}) / 6) OVER v - {AE_MEAN}) / {AE_STD} ELSE 0 END AS ae
      FROM bg WINDOW w AS (PARTITION BY flight_id, track_id, bseg ORDER BY kf_seq),
        v AS (PARTITION BY flight_id, track_id, bseg ORDER BY kf_seq ROWS BETWEEN {_L - 1} PRECEDING AND CURRENT ROW)),
    sc AS (SELECT b.flight_id, b.track_id, b.kf_seq, b.frame_id, b.kts AS ts_us, b.is_visible, b.ae,
      CASE WHEN n_updates >= {MIN_UPDATES} THEN sqrt("""
    + " + ".join(f"power(b.{f} - h.mean_{f}, 2) / h.var_{f}" for f in T.FEATURES)
    + """) ELSE 0 END AS soc FROM ba b JOIN herd h USING (flight_id, kf_seq))"""
)
_STATES = V.state_sql(
    _SCORES, _L, SETTINGS.smoothing_window, SETTINGS.min_duration, SETTINGS.ae_threshold,
    SETTINGS.social_threshold,
)
# the batch job's features are normalised before anything is scored
FEATURE_MEAN = [0.01 * i for i in range(len(T.FEATURES))]
FEATURE_STD = [0.9 + 0.05 * i for i in range(len(T.FEATURES))]
_SCALED = ", bn AS (SELECT * REPLACE (" + ", ".join(
    f"CAST((CAST({f} AS DOUBLE) - {m!r}::DOUBLE) / {s!r}::DOUBLE AS FLOAT) AS {f}"
    for f, m, s in zip(T.FEATURES, FEATURE_MEAN, FEATURE_STD)
) + ") FROM bf), batch AS ("
_BATCH_CTE = ", batch AS ("
_NORMAL_STATES = _STATES.replace(_BATCH_CTE, _SCALED).replace(" FROM bf GROUP BY", " FROM bn GROUP BY").replace(
    "AS bseg FROM bf)", "AS bseg FROM bn)"
)
_SELECT_STATES = """SELECT flight_id, track_id, kf_seq, is_visible, eligible,
  round(ae_smooth, 3) AS ae_smooth, round(soc_smooth, 4) AS soc_smooth, confirmed, state FROM state"""
_STATE_QUERY = f"WITH RECURSIVE {_STATES} {_SELECT_STATES}"
_STATE_COLS = ("flight_id", "track_id", "kf_seq", "is_visible", "eligible")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        *_STATE_COLS, F.round("ae_smooth", 3).alias("ae_smooth"),
        F.round("soc_smooth", 4).alias("soc_smooth"), "confirmed", "state",
    )


def herd_health(spark, d) -> health.HealthResult:
    return health.health_monitoring(
        V.tracks(spark, d).drop("ts_us"), V.keyframes(spark, d), settings=SETTINGS,
        make_predict_fn=scoring.mean_square_speed(), ae_mean=AE_MEAN, ae_std=AE_STD,
        feature_mean=FEATURE_MEAN, feature_std=FEATURE_STD, cooldown_us=2 * V.KEYFRAME_US,
    )


@query("health_monitoring", f"WITH RECURSIVE {_NORMAL_STATES} {_SELECT_STATES}")
def health_states(spark, d) -> DataFrame:
    return _shown(herd_health(spark, d).states)


@query(
    "health_alerts",
    f"""WITH RECURSIVE {_NORMAL_STATES}, g AS (SELECT flight_id, frame_id, ts_us, string_agg(CASE WHEN is_visible AND state LIKE 'confirmed%'
      THEN CAST(track_id AS VARCHAR) END, ', ' ORDER BY track_id) AS ids FROM state GROUP BY 1, 2, 3),
    cand AS (SELECT *, 'Anomaly: tracks [' || ids || ']' AS alert_msg FROM g WHERE ids IS NOT NULL),
    walk AS (
      SELECT flight_id, min(ts_us) AS ts_us FROM cand GROUP BY 1
      UNION ALL
      SELECT w.flight_id, (SELECT min(c.ts_us) FROM cand c WHERE c.flight_id = w.flight_id
        AND c.ts_us >= w.ts_us + {2 * V.KEYFRAME_US}) FROM walk w WHERE w.ts_us IS NOT NULL)
    SELECT c.flight_id, c.frame_id, c.ts_us, c.alert_msg FROM cand c JOIN walk w USING (flight_id, ts_us)""",
)
def health_alerts(spark, d) -> DataFrame:
    return herd_health(spark, d).alerts.select("flight_id", "frame_id", "ts_us", "alert_msg")


# five frames follow every keyframe, evenly in time
_STEP_US = V.KEYFRAME_US // 6


def all_frames(spark, d) -> DataFrame:
    kf = V.keyframes(spark, d).select("flight_id", "frame_id", "ts_us", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return kf.select("flight_id", (F.col("frame_id") + F.col("i")).alias("frame_id"), (F.col("ts_us") + F.col("i") * _STEP_US).alias("ts_us"))


def herd_frames(spark, d) -> health.HealthResult:
    return health.health_monitoring(
        V.tracks(spark, d).drop("ts_us"), V.keyframes(spark, d), settings=SETTINGS,
        make_predict_fn=scoring.mean_square_speed(), ae_mean=AE_MEAN, ae_std=AE_STD,
        feature_mean=FEATURE_MEAN, feature_std=FEATURE_STD, cooldown_us=2 * _STEP_US, frames=all_frames(spark, d),
    )


_SHOWN = f"""{_NORMAL_STATES}, nx AS (SELECT flight_id, kf_seq, lead(kf_seq) OVER (PARTITION BY flight_id ORDER BY kf_seq) AS nk FROM kf),
    seen AS (SELECT t.*, s.state FROM tr t LEFT JOIN state s ON s.flight_id = t.flight_id AND s.kf_seq = t.kf_seq
      AND s.track_id = t.track_id AND s.is_visible),
    fr AS (SELECT flight_id, kf_seq, i, kf_seq * 6 + i AS frame_id, {V.BASE_US} + kf_seq * {V.KEYFRAME_US} + i * {_STEP_US} AS ts_us
      FROM kf, range(6) r(i)),
    shown AS (
      SELECT f.flight_id, f.frame_id, a.track_id, a.state, a.x1, a.y2 FROM fr f JOIN seen a USING (flight_id, kf_seq) WHERE f.i = 0
      UNION ALL
      SELECT f.flight_id, f.frame_id, a.track_id, a.state, (1 - f.i / 6.0::DOUBLE) * a.x1 + f.i / 6.0::DOUBLE * b.x1,
        (1 - f.i / 6.0::DOUBLE) * a.y2 + f.i / 6.0::DOUBLE * b.y2
      FROM fr f JOIN nx USING (flight_id, kf_seq) JOIN seen a USING (flight_id, kf_seq)
        JOIN tr b ON b.flight_id = f.flight_id AND b.kf_seq = nx.nk AND b.track_id = a.track_id WHERE f.i > 0),
    told AS (SELECT f.flight_id, f.frame_id, f.ts_us, count(s.track_id) AS tracks, round(sum(s.x1 + s.y2), 3) AS places,
        string_agg(CASE WHEN s.state LIKE 'confirmed%' THEN CAST(s.track_id AS VARCHAR) END, ', ' ORDER BY s.track_id) AS ids
      FROM fr f LEFT JOIN shown s USING (flight_id, frame_id) GROUP BY 1, 2, 3)"""


@query(
    "health_frames",
    f"""WITH RECURSIVE {_SHOWN} SELECT flight_id, frame_id, tracks, places,
      coalesce('Anomaly: tracks [' || ids || ']', '') AS alert_msg FROM told""",
)
def health_frames(spark, d) -> DataFrame:
    """What every frame shows: tracks at interpolated places, and the line of its confirmed ones."""
    r = herd_frames(spark, d)
    seen = r.shown.groupBy("flight_id", "frame_id").agg(
        F.count(F.lit(1)).alias("tracks"), F.round(F.sum(F.col("x1") + F.col("y2")), 3).alias("places")
    )
    return r.messages.join(seen, ["flight_id", "frame_id"], "left").select(
        "flight_id", "frame_id", F.coalesce("tracks", F.lit(0).cast("bigint")).alias("tracks"), "places", "alert_msg"
    )


@query(
    "health_frame_alerts",
    f"""WITH RECURSIVE {_SHOWN}, cand AS (SELECT *, 'Anomaly: tracks [' || ids || ']' AS alert_msg FROM told WHERE ids IS NOT NULL),
    walk AS (
      SELECT flight_id, min(ts_us) AS ts_us FROM cand GROUP BY 1
      UNION ALL
      SELECT w.flight_id, (SELECT min(c.ts_us) FROM cand c WHERE c.flight_id = w.flight_id
        AND c.ts_us >= w.ts_us + {2 * _STEP_US}) FROM walk w WHERE w.ts_us IS NOT NULL)
    SELECT c.flight_id, c.frame_id, c.ts_us, c.alert_msg FROM cand c JOIN walk w USING (flight_id, ts_us)""",
)
def health_frame_alerts(spark, d) -> DataFrame:
    return herd_frames(spark, d).alerts.select("flight_id", "frame_id", "ts_us", "alert_msg")


@query("stream_track_monitor", _STATE_QUERY)
def stream_health(spark, d) -> DataFrame:
    """Keyframes written as a log, then scored as a stream."""
    stateful.use_rocksdb(spark)
    animals = V.tracks(spark, d).groupBy("flight_id", "kf_seq").agg(
        F.collect_list(F.struct("track_id", "cx", "cy")).alias("tracks")
    )
    rows = V.keyframes(spark, d).join(animals, ["flight_id", "kf_seq"], "left")
    folder = scratch(spark, "keyframes")
    rows.select(*monitor.KEYFRAME_COLS).write.parquet(folder)
    stream = spark.readStream.schema(monitor.KEYFRAME_ROW).parquet(folder)
    out = monitor.track_monitor(
        stream, settings=SETTINGS, make_predict_fn=scoring.mean_square_speed(), ae_mean=AE_MEAN,
        ae_std=AE_STD,
    )
    return _shown(drain(out, "monitor"))


# ---------------------------------------------------------------- danger

W, H = V.MASK_W, V.MASK_H
# a fence over part of the raster, in its coordinates
RING = [(8.8803, 44.4199), (8.8847, 44.4197), (8.8841, 44.4163), (8.8809, 44.4166)]
CELL_M = 8.0
HAZARD = HazardSettings(cooldown_us=600_000_000, slope_threshold_deg=66.0)

# Orders act as frames, one a second over all flights, their lines as detections and labels. Most
# orders bring four messages; those without have stale telemetry or none. The yaw of every third
# comes too late for its own frame, which then has the yaw before it.
_FRAME_US = f"{V.BASE_US} + o_orderkey * 1000000"
_QUIET = "o_custkey % 6 = 0"
# Sixteen customers share a place, so places and poses grow with the tables.
_SPOT = "cast(floor(o_custkey / 16) AS bigint)"
_MESSAGES = [  # topic, field, when, payload
    ("telemetry/latitude", "latitude", "-50000", f"44.4163 + ({_SPOT} * 37 % 1013) * 0.000004"),
    ("telemetry/longitude", "longitude", "-40000", f"8.8803 + ({_SPOT} * 53 % 1009) * 0.000004"),
    ("telemetry/rel_alt", "rel_alt", "-30000", f"60 + ({_SPOT} % 3) * 40"),
    ("telemetry/gb_yaw", "gb_yaw", "CASE WHEN o_orderkey % 3 = 0 THEN 120000 ELSE 20000 END",
     "15 + (o_custkey % 4) * 90"),
]


def danger_inputs(spark, d) -> dict:
    orders = V.table(spark, d, "orders").select(
        F.expr("o_orderkey % 10").alias("flight_id"), "o_orderkey", "o_custkey",
        F.expr(_FRAME_US).alias("ts_us"),
    )
    frames = orders.select("flight_id", F.col("o_orderkey").alias("frame_id"), "ts_us")
    sent = ", ".join(
        f"struct(o_orderkey * 4 + {i} AS seq, ts_us + {at} AS ts_us, '{topic}' AS topic, "
        f"cast({value} AS string) AS payload)"
        for i, (topic, _, at, value) in enumerate(_MESSAGES)
    )
    messages = orders.filter(f"NOT ({_QUIET})").select(
        "flight_id", F.expr(f"inline(array({sent}))")
    )
    lines = V.box_lines(
        spark, d, "flight_id", "frame_id", "cx", "cy", "w", "h", "layer_no", "ly", "lx0", "lx1"
    )
    detections = lines.select(
        "flight_id", "frame_id", "cx", "cy", (F.col("cx") - F.col("w")).alias("x1"),
        F.col("cx").alias("x2"), (F.col("cy") - F.col("h")).alias("y1"), F.col("cy").alias("y2"),
    )
    labels = lines.select(
        "flight_id", "frame_id", F.col("layer_no").alias("class_id"), F.col("ly").alias("y"),
        F.col("lx0").alias("x0"), F.col("lx1").alias("x1"),
    )
    cells = V.dem_cells(spark, d)
    meta = cells.groupBy("dem_id").agg(
        *[F.lit(v).alias(k) for k, v in META.items()], F.lit(V.DEM_COLS).alias("width"),
        (F.max("row") + 1).alias("height"), F.lit("EPSG:4326").alias("crs"),
    )
    return {
        "frames": frames, "messages": messages, "detections": detections, "label_spans": labels,
        "dem_cells": cells, "dem_meta": meta,
    }


def herd_danger(spark, d) -> danger.DangerResult:
    return danger.danger_detection(
        **danger_inputs(spark, d), dem_id="dem", dem_pixel_m=CELL_M, ring=geo.ring_literal(RING),
        settings=HAZARD, width=W, height=H,
    )


_RES = (
    f"((m.rel_alt / {C.FOCAL_LENGTH_MM}) * (CAST({C.SENSOR_WIDTH_MM} AS DOUBLE) / {C.SENSOR_WIDTH_PX}.0) "
    f"* least({C.SENSOR_WIDTH_PX}.0::DOUBLE / {W}, {C.SENSOR_HEIGHT_PX}.0::DOUBLE / {H}))"
)
_DANGER = (
    f"""ord AS (SELECT o_orderkey % 10 AS flight_id, o_orderkey, o_custkey, {_FRAME_US} AS ts_us FROM orders),
    fr AS (SELECT flight_id, o_orderkey AS frame_id, ts_us FROM ord),
    decoded AS ("""
    + " UNION ALL ".join(
        f"SELECT flight_id, o_orderkey * 4 + {i} AS seq, ts_us + {at} AS ts_us, '{field}' AS field, "
        f"CAST({value} AS DOUBLE) AS value FROM ord WHERE NOT ({_QUIET})"
        for i, (_, field, at, value) in enumerate(_MESSAGES)
    )
    + ")"
    + V.SNAPSHOT[len(V.DECODED):]
    + f""", pairs AS (
      SELECT f.frame_id, s.*, abs(s.ts_us - f.ts_us) AS d FROM fr f JOIN snap s ON s.flight_id = f.flight_id
        AND s.ts_us BETWEEN f.ts_us - {C.MATCH_TOLERANCE_US} AND f.ts_us + {C.MATCH_TOLERANCE_US}),
    near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY d, ts_us, seq) = 1),
    m AS (SELECT fr.*, d AS match_dt_us, latitude, longitude, rel_alt, gb_yaw FROM fr LEFT JOIN near USING (frame_id)),
    """
    + V.BOXES
    + f""", fb AS (SELECT frame_id, median(greatest(w, h)) AS med FROM bx GROUP BY 1),
    pose AS (SELECT *, row_number() OVER () AS pose_id FROM (
      SELECT DISTINCT latitude, longitude, rel_alt, gb_yaw, {W} AS image_w, {H} AS image_h, {_RES} AS meters_per_pixel
      FROM m WHERE match_dt_us IS NOT NULL) q),
    loc AS MATERIALIZED (SELECT m.flight_id, m.frame_id, m.ts_us, p.pose_id,
        CASE WHEN m.match_dt_us IS NOT NULL THEN CAST(trunc(2.0 / p.meters_per_pixel) AS BIGINT)
          WHEN med > 0 THEN CAST(trunc(2.0::DOUBLE / (1.3::DOUBLE / med)) AS BIGINT) ELSE -1 END AS r
      FROM m LEFT JOIN fb ON fb.frame_id = m.frame_id LEFT JOIN pose p USING (latitude, longitude, rel_alt, gb_yaw)),
    pc AS (SELECT pose.*, corner, CASE corner WHEN 'ul' THEN 0 WHEN 'bl' THEN 0 ELSE image_w - 1 END AS cpx,
        CASE corner WHEN 'ul' THEN 0 WHEN 'ur' THEN 0 ELSE image_h - 1 END AS cpy
      FROM pose, (VALUES ('ul'), ('ur'), ('bl')) v(corner)),
    {direct_sql('pc', 'g', 'cpx', 'cpy', 'pose_id, corner')},
    wide AS (SELECT pose_id, """
    + ", ".join(
        f"max(CASE WHEN corner = '{c}' THEN {a} END) AS {c}_{a}" for c in ("ul", "ur", "bl") for a in ("lon", "lat")
    )
    + f""" FROM g GROUP BY 1),
    px AS (SELECT pose_id, y, x, ul_lon + (x + 0.5) * (ur_lon - ul_lon) / {W - 1} + (y + 0.5) * (bl_lon - ul_lon) / {H - 1} AS lon,
        ul_lat + (x + 0.5) * (ur_lat - ul_lat) / {W - 1} + (y + 0.5) * (bl_lat - ul_lat) / {H - 1} AS lat
      FROM wide, range({H}) ys(y), range({W}) xs(x)),
    {V.DEM}, ext AS (SELECT max("row") AS rm FROM dem),
    pr AS (SELECT unnest(range(-2, rm + 3)) AS "row" FROM ext), pcl AS (SELECT unnest(range(-2, {V.DEM_COLS + 2})) AS col),
    pad AS (SELECT p."row", c.col, coalesce(elev, 0.0) AS elev, coalesce(nodata, 1) AS nodata
      FROM pr p CROSS JOIN pcl c LEFT JOIN dem ON dem."row" = p."row" AND dem.col = c.col),
    grad AS (SELECT c."row", c.col, any_value(c.nodata) AS nodata,
        sum(n.elev * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / (8 * {CELL_M}) AS dx,
        sum(n.elev * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / (8 * {CELL_M}) AS dy
      FROM pad c, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc), ext, pad n
      WHERE n."row" = least(greatest(c."row" + dr, -2), rm + 2) AND n.col = least(greatest(c.col + dc, -2), {V.DEM_COLS + 1})
      GROUP BY 1, 2),
    ground AS MATERIALIZED (SELECT pose_id, y, x, ("""
    + " + ".join(
        f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < {ax} + (lat - {ay}) * ({bx} - {ax}) / ({by} - {ay}) THEN 1 ELSE 0 END"
        for (ax, ay), (bx, by) in zip([(f"{x}::DOUBLE", f"{y}::DOUBLE") for x, y in RING],
                                      [(f"{x}::DOUBLE", f"{y}::DOUBLE") for x, y in RING[1:] + RING[:1]])
    )
    + f""") % 2 = 0 AS geofence, coalesce(nodata, 1) = 1 AS nodata,
        coalesce(dx * dx + dy * dy > power(tan(radians({HAZARD.slope_threshold_deg})), 2), false) AS slope
      FROM px LEFT JOIN grad ON grad.col = CAST(floor((lon - {META['c']}) / {META['a']}) AS BIGINT)
        AND grad."row" = CAST(floor((lat - {META['f']}) / {META['e']}) AS BIGINT)),
    cover AS (SELECT pose_id, count(*) AS n FROM ground WHERE geofence OR nodata OR slope GROUP BY 1),
    sp AS (SELECT DISTINCT loc.frame_id, pose_id, cx, cy, loc.r FROM loc JOIN bx ON bx.frame_id = loc.frame_id WHERE loc.r > 0),
    safe AS (SELECT DISTINCT frame_id, pose_id, y, x FROM (
        SELECT frame_id, pose_id, cx, cy, r, y, unnest(range(cx - r, cx + r + 1)) AS x FROM (
          SELECT *, unnest(range(cy - r, cy + r + 1)) AS y FROM sp) a) b
      WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r AND x BETWEEN 0 AND {W - 1} AND y BETWEEN 0 AND {H - 1}),
    seg AS (SELECT frame_id, y, x, bool_or(layer_no = 1) AS roads, bool_or(layer_no = 2) AS vehicles FROM (
        SELECT frame_id, layer_no, ly AS y, unnest(range(lx0, lx1 + 1)) AS x FROM bx WHERE layer_no IN (1, 2)) q GROUP BY 1, 2, 3),
    beside AS (SELECT s.frame_id, count(*) AS n FROM seg s JOIN loc USING (frame_id)
        LEFT JOIN ground g ON g.pose_id = loc.pose_id AND g.y = s.y AND g.x = s.x
      WHERE NOT coalesce(geofence OR nodata OR slope, false) GROUP BY 1),
    hit AS (SELECT s.frame_id, coalesce(roads, false) AS roads, coalesce(vehicles, false) AS vehicles,
        coalesce(geofence, false) AS geofence, coalesce(nodata, false) AS nodata, coalesce(slope, false) AS slope
      FROM safe s LEFT JOIN seg USING (frame_id, y, x)
        LEFT JOIN ground g ON g.pose_id = s.pose_id AND g.y = s.y AND g.x = s.x),
    flag AS (SELECT frame_id, """
    + ", ".join(f"bool_or({n}) AS {n}" for n, _ in C.DANGER_LABELS)
    + ", count(*) FILTER (WHERE "
    + " OR ".join(n for n, _ in C.DANGER_LABELS)
    + """) AS intersection_px FROM hit GROUP BY 1),
    shown AS (SELECT flight_id, loc.frame_id, ts_us, """
    + ", ".join(f"coalesce({n}, false) AS {n}" for n, _ in C.DANGER_LABELS)
    + """, coalesce(intersection_px, 0) AS intersection_px,
        coalesce(cover.n, 0) + coalesce(beside.n, 0) - coalesce(intersection_px, 0) AS danger_px
      FROM loc LEFT JOIN flag ON flag.frame_id = loc.frame_id LEFT JOIN cover ON cover.pose_id = loc.pose_id
        LEFT JOIN beside ON beside.frame_id = loc.frame_id),
    danger AS MATERIALIZED (SELECT *, array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN {n} THEN '{t}' END" for n, t in C.DANGER_LABELS)
    + """], lambda v: v IS NOT NULL), ' & ') AS alert_msg FROM shown)"""
)
_NAMES = [n for n, _ in C.DANGER_LABELS]


@query(
    "danger_detection",
    f"WITH {_DANGER} SELECT flight_id, frame_id, {', '.join(_NAMES)}, intersection_px, danger_px, alert_msg FROM danger",
)
def danger_flags(spark, d) -> DataFrame:
    """What every frame's hazard layers cover, and which of them safety circles touch."""
    return herd_danger(spark, d).flags.select(
        "flight_id", "frame_id", *_NAMES, "intersection_px", "danger_px", "alert_msg"
    )


@query(
    "danger_alerts",
    f"""WITH RECURSIVE {_DANGER}, cand AS (SELECT * FROM danger WHERE alert_msg <> ''), walk AS (
      SELECT flight_id, min(ts_us) AS ts_us FROM cand GROUP BY 1
      UNION ALL
      SELECT w.flight_id, (SELECT min(c.ts_us) FROM cand c WHERE c.flight_id = w.flight_id
        AND c.ts_us >= w.ts_us + {HAZARD.cooldown_us}) FROM walk w WHERE w.ts_us IS NOT NULL)
    SELECT c.flight_id, c.frame_id, c.ts_us, c.alert_msg FROM cand c JOIN walk w USING (flight_id, ts_us)""",
)
def danger_alerts(spark, d) -> DataFrame:
    return herd_danger(spark, d).alerts.select("flight_id", "frame_id", "ts_us", "alert_msg")


@query(
    "stream_danger",
    f"""WITH RECURSIVE {_DANGER}, cand AS (SELECT * FROM danger WHERE alert_msg <> ''), walk AS (
      SELECT flight_id, min(ts_us) AS ts_us FROM cand GROUP BY 1
      UNION ALL
      SELECT w.flight_id, (SELECT min(c.ts_us) FROM cand c WHERE c.flight_id = w.flight_id
        AND c.ts_us >= w.ts_us + {HAZARD.cooldown_us}) FROM walk w WHERE w.ts_us IS NOT NULL)
    SELECT flight_id, frame_id, {', '.join(_NAMES)}, intersection_px, danger_px, alert_msg, w.ts_us IS NOT NULL AS alerted
    FROM danger LEFT JOIN walk w USING (flight_id, ts_us)""",
)
def stream_danger(spark, d) -> DataFrame:
    """The danger job as a stream of three files whose rows overlap in time by half a minute."""
    given = danger_inputs(spark, d)
    at = given["frames"].select("flight_id", "frame_id", "ts_us")
    timed = {n: given[n].join(at, ["flight_id", "frame_id"]) for n in ("detections", "label_spans")}
    rows = live.inputs(given["frames"], given["messages"], timed["detections"], timed["label_spans"], tol_us=HAZARD.tolerance_us)
    folder = scratch(spark, "danger")
    # detections and labels are due with their frames, so frames and messages alone tell the extent
    sent = given["messages"].select(F.col("ts_us").alias("due_us"))
    ends = given["frames"].select((F.col("ts_us") + HAZARD.tolerance_us).alias("due_us")).unionByName(sent)
    ends = ends.agg(F.min("due_us"), F.max("due_us")).first()
    third = (ends[1] - ends[0]) // 3 + 1
    # every seventh frame and message arrives half a minute late, which the delay allows
    arrival = F.floor((F.col("due_us") - ends[0] + F.when(F.coalesce("frame_id", "seq") % 7 == 0, 30_000_000).otherwise(0)) / third)
    # one pass over the joined rows for all three files
    rows.withColumn("part", F.least(arrival, F.lit(2)).cast("int")).write.partitionBy("part").parquet(folder)
    free(spark)
    files = spark.read.schema(f"{live.ROW}, part INT").parquet(folder)
    ground = danger.ground_of(
        ring=geo.ring_literal(RING), dem_cells=given["dem_cells"], dem_meta=given["dem_meta"], dem_id="dem",
        dem_pixel_m=CELL_M, settings=HAZARD, width=W, height=H,
    )
    log = live.danger_log(scratch(spark, "danger-log"), ground, delay_us=60_000_000, settings=HAZARD, width=W, height=H)
    for k in range(3):
        log.batch(files.filter(F.col("part") == k).drop("part"), k)
    log.batch(spark.createDataFrame([], live.ROW), 3, flush=True)
    return log.tables(spark).rows.drop("epoch", "ts_us")
