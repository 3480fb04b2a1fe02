"""The operators' input tables as views of the bundled retail and event tables.

Every view has a DataFrame form and a SQL form (a common table expression) with the same
arithmetic, so that a query and its SQL check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

HOUR_US = 3_600_000_000
KEYFRAME_US = 6 * HOUR_US
BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TS_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("user_id % 10").alias("flight_id"),
        "event_id",
        F.expr(TS_US).alias("ts_us"),
        "user_id",
        "event_type",
        "value",
    )


EVENTS = """ev AS (
  SELECT user_id % 10 AS flight_id, event_id, epoch_us(ts) AS ts_us, user_id, event_type, value
  FROM events)"""

# ---------------------------------------------------------------- telemetry

_TOPIC = """CASE event_type WHEN 'click' THEN 'telemetry/latitude' WHEN 'view' THEN 'telemetry/longitude'
  WHEN 'error' THEN 'telemetry/rel_alt' WHEN 'signup' THEN 'telemetry/gb_yaw'
  ELSE 'telemetry/battery' END"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "flight_id",
        F.col("event_id").alias("seq"),
        "ts_us",
        F.expr(_TOPIC).alias("topic"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE cast(value AS string) END").alias(
            "payload"
        ),
    )


DECODED = (
    EVENTS
    + """, decoded AS (
  SELECT flight_id, event_id AS seq, ts_us,
    CASE event_type WHEN 'click' THEN 'latitude' WHEN 'view' THEN 'longitude'
      WHEN 'error' THEN 'rel_alt' WHEN 'signup' THEN 'gb_yaw' END AS field, value
  FROM ev WHERE event_type <> 'purchase' AND event_id % 17 <> 0)"""
)

SNAPSHOT = (
    DECODED
    + f""", snap AS (
  SELECT flight_id, seq, ts_us,
    coalesce(last_value(CASE WHEN field = 'latitude' THEN value END IGNORE NULLS) OVER w, {C.TELEMETRY_TEMPLATE['latitude']!r}) AS latitude,
    coalesce(last_value(CASE WHEN field = 'longitude' THEN value END IGNORE NULLS) OVER w, {C.TELEMETRY_TEMPLATE['longitude']!r}) AS longitude,
    coalesce(last_value(CASE WHEN field = 'rel_alt' THEN value END IGNORE NULLS) OVER w, {C.TELEMETRY_TEMPLATE['rel_alt']!r}) AS rel_alt,
    coalesce(last_value(CASE WHEN field = 'gb_yaw' THEN value END IGNORE NULLS) OVER w, {C.TELEMETRY_TEMPLATE['gb_yaw']!r}) AS gb_yaw
  FROM decoded
  WINDOW w AS (PARTITION BY flight_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases act as camera frames."""
    return (
        events(spark, sf_dir)
        .filter("event_type = 'purchase'")
        .select("flight_id", F.col("event_id").alias("frame_id"), "ts_us")
    )


FRAMES = "fr AS (SELECT flight_id, event_id AS frame_id, ts_us FROM ev WHERE event_type = 'purchase')"

TOL_US = 600_000_000  # ten minutes, the bundled events are minutes apart

MATCHED = (
    SNAPSHOT
    + ", "
    + FRAMES
    + f""", pairs AS (
  SELECT f.flight_id, f.frame_id, s.seq, s.ts_us, abs(s.ts_us - f.ts_us) AS d,
    s.latitude, s.longitude, s.rel_alt, s.gb_yaw
  FROM fr f JOIN snap s ON s.flight_id = f.flight_id
    AND s.ts_us BETWEEN f.ts_us - {TOL_US} AND f.ts_us + {TOL_US}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY flight_id, frame_id ORDER BY d, ts_us, seq) AS rn FROM pairs),
matched AS (
  SELECT f.flight_id, f.frame_id, f.ts_us, r.d AS match_dt_us, r.latitude, r.longitude, r.rel_alt, r.gb_yaw
  FROM fr f LEFT JOIN ranked r ON r.flight_id = f.flight_id AND r.frame_id = f.frame_id AND r.rn = 1)"""
)

# ---------------------------------------------------------------- boxes and layers

MASK_W, MASK_H = 320, 180

_BOX = {
    "flight_id": "l_orderkey % 10",
    "frame_id": "l_orderkey",
    "class_id": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END",
    "cx": f"(l_partkey * 37 + l_linenumber * 5) % {MASK_W}",
    "cy": f"(l_suppkey * 91 + l_linenumber * 13) % {MASK_H}",
    "w": "10 + (l_partkey + l_linenumber) % 40",
    "h": "8 + (l_suppkey * 3) % 45",
    "r": "cast(l_quantity AS int) % 13",
    "layer_no": "l_linenumber % 6",
    "ly": f"(l_suppkey * 7 + l_linenumber) % {MASK_H}",
    "lx0": f"(l_partkey * 11) % {MASK_W}",
    "lx1": f"least((l_partkey * 11) % {MASK_W} + cast(l_quantity AS int), {MASK_W - 1})",
}

BOXES = "bx AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BOX.items()) + " FROM lineitem)"


def box_lines(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Order lines as detections; only the named columns are derived (and read)."""
    return table(spark, sf_dir, "lineitem").select(
        *[F.expr(_BOX[c]).cast("bigint" if c in ("flight_id", "frame_id") else "int").alias(c) for c in cols]
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_lines(spark, sf_dir, "flight_id", "frame_id", "cx", "cy", "r")
    return b.withColumnRenamed("r", "safety_radius_px")


LAYER_NAMES = ("roads", "vehicles", "nodata", "geofence", "slope", "other")


def layer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box_lines(spark, sf_dir, "flight_id", "frame_id", "layer_no", "ly", "lx0", "lx1")
    names = F.array(*[F.lit(n) for n in LAYER_NAMES])
    return b.select(
        "flight_id", "frame_id", F.get(names, F.col("layer_no")).alias("layer"),
        F.col("ly").alias("y"), F.col("lx0").alias("x0"), F.col("lx1").alias("x1"),
    )


_LAYER_CASE = "CASE layer_no " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(LAYER_NAMES)
) + " END"

SAFETY_PX = (
    BOXES
    + f""", sp AS (
  SELECT DISTINCT flight_id, frame_id, cx, cy, r FROM bx WHERE r > 0),
safe AS (
  SELECT DISTINCT flight_id, frame_id, y, x FROM (
    SELECT flight_id, frame_id, cx, cy, r, y, unnest(range(cx - r, cx + r + 1)) AS x FROM (
      SELECT *, unnest(range(cy - r, cy + r + 1)) AS y FROM sp) a) b
  WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r
    AND x BETWEEN 0 AND {MASK_W - 1} AND y BETWEEN 0 AND {MASK_H - 1})"""
)

LAYER_PX = f"""lay AS (
  SELECT DISTINCT flight_id, frame_id, {_LAYER_CASE} AS layer, ly AS y, unnest(range(lx0, lx1 + 1)) AS x FROM bx)"""

# ---------------------------------------------------------------- elevation

DEM_COLS = 50


def dem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as elevation cells, 50 per raster row; one raster in all."""
    return table(spark, sf_dir, "part").select(
        F.lit("dem").alias("dem_id"),
        F.expr(f"cast(p_partkey div {DEM_COLS} AS int)").alias("row"),
        F.expr(f"cast(p_partkey % {DEM_COLS} AS int)").alias("col"),
        F.expr("cast(p_retailprice AS double) + (p_partkey * 7) % 31").alias("elev"),
        F.expr("CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END").alias("nodata"),
    )


DEM = f"""dem AS (
  SELECT 'dem' AS dem_id, CAST(p_partkey // {DEM_COLS} AS BIGINT) AS "row", CAST(p_partkey % {DEM_COLS} AS BIGINT) AS col,
    CAST(p_retailprice AS DOUBLE) + (p_partkey * 7) % 31 AS elev,
    CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END AS nodata FROM part)"""

# ---------------------------------------------------------------- tracks

_TRACK_SQL = f"""
  SELECT user_id % 10 AS flight_id, user_id AS track_id, (ts_us - {BASE_US}) {{div}} {KEYFRAME_US} AS kf_seq,
    sum(event_id) AS s, count(*) AS n, min(value) AS v
  FROM ev GROUP BY 1, 2, 3"""

_TRACK = {
    "flight_id": "flight_id",
    "frame_id": "kf_seq * 6",
    "kf_seq": "kf_seq",
    "track_id": "track_id",
    "ts_us": f"{BASE_US} + kf_seq * {KEYFRAME_US}",
    "x1": "CAST((s * 37 + n * 11) % 1280 AS DOUBLE) - 20",
    "y1": "CAST((s * 91 + n * 5) % 720 AS DOUBLE) - 12",
    "x2": "CAST((s * 37 + n * 11) % 1280 AS DOUBLE) + 20",
    "y2": "CAST((s * 91 + n * 5) % 720 AS DOUBLE) + 12",
    "cx": "CAST((s * 37 + n * 11) % 1280 AS DOUBLE)",
    "cy": "CAST((s * 91 + n * 5) % 720 AS DOUBLE)",
    "confidence": "v / 500",
    "class_id": "CAST(track_id % 2 AS INT)",
}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as animals, six-hour slots as keyframes; a slot without events is an absence."""
    raw = (
        events(spark, sf_dir)
        .groupBy(
            "flight_id",
            F.col("user_id").alias("track_id"),
            F.expr(f"(ts_us - {BASE_US}) div {KEYFRAME_US}").alias("kf_seq"),
        )
        .agg(F.sum("event_id").alias("s"), F.count(F.lit(1)).alias("n"), F.min("value").alias("v"))
    )
    return raw.select(*[F.expr(e).alias(n) for n, e in _TRACK.items()])


# homographies by keyframe number: none, identity, shift, mild perspective
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kf = (
        events(spark, sf_dir)
        .select("flight_id", F.expr(f"(ts_us - {BASE_US}) div {KEYFRAME_US}").alias("kf_seq"))
        .distinct()
    )
    h = """CASE kf_seq % 4 WHEN 1 THEN array(1D,0D,0D, 0D,1D,0D, 0D,0D,1D)
      WHEN 2 THEN array(1D,0D,cast(kf_seq % 7 AS double), 0D,1D,-cast(kf_seq % 5 AS double), 0D,0D,1D)
      WHEN 3 THEN array(1.01D,0.002D,3D, -0.001D,0.99D,-2D, 0.00001D,0.00002D,1D) END"""
    return kf.select(
        "flight_id",
        (F.col("kf_seq") * 6).alias("frame_id"),
        "kf_seq",
        F.expr(f"{BASE_US} + kf_seq * {KEYFRAME_US}").alias("ts_us"),
        F.expr(h).alias("h"),
    )


TRACKS = (
    EVENTS
    + ", traw AS ("
    + _TRACK_SQL.format(div="//")
    + "), tr AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _TRACK.items())
    + f""" FROM traw), kf AS (
  SELECT *, kf_seq * 6 AS frame_id, {BASE_US} + kf_seq * {KEYFRAME_US} AS ts_us, CAST(kf_seq % 4 AS INT) AS hk FROM (
    SELECT DISTINCT flight_id, (ts_us - {BASE_US}) // {KEYFRAME_US} AS kf_seq FROM ev) q)"""
)

MAX_AGE = 3
KNN_K = 5

VELOCITY = (
    TRACKS
    + f""", vlag AS (
  SELECT t.*, k.hk, lag(t.kf_seq) OVER w AS pk, lag(cx) OVER w AS px, lag(cy) OVER w AS py
  FROM tr t JOIN kf k ON k.flight_id = t.flight_id AND k.kf_seq = t.kf_seq
  WINDOW w AS (PARTITION BY t.flight_id, t.track_id ORDER BY t.kf_seq)),
vwarp AS (
  SELECT *, (pk IS NULL OR kf_seq - pk - 1 > {MAX_AGE}) AS new_segment,
    CASE hk WHEN 2 THEN px + kf_seq % 7
      WHEN 3 THEN (1.01 * px + 0.002 * py + 3) / (0.00001 * px + 0.00002 * py + 1) ELSE px END AS wx,
    CASE hk WHEN 2 THEN py - kf_seq % 5
      WHEN 3 THEN (-0.001 * px + 0.99 * py - 2) / (0.00001 * px + 0.00002 * py + 1) ELSE py END AS wy
  FROM vlag),
vel AS (
  SELECT flight_id, frame_id, kf_seq, track_id, cx, cy, new_segment,
    CASE WHEN new_segment THEN 0.0 ELSE cx - wx END AS vx,
    CASE WHEN new_segment THEN 0.0 ELSE cy - wy END AS vy
  FROM vwarp)"""
)

FEATURE_SQL = (
    VELOCITY
    + f""", nb AS (
  SELECT a.flight_id, a.kf_seq, a.track_id, b.cx AS bx, b.cy AS by_, b.vx AS bvx, b.vy AS bvy,
    (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2,
    row_number() OVER (PARTITION BY a.flight_id, a.kf_seq, a.track_id
      ORDER BY (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), b.track_id) AS rn
  FROM vel a JOIN vel b ON a.flight_id = b.flight_id AND a.kf_seq = b.kf_seq AND a.track_id <> b.track_id),
nbm AS (
  SELECT flight_id, kf_seq, track_id, avg(bx) AS mx, avg(by_) AS my, avg(bvx) AS mvx, avg(bvy) AS mvy,
    avg(sqrt(bvx * bvx + bvy * bvy)) AS ms, avg(sqrt(d2)) AS md
  FROM nb WHERE rn <= {KNN_K} GROUP BY 1, 2, 3),
feat AS (
  SELECT v.flight_id, v.frame_id, v.kf_seq, v.track_id,
    CAST(vx / 1280 AS FLOAT) AS vx_world, CAST(vy / 1280 AS FLOAT) AS vy_world,
    CAST(coalesce(vx - mvx, 0) / 1280 AS FLOAT) AS rel_vx, CAST(coalesce(vy - mvy, 0) / 1280 AS FLOAT) AS rel_vy,
    CAST(sqrt(vx * vx + vy * vy) / 1280 AS FLOAT) AS speed,
    CAST(coalesce(sqrt(vx * vx + vy * vy) - ms, 0) / 1280 AS FLOAT) AS rel_speed,
    CAST(coalesce(cx - mx, 0) / 1280 AS FLOAT) AS rel_x, CAST(coalesce(cy - my, 0) / 1280 AS FLOAT) AS rel_y,
    CAST(coalesce(md, 0) / 1280 AS FLOAT) AS knn_dist
  FROM vel v LEFT JOIN nbm USING (flight_id, kf_seq, track_id))"""
)

# bridging applied to any per-track table {src}; gives rows at every covered keyframe
BRIDGE_SQL = f""", {{out}}_n AS (
  SELECT *, lead(kf_seq) OVER (PARTITION BY flight_id, track_id ORDER BY kf_seq) AS nk FROM {{src}}),
{{out}} AS (
  SELECT n.* EXCLUDE (kf_seq, frame_id, nk), k.kf_seq, k.frame_id, k.ts_us AS kts, (k.kf_seq = n.kf_seq) AS is_visible
  FROM {{out}}_n n JOIN kf k ON k.flight_id = n.flight_id
    AND k.kf_seq BETWEEN n.kf_seq AND least(coalesce(n.nk - 1, n.kf_seq + {MAX_AGE}), n.kf_seq + {MAX_AGE}))"""

# ready-made scores for the state machine: two triangle waves per track over the bridged rows
SEQ_LEN, SMOOTH, DURATION = 3, 3, 3
AE_WAVE = "abs((kf_seq + track_id * 3) % 40 - 20) / 5.0"
SOC_WAVE = "abs((kf_seq + track_id * 5) % 60 - 30) / 4.0"

SCORED = (
    TRACKS
    + BRIDGE_SQL.format(src="(SELECT flight_id, track_id, kf_seq, frame_id FROM tr)", out="br")
    + f""", sc AS (
  SELECT flight_id, track_id, kf_seq, frame_id, kts AS ts_us, is_visible,
    CAST({AE_WAVE} AS DOUBLE) AS ae, CAST({SOC_WAVE} AS DOUBLE) AS soc FROM br)"""
)

def state_sql(scored: str, length: int, smooth: int, duration: int, ae: float, soc: float) -> str:
    """The state machine over a table ``sc`` of raw scores, as window queries."""
    return (
        scored
        + f""", seg0 AS (
  SELECT *, kf_seq - row_number() OVER (PARTITION BY flight_id, track_id ORDER BY kf_seq) AS seg FROM sc),
elig AS (
  SELECT *, row_number() OVER (PARTITION BY flight_id, track_id, seg ORDER BY kf_seq) >= {length} AS eligible FROM seg0),
sm AS (
  SELECT *, CASE WHEN eligible THEN avg(CASE WHEN eligible THEN ae END) OVER w END AS ae_smooth,
    CASE WHEN eligible THEN avg(CASE WHEN eligible THEN soc END) OVER w END AS soc_smooth
  FROM elig WINDOW w AS (PARTITION BY flight_id, track_id, seg ORDER BY kf_seq
    ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW)),
fl AS (
  SELECT *, coalesce(ae_smooth > {ae}, false) AS ae_up, coalesce(soc_smooth > {soc}, false) AS soc_up,
    coalesce(ae_smooth > {ae}, false) OR coalesce(soc_smooth > {soc}, false) AS flagged FROM sm),
isl AS (
  SELECT *, CASE WHEN flagged THEN kf_seq - row_number() OVER (
      PARTITION BY flight_id, track_id, flagged ORDER BY kf_seq) END AS run FROM fl),
st AS (
  SELECT *, CASE WHEN flagged THEN row_number() OVER (
      PARTITION BY flight_id, track_id, flagged, run ORDER BY kf_seq) ELSE 0 END AS lasted FROM isl),
state AS (
  SELECT *, lasted >= {duration} AS confirmed,
    CASE WHEN NOT eligible THEN 'unscored' WHEN NOT flagged THEN 'ok'
      ELSE CASE WHEN lasted >= {duration} THEN 'confirmed_' ELSE 'elevated_' END
        || CASE WHEN ae_up AND soc_up THEN 'both' WHEN ae_up THEN 'ae' ELSE 'soc' END END AS state
  FROM st)"""
    )


STATE_SQL = state_sql(SCORED, SEQ_LEN, SMOOTH, DURATION, 2.75, 5.0)

# ---------------------------------------------------------------- alerts

COOLDOWN_US = HOUR_US


def alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "flight_id",
        F.col("event_id").alias("frame_id"),
        "ts_us",
        F.expr("CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE '' END").alias(
            "alert_msg"
        ),
    )


ALERTS = (
    EVENTS
    + """, al AS (
  SELECT flight_id, event_id AS frame_id, ts_us,
    CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE '' END AS alert_msg FROM ev)"""
)

PASSED = (
    ALERTS
    + f""", cand AS (SELECT * FROM al WHERE alert_msg <> ''),
walk AS (
  SELECT flight_id, min(ts_us) AS ts_us FROM cand GROUP BY 1
  UNION ALL
  SELECT w.flight_id, (SELECT min(c.ts_us) FROM cand c
      WHERE c.flight_id = w.flight_id AND c.ts_us >= w.ts_us + {COOLDOWN_US}) AS ts_us
  FROM walk w WHERE w.ts_us IS NOT NULL),
passed AS (
  SELECT c.* FROM cand c JOIN walk w ON w.flight_id = c.flight_id AND w.ts_us = c.ts_us
  QUALIFY row_number() OVER (PARTITION BY c.flight_id, c.ts_us ORDER BY c.frame_id) = 1)"""
)
