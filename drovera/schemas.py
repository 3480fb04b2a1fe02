"""Explicit schemas (DDL) of every table the operators read or write."""

from __future__ import annotations


TELEMETRY_MESSAGES = "flight_id BIGINT, seq BIGINT, ts_us BIGINT, topic STRING, payload STRING"
TELEMETRY = (
    "flight_id BIGINT, seq BIGINT, ts_us BIGINT, "
    "latitude DOUBLE, longitude DOUBLE, rel_alt DOUBLE, gb_yaw DOUBLE"
)
FRAMES = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, orig_w INT, orig_h INT"
DETECTIONS = (
    "flight_id BIGINT, frame_id BIGINT, det_id BIGINT, class_id INT, "
    "cx INT, cy INT, x1 INT, y1 INT, x2 INT, y2 INT"
)
RAW_DETECTIONS = (
    "flight_id BIGINT, frame_id BIGINT, det_id BIGINT, class_id DOUBLE, "
    "xywh ARRAY<DOUBLE>, xyxy ARRAY<DOUBLE>"
)
MASK_SPANS = "flight_id BIGINT, frame_id BIGINT, layer STRING, y INT, x0 INT, x1 INT"
LABEL_SPANS = "flight_id BIGINT, frame_id BIGINT, class_id INT, y INT, x0 INT, x1 INT"
DEM_CELLS = "dem_id STRING, row INT, col INT, elev DOUBLE, nodata INT"
DEM_META = (
    "dem_id STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE, "
    "width INT, height INT, crs STRING"
)
TRACKS = (
    "flight_id BIGINT, frame_id BIGINT, kf_seq BIGINT, track_id BIGINT, "
    "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, confidence DOUBLE, class_id INT"
)
KEYFRAMES = "flight_id BIGINT, frame_id BIGINT, kf_seq BIGINT, ts_us BIGINT, h ARRAY<DOUBLE>"
ALERTS = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, alert_msg STRING"
ALERT_ROWS = (
    "flight_id BIGINT, alert_msg STRING, frame_id BIGINT, timestamp DOUBLE, datetime TIMESTAMP, "
    "image_data BINARY, image_width INT, image_height INT"
)
USERS = "user_id BIGINT, email STRING, password STRING, created_at TIMESTAMP"
FLIGHTS = "flight_id BIGINT, user_id BIGINT, start_time TIMESTAMP, stream_url STRING"
