"""Default parameters.

Fixed values: numbers, labels and topic names that must equal the shipped defaults of the
monitored system for results to agree. They are stated here plainly and nowhere else.
"""

from __future__ import annotations

# telemetry topics and the snapshot used before the first message arrives
TELEMETRY_TOPICS = {
    "telemetry/latitude": "latitude",
    "telemetry/longitude": "longitude",
    "telemetry/rel_alt": "rel_alt",
    "telemetry/gb_yaw": "gb_yaw",
}
TELEMETRY_TEMPLATE = {
    "latitude": 44.414622942776454,
    "longitude": 8.880484631296774,
    "rel_alt": 40.0,
    "gb_yaw": 270.0,
}
MATCH_TOLERANCE_US = 150_000
TELEMETRY_BUFFER = 40

# frames
FPS = 30
PROCESSING_SHAPE = (1280, 720)
ORIGINAL_SHAPE = (1920, 1080)
ASPECT_RATIO = 16.0 / 9.0
ASPECT_TOLERANCE = 0.02

# hazard analysis
SAFETY_RADIUS_M = 2.0
ANIMAL_REFERENCE_SIZE_M = 1.3
SLOPE_THRESHOLD_DEG = 30.0
DEM_BUFFER_SCALE = 4.0
DANGER_LABELS = (
    ("roads", "Roads"),
    ("vehicles", "Vehicles"),
    ("nodata", "Missing elevation data"),
    ("geofence", "Out of geo-fenced area"),
    ("slope", "Steep slope"),
)
SEGMENT_LAYERS = {1: "roads", 2: "vehicles"}

# camera
FOCAL_LENGTH_MM = 12.29
SENSOR_WIDTH_MM = 17.35
SENSOR_HEIGHT_MM = 13.00
SENSOR_WIDTH_PX = 5280
SENSOR_HEIGHT_PX = 3956

# track features and anomaly scoring
FRAME_SKIP = 5
KNN_K = 5
SEQUENCE_LENGTH = 50
INTERP_MAX_AGE = 3
FEATURE_DIM = 9
VELOCITY_DIM = 6
AE_THRESHOLD = 2.75
SOCIAL_THRESHOLD = 5.0
SMOOTHING_WINDOW = 9
MIN_ANOMALY_DURATION = 15
EMA_ALPHA = 0.042
EMA_MIN_UPDATES = 63
MIN_HERD = 5
VARIANCE_FLOOR = 1e-8
MAX_TRACKS_PER_FRAME = 450

# texts and colours drawn on frames; colours are (blue, green, red)
SUMMARY_LINE = "Frame %d | tracks=%d | elevated=%d | confirmed=%d"
STATE_COLOURS = {
    "unscored": (180, 130, 70),
    "ok": (0, 200, 0),
    "elevated": (0, 220, 220),
    "confirmed": (0, 0, 255),
}

# alerts
ALERT_COOLDOWN_US = 1_000_000
SESSION_GAP = "30 minutes"

# WGS-84 ellipsoid
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
