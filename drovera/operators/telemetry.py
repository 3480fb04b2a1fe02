"""Telemetry: decoding, full snapshots, and the nearest-in-time join to frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from . import ordered as O

# what a plain decimal number looks like; the JVM parser alone would also take "1.5f" or "0x1p3"
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def parse_number(payload: str | Column) -> Column:
    col = F.col(payload) if isinstance(payload, str) else payload
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def decode_telemetry(
    messages: DataFrame, *, topic_map: Mapping[str, str] = C.TELEMETRY_TOPICS
) -> DataFrame:
    """Topic to field, payload to number; unknown topics and unparsable payloads drop out."""
    pairs = [F.lit(x) for kv in topic_map.items() for x in kv]
    return (
        messages.filter(F.col("topic").isin(*topic_map))
        .withColumn("field", F.element_at(F.create_map(*pairs), F.col("topic")))
        .withColumn("value", parse_number("payload"))
        .filter(F.col("value").isNotNull())
        .drop("topic", "payload")
    )


def telemetry_snapshot(
    decoded: DataFrame,
    *,
    template: Mapping[str, float] = C.TELEMETRY_TEMPLATE,
    keys: Sequence[str] = ("flight_id",),
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """One full snapshot per message: the other fields keep their last value, or the template's.

    Arrival order is ``seq``, unique within the flight, so blocks of sequence numbers bound every
    task; only the last value of each field crosses a block border.
    """
    blocked = O.seq_blocks(decoded, "seq", size=block)
    filled = O.running_last(
        blocked,
        keys,
        "seq",
        {f: F.when(F.col("field") == f, F.col("value")) for f in template},
    )
    return filled.select(
        *keys,
        "seq",
        "ts_us",
        *[F.coalesce(F.col(f), F.lit(float(v))).alias(f) for f, v in template.items()],
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("flight_id",),
    left_ts: str = "ts_us",
    right_ts: str = "ts_us",
    right_order: str = "seq",
    right_cols: Sequence[str] = ("latitude", "longitude", "rel_alt", "gb_yaw"),
    tol_us: int = C.MATCH_TOLERANCE_US,
    struct_name: str = "telemetry",
    block_us: int | None = None,
    target_rows: int = O.TARGET_ROWS,
) -> DataFrame:
    """Left outer join to the right row with the smallest |dt| if that is within ``tol_us``.

    Ties go to the earlier row, then to the smaller ``right_order``. Both inputs are stacked and
    sorted together, so each left row meets exactly two candidates (the last right row at or
    before it, the first one after it) however many right rows fall inside the tolerance; no pair
    list is built. Adds ``struct_name`` and ``match_dt_us``.
    """
    keys = list(keys)
    width = block_us or max(64 * tol_us, 60_000_000)
    cand = F.struct(
        F.col(right_ts).alias("t"), F.col(right_order).alias("o"), *[F.col(c) for c in right_cols]
    )
    r = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), cand.alias("_r"))
    l = left.select(
        *keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_l")
    )
    both = r.unionByName(l, allowMissingColumns=True)
    both = O.time_blocks(both, keys, "_t", width_us=width, target_rows=target_rows)

    is_right = F.col("_side") == 0
    # per block: the first arrival among rows sharing its latest (and its earliest) time
    latest = F.struct(F.col("_t"), (-F.col("_r.o")).alias("o"))
    earliest = F.struct(F.col("_t"), F.col("_r.o"))
    per_block = both.groupBy(*keys, O.BLK).agg(
        F.max_by("_r", F.when(is_right, latest)).alias("_last"),
        F.min_by("_r", F.when(is_right, earliest)).alias("_first"),
    )
    earlier = Window.partitionBy(*keys).orderBy(O.BLK).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.col(O.BLK).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_block.select(
        *keys,
        O.BLK,
        F.last("_last", ignorenulls=True).over(earlier).alias("_prev_in"),
        F.last("_first", ignorenulls=True).over(later).alias("_next_in"),
    )
    up = O.block_window(keys, ["_t", "_side", F.col("_r.o")])
    down = O.block_window(
        keys, [F.col("_t").desc(), F.col("_side").desc(), F.col("_r.o").desc()]
    )
    repeat = F.coalesce(F.lag("_t").over(up) == F.col("_t"), F.lit(False))
    seen = both.withColumn("_lead", F.when(is_right & ~repeat, F.col("_r"))).withColumns(
        {
            "_prev": F.last("_lead", ignorenulls=True).over(O.running(up)),
            "_next": F.last("_r", ignorenulls=True).over(O.running(down)),
        }
    )
    seen = seen.filter(~is_right)
    seen = O.with_carry(seen, carry, keys)
    prev, nxt = F.coalesce("_prev", "_prev_in"), F.coalesce("_next", "_next_in")
    seen = seen.select("_l", "_t", prev.alias("_prev"), nxt.alias("_next"))
    d_prev, d_next = F.col("_t") - F.col("_prev.t"), F.col("_next.t") - F.col("_t")
    best = F.when(
        d_next.isNull() | (d_prev <= d_next), F.struct(d_prev.alias("d"), F.col("_prev").alias("r"))
    ).otherwise(F.struct(d_next.alias("d"), F.col("_next").alias("r")))
    hit = F.col("_b.d") <= tol_us
    payload = F.struct(*[F.col(f"_b.r.{c}").alias(c) for c in right_cols])
    return seen.withColumn("_b", best).select(
        "_l.*",
        F.when(hit, payload).alias(struct_name),
        F.when(hit, F.col("_b.d")).alias("match_dt_us"),
    )


def match_quality(matched: DataFrame, *, keys: Sequence[str] = ("flight_id",)) -> DataFrame:
    """Frames and failed matches per flight."""
    return matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("match_dt_us").isNull()).alias("failed_matches"),
    )


def miss_streak(
    matched: DataFrame,
    *,
    keys: Sequence[str] = ("flight_id",),
    order: str = "frame_id",
    missed: Column | None = None,
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Consecutive failed matches up to each frame; a success resets the count.

    A streak is the distance to the last success, counted in rows of the flight.
    """
    miss = F.col("match_dt_us").isNull() if missed is None else missed
    df = O.seq_blocks(matched.withColumn("_miss", miss), order, size=block)
    df = O.running_sum(df, keys, [order], {"_n": F.lit(1)})
    df = O.running_last(df, keys, order, {"_ok": F.when(~F.col("_miss"), F.col("_n"))})
    return df.withColumn(
        "miss_streak", (F.col("_n") - F.coalesce(F.col("_ok"), F.lit(0))).cast("bigint")
    ).drop("_miss", "_n", "_ok", O.BLK)


def last_n(
    df: DataFrame, *, keys: Sequence[str] = ("flight_id",), order: Sequence[str], n: int
) -> DataFrame:
    """The latest ``n`` rows per key (a bounded buffer). Spark prunes each partition to ``n`` rows
    per key before the shuffle, so a hot key sends at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
