"""Herd statistics, anomaly scores, states and events."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import motion
from . import ordered as O
from .tracks import FEATURES, TRACK


def herd_batch_stats(
    features: DataFrame,
    *,
    cols: Sequence[str] = FEATURES,
    keys: Sequence[str] = ("flight_id", "kf_seq"),
) -> DataFrame:
    """Count, mean and floored population variance per keyframe over all tracks of the herd."""
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tracks"),
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[(F.var_pop(c) + C.VARIANCE_FLOOR).alias(f"var_{c}") for c in cols],
    )


#: Updates that one task scans, however slowly the average forgets.
SCAN_BLOCK = 10_000


def affine_scan(
    rows: DataFrame, keys: Sequence[str], stats: Sequence[str], *, rate: float, carry: Sequence[str] = (),
    block: int = SCAN_BLOCK,
) -> DataFrame:
    """``m[n] = exp(-rate) m[n - 1] + x[n]`` for rows numbered 0, 1, ... by ``_n`` within their key.

    A block is short enough that exp(rate k) stays finite and no longer than ``block``; inside it the
    scan is a scaled running sum. What enters a block is the last result of the block before: alone
    where anything older is scaled by exp(-300), else after a scan of the blocks' own ends, which
    forget faster by the block's length. Each level has ``block`` times fewer rows.
    """
    keys, stats = list(keys), list(stats)
    length = max(1, min(math.floor(300.0 / rate), max(block, 2)))
    k = F.pmod(F.col("_n"), F.lit(length))
    part = rows.select(*keys, *carry, "_n", F.expr(f"_n div {length}").alias("_b"), k.alias("_k"), *stats)
    grow, fade = F.exp(F.col("_k") * F.lit(rate)), F.exp(-F.col("_k") * F.lit(rate))
    w = Window.partitionBy(*keys, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    own = part.withColumns({s: fade * F.sum(F.col(s) * grow).over(w) for s in stats})
    ends = own.filter(F.col("_k") == length - 1).select(*keys, F.col("_b").alias("_n"), *stats)
    if length * rate < 299.0 and length > 1:
        ends = affine_scan(ends, keys, stats, rate=rate * length, block=block)
    entering = ends.select(*keys, (F.col("_n") + 1).alias("_b"), *[F.col(s).alias(f"_in_{s}") for s in stats])
    rest = F.exp(-(F.col("_k") + 1) * F.lit(rate))
    whole = lambda s: (F.col(s) + F.coalesce(F.col(f"_in_{s}"), F.lit(0.0)) * rest).alias(s)
    return own.join(entering, [*keys, "_b"], "left").select(*keys, *carry, "_n", *[whole(s) for s in stats])


def herd_ema(
    batches: DataFrame,
    *,
    alpha: float = C.EMA_ALPHA,
    min_herd: int = C.MIN_HERD,
    cols: Sequence[str] = FEATURES,
    keys: Sequence[str] = ("flight_id",),
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
    scan_block: int = SCAN_BLOCK,
) -> DataFrame:
    """Exponential moving mean and variance of the herd at every keyframe, after its own update.

    Keyframes with fewer than ``min_herd`` tracks keep the state. The recursion
    m' = (1 - alpha) m + alpha x is affine, so updates are numbered per flight and scanned in blocks
    (``affine_scan``).
    """
    keys = list(keys)
    stats = [f"{p}_{c}" for p in ("mean", "var") for c in cols]
    q = 1.0 - float(alpha)
    counted = O.running_sum(
        O.seq_blocks(batches, seq, size=block),
        keys,
        [seq],
        {"n_updates": (F.col("n_tracks") >= min_herd).cast("int")},
    ).drop(O.BLK)
    updates = counted.filter(F.col("n_tracks") >= min_herd)
    if q <= 0:
        states = updates.select(*keys, "n_updates", *stats)
    else:
        weight = F.when(F.col("n_updates") == 1, F.lit(1.0)).otherwise(F.lit(float(alpha)))
        given = updates.select(
            *keys, "n_updates", (F.col("n_updates") - 1).alias("_n"), *[(weight * F.col(s)).alias(s) for s in stats]
        )
        states = affine_scan(given, keys, stats, rate=-math.log(q), carry=["n_updates"], block=scan_block).drop("_n")
    return counted.select(*keys, seq, "n_tracks", "n_updates").join(
        states, [*keys, "n_updates"], "left"
    )


def social_score(
    features: DataFrame,
    ema: DataFrame,
    *,
    min_updates: int = C.EMA_MIN_UPDATES,
    cols: Sequence[str] = FEATURES,
    keys: Sequence[str] = ("flight_id", "kf_seq"),
    out: str = "soc",
) -> DataFrame:
    """Diagonal Mahalanobis distance from the herd; 0 until the herd statistics are warm."""
    stats = [f"{p}_{c}" for p in ("mean", "var") for c in cols]
    df = features.join(ema.select(*keys, "n_updates", *stats), list(keys), "left")
    dist = motion.diag_mahalanobis(
        [F.col(c).cast("double") for c in cols],
        [F.col(f"mean_{c}") for c in cols],
        [F.col(f"var_{c}") for c in cols],
    )
    warm = F.coalesce(F.col("n_updates") >= min_updates, F.lit(False)) & F.col(f"mean_{cols[0]}").isNotNull()
    return df.withColumn(out, F.when(warm, dist).otherwise(F.lit(0.0))).drop("n_updates", *stats)


def feature_sequence(
    features: DataFrame,
    *,
    length: int = C.SEQUENCE_LENGTH,
    cols: Sequence[str] = FEATURES,
    keys: Sequence[str] = TRACK,
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
    out: str = "sequence",
) -> DataFrame:
    """The last ``length`` vectors of rows whose history is full; other rows drop out.

    History is full when ``length`` consecutive keyframes end at the row, because bridging leaves
    no holes inside a segment.
    """
    df = O.with_halo(features, seq, size=block, back=length - 1)
    w = O.block_window(keys, [seq]).rangeBetween(-(length - 1), 0)
    vec = F.array(*[F.col(c).cast("float") for c in cols])
    df = df.withColumn("_have", F.count(F.lit(1)).over(w))
    df = df.withColumn(out, F.collect_list(vec).over(w))
    return O.own_rows(df).filter(F.col("_have") == length).drop("_have")


def threshold_flags(
    ae: Column,
    soc: Column,
    *,
    ae_threshold: float = C.AE_THRESHOLD,
    social_threshold: float = C.SOCIAL_THRESHOLD,
    use_ae: bool = True,
    use_social: bool = True,
    require_both: bool = False,
) -> dict[str, Column]:
    """Strictly above the threshold, per scorer and combined; an unscored row is not flagged."""
    no = F.lit(False)
    ae_up = F.coalesce(ae > ae_threshold, no) if use_ae else no
    soc_up = F.coalesce(soc > social_threshold, no) if use_social else no
    return {
        "ae_up": ae_up,
        "soc_up": soc_up,
        "flagged": (ae_up & soc_up) if require_both else (ae_up | soc_up),
    }


def track_state(eligible: Column, ae_up: Column, soc_up: Column, confirmed: Column) -> Column:
    kind = F.when(ae_up & soc_up, F.lit("both")).when(ae_up, F.lit("ae")).otherwise(F.lit("soc"))
    return (
        F.when(~eligible, F.lit("unscored"))
        .when(~ae_up & ~soc_up, F.lit("ok"))
        .when(confirmed, F.concat(F.lit("confirmed_"), kind))
        .otherwise(F.concat(F.lit("elevated_"), kind))
    )


def smoothed_score(
    scored: DataFrame,
    *,
    length: int = C.SEQUENCE_LENGTH,
    window: int = C.SMOOTHING_WINDOW,
    scores: Sequence[str] = ("ae", "soc"),
    keys: Sequence[str] = TRACK,
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
    _keep_halo: int | None = None,
) -> DataFrame:
    """Mean of the last ``window`` scores of full histories, as ``<score>_smooth``; ``eligible``
    tells whether the row is scored at all. Means never reach across an absence."""
    df = O.with_halo(scored, seq, size=block, back=length + window - 2 + (_keep_halo or 0))
    w = O.block_window(keys, [seq])
    gap = F.coalesce(F.lag(seq).over(w) != F.col(seq) - 1, F.lit(True))
    df = df.withColumn("_gap", F.when(gap, F.col(seq)))
    df = df.withColumn("_seg", F.max("_gap").over(O.running(w)))
    ws = O.block_window(keys, [seq], "_seg")
    df = df.withColumn("eligible", F.row_number().over(ws) >= length)
    recent = ws.rowsBetween(-(window - 1), 0)
    df = df.withColumns(
        {
            f"{s}_smooth": F.when(
                F.col("eligible"), F.avg(F.when(F.col("eligible"), F.col(s))).over(recent)
            )
            for s in scores
        }
    ).drop("_gap", "_seg")
    return df if _keep_halo is not None else O.own_rows(df)


def score_states(
    scored: DataFrame,
    *,
    length: int = C.SEQUENCE_LENGTH,
    window: int = C.SMOOTHING_WINDOW,
    min_duration: int = C.MIN_ANOMALY_DURATION,
    ae_threshold: float = C.AE_THRESHOLD,
    social_threshold: float = C.SOCIAL_THRESHOLD,
    use_ae: bool = True,
    use_social: bool = True,
    require_both: bool = False,
    keys: Sequence[str] = TRACK,
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Smoothing, threshold flags, duration confirmation and state of every scored row.

    An anomaly is confirmed once it has lasted ``min_duration`` keyframes, i.e. when that many
    consecutive keyframes ending here are flagged. All look-backs are bounded, so one shuffle with
    one halo serves the whole chain.
    """
    df = smoothed_score(
        scored, length=length, window=window, keys=keys, seq=seq, block=block,
        _keep_halo=min_duration - 1,
    )
    df = df.withColumns(
        threshold_flags(
            F.col("ae_smooth"), F.col("soc_smooth"), ae_threshold=ae_threshold,
            social_threshold=social_threshold, use_ae=use_ae, use_social=use_social,
            require_both=require_both,
        )
    )
    w = O.block_window(keys, [seq]).rangeBetween(-(min_duration - 1), 0)
    df = df.withColumn("confirmed", F.sum(F.col("flagged").cast("int")).over(w) == min_duration)
    df = O.own_rows(df)
    return df.withColumn(
        "state",
        track_state(F.col("eligible"), F.col("ae_up"), F.col("soc_up"), F.col("confirmed")),
    )


def confirmed_flag(
    flags: DataFrame,
    *,
    min_duration: int = C.MIN_ANOMALY_DURATION,
    keys: Sequence[str] = TRACK,
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """``confirmed``: the last ``min_duration`` consecutive keyframes are all flagged."""
    df = O.with_halo(flags, seq, size=block, back=min_duration - 1)
    w = O.block_window(keys, [seq]).rangeBetween(-(min_duration - 1), 0)
    df = df.withColumn("confirmed", F.sum(F.col("flagged").cast("int")).over(w) == min_duration)
    return O.own_rows(df)


def anomaly_events(
    states: DataFrame,
    keyframes: DataFrame | None = None,
    *,
    min_duration: int = C.MIN_ANOMALY_DURATION,
    keys: Sequence[str] = TRACK,
    flight_keys: Sequence[str] = ("flight_id",),
    seq: str = "kf_seq",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Runs of consecutive flagged keyframes of a track, with their scores.

    ``mean_*`` follows the running-mean formula of the monitored system, which divides by the span
    of frame ids so far, ``avg_*`` is the plain average over keyframes. Closed events shorter than
    ``min_duration`` keyframes are dropped; one that reaches the flight's last keyframe is open.

    Runs are found per block of keyframe numbers. A run that touches a block border may continue
    on the other side; only those (at most two per block) are chained, so a track that is flagged
    for ever costs one chain row per block. The frame-span mean multiplies factors 1 - 1/n along
    the event; their running log-sum lets each block contribute one partial sum.
    """
    keys, flight_keys = list(keys), list(flight_keys)
    rows = O.seq_blocks(
        states.filter("flagged").select(
            *keys, seq, "frame_id", "ts_us", "ae_smooth", "soc_smooth", "ae_up", "soc_up"
        ),
        seq,
        size=block,
    )
    rows = rows.withColumn("_run", F.col(seq) - F.row_number().over(O.block_window(keys, [seq])))
    run = [*keys, O.BLK, "_run"]

    def chained(parts: DataFrame) -> DataFrame:
        """Event start (sequence number) of every run; runs off the borders stand alone."""
        at_edge = (F.pmod(F.col("_k0"), F.lit(block)) == 0) | (
            F.pmod(F.col("_k1"), F.lit(block)) == block - 1
        )
        parts = parts.withColumn("_edge", F.when(~at_edge, F.col(O.BLK)))
        w = Window.partitionBy(*keys, "_edge").orderBy("_k0")
        parts = parts.withColumn(
            "_first",
            F.when(
                F.coalesce(F.lag("_k1").over(w) != F.col("_k0") - 1, F.lit(True)), F.col("_k0")
            ),
        )
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        return parts.withColumn("_event", F.max("_first").over(so_far)).drop("_first")

    bounds = rows.groupBy(*run).agg(
        F.min(seq).alias("_k0"), F.max(seq).alias("_k1"), F.min("frame_id").alias("_f0")
    )
    starts = chained(bounds)
    ev = Window.partitionBy(*keys, "_edge", "_event")
    continued = (
        starts.withColumn("_start_frame", F.min("_f0").over(ev))
        .filter(F.col("_event") != F.col("_k0"))
        .select(*run, "_start_frame")
    )

    wr = Window.partitionBy(*run).orderBy(seq)
    rows = rows.withColumn("_local", F.min("frame_id").over(Window.partitionBy(*run)))
    rows = rows.join(continued, run, "left")
    n = F.col("frame_id") - F.coalesce(F.col("_start_frame"), F.col("_local")) + 1
    rows = rows.withColumn("_n", n.cast("double"))
    rows = rows.withColumn(
        "_log", F.sum(F.when(F.col("_n") > 1, F.log(1 - 1 / F.col("_n"))).otherwise(0.0)).over(
            wr.rowsBetween(Window.unboundedPreceding, 0))
    )
    share = F.exp(-F.col("_log")) / F.col("_n")
    parts = rows.groupBy(*run).agg(
        F.min(seq).alias("_k0"),
        F.max(seq).alias("_k1"),
        F.min("frame_id").alias("start_frame"),
        F.max("frame_id").alias("end_frame"),
        F.min("ts_us").alias("start_ts_us"),
        F.max("ts_us").alias("end_ts_us"),
        F.count(F.lit(1)).alias("_cnt"),
        F.bool_or("ae_up").alias("_ae"),
        F.bool_or("soc_up").alias("_soc"),
        F.min("_log").alias("_total"),
        *[
            e.alias(f"{p}_{s}")
            for s, col in (("ae", "ae_smooth"), ("social", "soc_smooth"))
            for p, e in (
                ("max", F.max(col)),
                ("sum", F.sum(col)),
                ("part", F.sum(F.col(col) * share)),
            )
        ],
    )
    parts = chained(parts)
    so_far = Window.partitionBy(*keys, "_edge", "_event").orderBy("_k0").rowsBetween(
        Window.unboundedPreceding, -1
    )
    parts = parts.withColumn("_enter", F.coalesce(F.sum("_total").over(so_far), F.lit(0.0)))
    means = []
    for s in ("ae", "social"):
        means.append(
            (F.exp(F.sum("_total")) * F.sum(F.exp(-F.col("_enter")) * F.col(f"part_{s}"))).alias(
                f"mean_{s}"
            )
        )
        means.append((F.sum(f"sum_{s}") / F.sum("_cnt")).alias(f"avg_{s}"))
        means.append(F.max(f"max_{s}").alias(f"max_{s}"))
    trigger = (
        F.when(F.bool_or("_ae") & F.bool_or("_soc"), F.lit("both"))
        .when(F.bool_or("_ae"), F.lit("ae"))
        .otherwise(F.lit("social"))
    )
    events = parts.groupBy(*keys, F.col("_event").alias("start_kf")).agg(
        F.max("_k1").alias("end_kf"),
        F.min("start_frame").alias("start_frame"),
        F.max("end_frame").alias("end_frame"),
        F.min("start_ts_us").alias("start_ts_us"),
        F.max("end_ts_us").alias("end_ts_us"),
        F.sum("_cnt").alias("keyframe_count"),
        trigger.alias("triggered_by"),
        *means,
    )
    events = events.withColumn("duration_us", F.col("end_ts_us") - F.col("start_ts_us"))
    last = (states if keyframes is None else keyframes).groupBy(*flight_keys).agg(
        F.max(seq).alias("_last")
    )
    return (
        events.join(last, flight_keys, "left")
        .withColumn("is_open", F.col("end_kf") == F.col("_last"))
        .drop("_last")
        .filter(F.col("is_open") | (F.col("keyframe_count") >= min_duration))
    )


def _in_states(prefix: str) -> Column:
    return F.col("state").startswith(prefix)


def frame_summary(
    states: DataFrame,
    frames: DataFrame | None = None,
    *,
    keys: Sequence[str] = ("flight_id", "frame_id"),
) -> DataFrame:
    """Visible tracks per frame and how many are elevated or confirmed.

    Every frame with a state has a row, also one whose tracks are all bridged; ``frames`` adds
    those without any state. They count 0.
    """
    seen = F.col("is_visible") if "is_visible" in states.columns else F.lit(True)
    rows = states.select(*keys, "state", seen.alias("_seen"))
    if frames is not None:
        bare = frames.select(*keys, F.lit("").alias("state"), F.lit(False).alias("_seen"))
        rows = rows.unionByName(bare)
    return rows.groupBy(*keys).agg(
        F.count_if("_seen").alias("tracks"),
        F.count_if(F.col("_seen") & _in_states("elevated")).alias("elevated"),
        F.count_if(F.col("_seen") & _in_states("confirmed")).alias("confirmed"),
    ).withColumn(
        "hud",
        F.format_string(
            C.SUMMARY_LINE,
            F.col(list(keys)[-1]), F.col("tracks"), F.col("elevated"), F.col("confirmed"),
        ),
    )


STATES = (
    "unscored", "ok", "elevated_ae", "elevated_soc", "elevated_both",
    "confirmed_ae", "confirmed_soc", "confirmed_both",
)


def ids_by_state(
    states: DataFrame, *, keys: Sequence[str] = ("flight_id", "frame_id"), frames: DataFrame | None = None
) -> DataFrame:
    """Sorted track ids per state, plus the tracks below each single threshold. One keyframe holds
    at most a tracker's worth of ids, which bounds the lists. ``frames`` adds those without any
    state, with empty lists."""
    if frames is not None:
        states = states.unionByName(frames.select(*keys), allowMissingColumns=True)

    def ids(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("track_id"))))

    scored = F.col("state") != "unscored"
    return states.groupBy(*keys).agg(
        *[ids(F.col("state") == s).alias(f"{s}_tracks") for s in STATES],
        ids(scored & ~F.col("ae_up")).alias("ok_ae_tracks"),
        ids(scored & ~F.col("soc_up")).alias("ok_soc_tracks"),
    )


def elevated_sets(states: DataFrame) -> DataFrame:
    """Membership of a row in the scorer sets: both, only one, or none."""
    ae, soc = F.col("ae_up"), F.col("soc_up")
    return states.withColumns({"both": ae & soc, "only_ae": ae & ~soc, "only_soc": soc & ~ae})


# state to drawing colour as text
COLOURS = {state: ",".join(map(str, bgr)) for state, bgr in C.STATE_COLOURS.items()}


def track_label(states: DataFrame) -> DataFrame:
    """Colour and text drawn next to a box."""
    colour = F.lit(COLOURS["unscored"])
    for s in ("ok", "elevated", "confirmed"):
        colour = F.when(_in_states(s), F.lit(COLOURS[s])).otherwise(colour)
    text = F.concat(
        F.lit("ID:"),
        F.col("track_id").cast("string"),
        F.coalesce(F.format_string(" ae=%.2f", F.col("ae_smooth")), F.lit("")),
        F.coalesce(F.format_string(" soc=%.2f", F.col("soc_smooth")), F.lit("")),
    )
    scored = F.col("state") != "unscored"
    return states.withColumns(
        {
            "colour": colour,
            "label": F.when(scored, text).otherwise(
                F.concat(F.lit("ID:"), F.col("track_id").cast("string"))
            ),
        }
    )
