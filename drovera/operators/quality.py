"""Input checks that a deployment runs before anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def aspect_ok(
    width: str = "orig_w", height: str = "orig_h", *, expected: float = C.ASPECT_RATIO,
    tolerance: float = C.ASPECT_TOLERANCE,
) -> Column:
    return F.abs(F.try_divide(F.col(width), F.col(height)) - F.lit(expected)) < tolerance


def aspect_ratio_check(
    frames: DataFrame, *, strict: bool = False, width: str = "orig_w", height: str = "orig_h"
) -> DataFrame:
    """Frames of the expected aspect ratio. ``strict`` fails the job on any other frame."""
    ok = F.coalesce(aspect_ok(width, height), F.lit(False))
    if strict:
        message = F.concat(F.lit("unexpected frame size "), F.col(width), F.lit("x"), F.col(height))
        return frames.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return frames.filter(ok)


def aspect_rejects(frames: DataFrame, *, width: str = "orig_w", height: str = "orig_h") -> DataFrame:
    """The complement: frames to quarantine."""
    return frames.filter(~F.coalesce(aspect_ok(width, height), F.lit(False)))


def sensor_aspect_ok(cameras: DataFrame, *, rel_tol: float = 1e-3, out: str = "aspect_ok") -> DataFrame:
    """Physical and pixel aspect ratios of a camera agree within a relative tolerance."""
    phys = F.try_divide("sensor_w_mm", "sensor_h_mm")
    pix = F.try_divide("sensor_w_px", "sensor_h_px")
    return cameras.withColumn(
        out, F.abs(phys - pix) <= rel_tol * F.greatest(F.abs(phys), F.abs(pix))
    )
