"""Ground resolution and WGS-84 geodesics as column expressions.

The geodesic direct and inverse problems follow Vincenty's published series (Survey Review, 1975).
Every step is its own column of a nested select, so that Catalyst keeps the chain in one
code-generated stage and evaluates each intermediate once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..settings import Camera

_A = C.WGS84_A
_F = C.WGS84_F
_B = _A * (1 - _F)


def ground_resolution(
    alt: Column,
    *,
    focal_mm: Column,
    sensor_w_mm: Column,
    sensor_w_px: Column,
    sensor_h_px: Column,
    image_w: Column,
    image_h: Column,
) -> Column:
    """Metres per pixel of a nadir pinhole camera, scaled to the output image."""
    return (
        (alt / focal_mm)
        * (sensor_w_mm / sensor_w_px)
        * F.least(sensor_w_px / image_w, sensor_h_px / image_h)
    )


def camera_resolution(alt: Column, camera: Camera, image_w: Column, image_h: Column) -> Column:
    return ground_resolution(
        alt,
        focal_mm=F.lit(float(camera.focal_mm)),
        sensor_w_mm=F.lit(float(camera.sensor_w_mm)),
        sensor_w_px=F.lit(float(camera.sensor_w_px)),
        sensor_h_px=F.lit(float(camera.sensor_h_px)),
        image_w=image_w,
        image_h=image_h,
    )


Steps = list[dict[str, str]]


def staged(df: DataFrame, steps: Steps, result: dict[str, str]) -> DataFrame:
    """Evaluate SQL expressions in stages, each seeing the columns of the earlier ones.

    The stages are nested selects, analysed a dozen at a time. Intermediate columns carry the
    prefix ``_g_`` and do not appear in the result.
    """
    kept = [f"`{c}`" for c in df.columns if c not in result]
    for at in range(0, len(steps), _DEPTH):
        sql = "SELECT * FROM {source}"
        for step in steps[at : at + _DEPTH]:
            sql = f"SELECT *, {', '.join(f'{e} AS _g_{n}' for n, e in step.items())} FROM ({sql})"
        df = df.sparkSession.sql(sql, source=df)
    return df.selectExpr(*kept, *[f"{e} AS `{n}`" for n, e in result.items()])


# nested selects per statement; the SQL parser recurses into them
_DEPTH = 12

_EP2 = (_A * _A - _B * _B) / (_B * _B)

# the two polynomials in u^2, and the correction of the angular distance
_BIG_A = "1 + _g_usq / 16384 * (4096 + _g_usq * (-768 + _g_usq * (320 - 175 * _g_usq)))"
_BIG_B = "_g_usq / 1024 * (256 + _g_usq * (-128 + _g_usq * (74 - 47 * _g_usq)))"


def _delta(ss: str, cs: str, c2: str) -> str:
    return (
        f"_g_B * {ss} * ({c2} + _g_B / 4 * ({cs} * (2 * {c2} * {c2} - 1) "
        f"- _g_B / 6 * {c2} * (4 * {ss} * {ss} - 3) * (4 * {c2} * {c2} - 3)))"
    )


def _longitude(sa: str, csq: str, sig: str, ss: str, cs: str, c2: str) -> str:
    c = f"({_F!r}D / 16 * {csq} * (4 + {_F!r}D * (4 - 3 * {csq})))"
    return (
        f"(1 - {c}) * {_F!r}D * {sa} * ({sig} + {c} * {ss} * "
        f"({c2} + {c} * {cs} * (2 * {c2} * {c2} - 1)))"
    )


def direct_steps(lat: str, bearing: str, distance_m: str, iterations: int) -> Steps:
    """Stages that end with the angular distance ``sig`` and its sine and cosine ``ss``, ``cs``."""
    steps = [
        {"al": f"radians({bearing})", "s": f"cast({distance_m} AS double)",
         "u": f"atan({1 - _F!r}D * tan(radians(`{lat}`)))"},
        {"su": "sin(_g_u)", "cu": "cos(_g_u)", "sa1": "sin(_g_al)", "ca1": "cos(_g_al)"},
        {"m": "atan2(_g_su / _g_cu, _g_ca1)", "sinal": "_g_cu * _g_sa1"},
        {"csq": "1 - _g_sinal * _g_sinal"},
        {"usq": f"_g_csq * {_EP2!r}D"},
        {"A": _BIG_A, "B": _BIG_B},
        {"sig0": f"_g_s / ({_B!r}D * _g_A)"},
    ]
    for i in range(iterations + 1):
        sig = f"_g_sig{i}"
        steps.append({f"c2{i}": f"cos(2 * _g_m + {sig})", f"ss{i}": f"sin({sig})", f"cs{i}": f"cos({sig})"})
        if i < iterations:
            steps.append(
                {f"sig{i + 1}": f"_g_sig0 + {_delta(f'_g_ss{i}', f'_g_cs{i}', f'_g_c2{i}')}"}
            )
    return steps


def direct_result(lon: str, out_lat: str, out_lon: str, iterations: int) -> dict[str, str]:
    k = iterations
    ss, cs = f"_g_ss{k}", f"_g_cs{k}"
    across = f"(_g_su * {ss} - _g_cu * {cs} * _g_ca1)"
    lat = (
        f"degrees(atan2(_g_su * {cs} + _g_cu * {ss} * _g_ca1, "
        f"{1 - _F!r}D * sqrt(_g_sinal * _g_sinal + {across} * {across})))"
    )
    lam = f"atan2({ss} * _g_sa1, _g_cu * {cs} - _g_su * {ss} * _g_ca1)"
    term = _longitude("_g_sinal", "_g_csq", f"_g_sig{k}", ss, cs, f"_g_c2{k}")
    return {out_lat: lat, out_lon: f"pmod(`{lon}` + degrees({lam} - {term}) + 180, 360D) - 180"}


def geodesic_direct(
    df: DataFrame,
    *,
    lat: str,
    lon: str,
    bearing: str,
    distance_m: str,
    out_lat: str,
    out_lon: str,
    iterations: int = 2,
) -> DataFrame:
    """Destination reached from (lat, lon) along ``bearing`` degrees after ``distance_m`` metres
    (both SQL expressions)."""
    return staged(
        df,
        direct_steps(lat, bearing, distance_m, iterations),
        direct_result(lon, out_lat, out_lon, iterations),
    )


def geodesic_inverse(
    df: DataFrame, *, lat1: str, lon1: str, lat2: str, lon2: str, out: str, iterations: int = 8
) -> DataFrame:
    """Ellipsoidal distance in metres. Coincident points give 0.

    The longitude iteration is unrolled; eight rounds settle below a micrometre except for nearly
    antipodal points, which no camera window spans.
    """
    steps: Steps = [
        {"L": f"radians(`{lon2}` - `{lon1}`)",
         "u1": f"atan({1 - _F!r}D * tan(radians(`{lat1}`)))",
         "u2": f"atan({1 - _F!r}D * tan(radians(`{lat2}`)))"},
        {"s1": "sin(_g_u1)", "c1": "cos(_g_u1)", "s2": "sin(_g_u2)", "c2": "cos(_g_u2)", "lam0": "_g_L"},
    ]
    for i in range(iterations):
        x, y = f"(_g_c2 * _g_sl{i})", f"(_g_c1 * _g_s2 - _g_s1 * _g_c2 * _g_cl{i})"
        ss, cs, sa, csq, mid = (f"_g_{n}{i}" for n in ("ss", "cs", "sa", "csq", "mid"))
        steps += [
            {f"sl{i}": f"sin(_g_lam{i})", f"cl{i}": f"cos(_g_lam{i})"},
            {f"ss{i}": f"sqrt({x} * {x} + {y} * {y})",
             f"cs{i}": f"_g_s1 * _g_s2 + _g_c1 * _g_c2 * _g_cl{i}"},
            {f"sig{i}": f"atan2({ss}, {cs})",
             f"sa{i}": f"CASE WHEN {ss} = 0 THEN 0D ELSE _g_c1 * _g_c2 * _g_sl{i} / {ss} END"},
            {f"csq{i}": f"1 - {sa} * {sa}"},
            {f"mid{i}": f"CASE WHEN {csq} <= 1e-15 THEN 0D ELSE {cs} - 2 * _g_s1 * _g_s2 / {csq} END"},
            {f"lam{i + 1}": f"_g_L + {_longitude(sa, csq, f'_g_sig{i}', ss, cs, mid)}"},
        ]
    k = iterations - 1
    steps += [{"usq": f"_g_csq{k} * {_EP2!r}D"}, {"A": _BIG_A, "B": _BIG_B}]
    delta = _delta(f"_g_ss{k}", f"_g_cs{k}", f"_g_mid{k}")
    dist = f"CASE WHEN _g_ss{k} = 0 THEN 0D ELSE {_B!r}D * _g_A * (_g_sig{k} - {delta}) END"
    return staged(df, steps, {out: dist})
