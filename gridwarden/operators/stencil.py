"""Operators that need neighbours: gradients, slope, vorticity, vertical integrals.

A grid line (one time, one latitude or longitude) is a window partition; its length is bounded by the
number of cells along the other axis, whatever the number of times.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.constants import EARTH_RADIUS_M, GRAVITY
from gridwarden.functions.basic import flag, lit
from gridwarden.functions.physical import coriolis, vector_shear, wind_speed
from gridwarden.operators.grid import pivot_levels

CELL = ("latitude", "longitude")


def _difference(value: Column, over) -> Column:
    """Half the centred difference, or the one-sided difference at an edge."""
    before, after = F.lag(value).over(over), F.lead(value).over(over)
    has_before, has_after = F.lag(F.lit(1)).over(over).isNotNull(), F.lead(F.lit(1)).over(over).isNotNull()
    return (
        F.when(has_before & has_after, (after - before) / 2.0)
        .when(has_after, after - value)
        .when(has_before, value - before)
    )


def horizontal_gradient(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("time",)) -> DataFrame:
    """d/dy and d/dx in units per metre as ``<value>_dy`` and ``<value>_dx``."""
    along_lat = Window.partitionBy(*keys, "longitude").orderBy("latitude")
    along_lon = Window.partitionBy(*keys, "latitude").orderBy("longitude")
    dy = _difference(F.radians("latitude"), along_lat) * EARTH_RADIUS_M
    dx = _difference(F.radians("longitude"), along_lon) * EARTH_RADIUS_M * F.cos(F.radians("latitude"))
    steps = df.withColumns({"_dy": dy, **{f"_y_{v}": _difference(F.col(v), along_lat) for v in values}})
    steps = steps.withColumns({"_dx": dx, **{f"_x_{v}": _difference(F.col(v), along_lon) for v in values}})
    out = {}
    for v in values:
        out[f"{v}_dy"] = F.col(f"_y_{v}") / F.col("_dy")
        out[f"{v}_dx"] = F.col(f"_x_{v}") / F.col("_dx")
    return steps.withColumns(out).drop("_dy", "_dx", *[f"_{a}_{v}" for a in "xy" for v in values])


def slope_deg(df: DataFrame, elevation: str = "elevation_m", keys: Sequence[str] = ()) -> DataFrame:
    out = horizontal_gradient(df, [elevation], keys)
    slope = F.degrees(F.atan(F.hypot(f"{elevation}_dy", f"{elevation}_dx")))
    return out.withColumn("slope_deg", slope).drop(f"{elevation}_dy", f"{elevation}_dx")


def vorticity(df: DataFrame, u: str = "u850", v: str = "v850", keys: Sequence[str] = ("time",)) -> DataFrame:
    """Relative and absolute vorticity of a wind field."""
    out = horizontal_gradient(df, [u, v], keys)
    out = out.withColumn("relative_vorticity850", F.col(f"{v}_dx") - F.col(f"{u}_dy"))
    out = out.withColumn("absolute_vorticity850", F.col("relative_vorticity850") + coriolis("latitude"))
    return out.drop(*[f"{w}_d{a}" for w in (u, v) for a in "xy"])


def flux_divergence(df: DataFrame, u: str = "ivt_u", v: str = "ivt_v", keys: Sequence[str] = ("time",)) -> DataFrame:
    """Divergence of the vapour flux and its negative."""
    out = horizontal_gradient(df, [u, v], keys)
    out = out.withColumn("ivt_divergence", F.col(f"{u}_dx") + F.col(f"{v}_dy"))
    out = out.withColumn("ivt_convergence", -F.col("ivt_divergence"))
    return out.drop(*[f"{w}_d{a}" for w in (u, v) for a in "xy"])


def _air_layers(df: DataFrame, keys: Sequence[str], q: str, u: str, v: str) -> DataFrame:
    """Each level with its depth and the layer integrals up to the next level."""
    column = Window.partitionBy(*keys)
    upward = column.orderBy("level")
    pa = F.when(F.max("level").over(column) < 2000, F.col("level") * 100.0).otherwise(F.col("level").cast("double"))
    out = df.withColumns({"_p": pa, "_q": F.col(q), "_qu": F.col(q) * F.col(u), "_qv": F.col(q) * F.col(v)})
    depth = F.lead("_p").over(upward) - F.col("_p")
    parts = {f"{c}_layer": depth * (F.col(c) + F.lead(c).over(upward)) / 2.0 for c in ("_q", "_qu", "_qv")}
    return out.withColumns({"_depth": depth, **parts})


def _column_integral(c: str) -> Column:
    gap = F.max(F.col("_depth").isNotNull() & F.col(f"{c}_layer").isNull())
    return F.when(~gap, F.coalesce(F.sum(f"{c}_layer"), lit(0.0)) / GRAVITY)


def air_columns(
    df: DataFrame, keys: Sequence[str], picks: Mapping[str, tuple[str, int]] | None = None, q: str = "q", u: str = "u", v: str = "v"
) -> DataFrame:
    """Vapour integrals and any (variable, level) picks of each column of air, in one window and one aggregate.

    Both share the partitioning of the keys, so the level rows are shuffled once.
    """
    chosen = [F.max(F.when(F.col("level") == lev, F.col(var))).alias(n) for n, (var, lev) in (picks or {}).items()]
    out = _air_layers(df, keys, q, u, v).groupBy(*keys).agg(
        _column_integral("_qu").alias("ivt_u"), _column_integral("_qv").alias("ivt_v"), _column_integral("_q").alias("pwat"), *chosen
    )
    return out.withColumns({"ivt": F.hypot("ivt_u", "ivt_v"), "pwat": F.when(F.col("pwat").isNotNull(), F.greatest(lit(0.0), "pwat"))})


def vapor_integrals(df: DataFrame, keys: Sequence[str] = ("time", *CELL), q: str = "q", u: str = "u", v: str = "v") -> DataFrame:
    """Integrated vapour transport (components, magnitude) and precipitable water in one pass.

    Trapezoids over pressure; levels below 2000 are hPa. A missing layer makes the integral missing. The
    window holds the levels of one column of air.
    """
    return air_columns(df, keys, None, q, u, v)


def wind_picks(columns: Sequence[str]) -> dict[str, tuple[str, int]]:
    """(variable, level) picks the level indicators need."""
    wanted = {f"{w}{lev}": (w, lev) for lev in (925, 850, 300, 200) for w in ("u", "v")}
    wanted |= {"q925": ("q", 925), "q850": ("q", 850)}
    return wanted | ({"z500": ("z", 500)} if "z" in columns else {})


def level_indicators(df: DataFrame) -> DataFrame:
    """Winds, moisture transport, shear, height and flags from picked level columns."""
    out = df.withColumns(
        {
            "wind925_speed": wind_speed("u925", "v925"),
            "wind850_speed": wind_speed("u850", "v850"),
            "jet300_speed": wind_speed("u300", "v300"),
            "jet200_speed": wind_speed("u200", "v200"),
            "wind_shear_850_300": vector_shear("u850", "v850", "u300", "v300"),
            "wind_shear_850_200": vector_shear("u850", "v850", "u200", "v200"),
        }
    )
    more = {
        "moisture_transport925": F.col("q925") * F.col("wind925_speed"),
        "moisture_transport850": F.col("q850") * F.col("wind850_speed"),
        "low_level_jet_flag": flag("wind850_speed", 12.0),
        "strong_shear_flag": flag("wind_shear_850_200", 20.0),
    }
    if "z500" in df.columns:
        more["geopotential_height500"] = F.col("z500") / GRAVITY
    return out.withColumns(more)


def level_winds(df: DataFrame, keys: Sequence[str] = ("time", *CELL)) -> DataFrame:
    """Level indicators of each column of air, in one aggregate."""
    return level_indicators(pivot_levels(df, keys, wind_picks(df.columns)))
