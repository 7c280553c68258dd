"""Physical indicators as pure column expressions (JVM only, inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwarden.functions.basic import Value, clamp, clip, col, lit

# Fixed values: (scale, slope, offset) of the saturation vapour formula and its second variant.
TETENS = (0.6108, 17.27, 237.3)
MAGNUS = (1.0, 17.625, 243.04)


def sat_vapor_pressure_kpa(temp: Value, constants: tuple[float, float, float] = TETENS) -> Column:
    scale, slope, offset = constants
    t = col(temp)
    return lit(scale) * F.exp((lit(slope) * t) / (t + lit(offset)))


def rh_from_dewpoint(temp: Value, dewpoint: Value, constants: tuple[float, float, float] = TETENS) -> Column:
    """Relative humidity 0..100 from temperature and dewpoint."""
    es = F.greatest(sat_vapor_pressure_kpa(temp, constants), lit(1.0e-6))
    both = col(temp).isNotNull() & col(dewpoint).isNotNull()
    return F.when(both, clip(lit(100.0) * sat_vapor_pressure_kpa(dewpoint, constants) / es, 0.0, 100.0))


def vpd_kpa(temp: Value, rh: Value) -> Column:
    """Vapour pressure deficit, never negative; humidity is held to 0..100."""
    es = sat_vapor_pressure_kpa(temp)
    return F.when(col(temp).isNotNull() & col(rh).isNotNull(), F.greatest(lit(0.0), es - es * clip(rh, 0.0, 100.0) / 100.0))


def heat_index_c(temp: Value, rh: Value, variant: str = "daily") -> Column:
    """Heat index in degrees Celsius.

    ``daily``: humidity as is, temperatures below 80 F pass through. ``screening``: humidity held to
    0..100, temperatures below 26.7 C pass through. ``adjusted``: as daily with held humidity plus the
    corrections for very dry and very humid air.
    """
    t = col(temp)
    r = col(rh) if variant == "daily" else clip(rh, 0.0, 100.0)
    f = t * 9.0 / 5.0 + 32.0
    hot = (
        lit(-42.379)
        + 2.04901523 * f
        + 10.14333127 * r
        - 0.22475541 * f * r
        - 0.00683783 * f * f
        - 0.05481717 * r * r
        + 0.00122874 * f * f * r
        + 0.00085282 * f * r * r
        - 0.00000199 * f * f * r * r
    )
    if variant == "adjusted":
        dry = ((13.0 - r) / 4.0) * F.sqrt(F.greatest(17.0 - F.abs(f - 95.0), lit(0.0)) / 17.0)
        humid = ((r - 85.0) / 10.0) * ((87.0 - f) / 5.0)
        hot = (
            F.when((r < 13.0) & f.between(80.0, 112.0), hot - dry)
            .when((r > 85.0) & f.between(80.0, 87.0), hot + humid)
            .otherwise(hot)
        )
    if variant == "screening":
        return F.when(t.isNotNull() & r.isNotNull(), F.when(t < 26.7, t).otherwise((hot - 32.0) * 5.0 / 9.0))
    return F.when(f < 80.0, (f - 32.0) * 5.0 / 9.0).otherwise((hot - 32.0) * 5.0 / 9.0)


def apparent_temperature_c(temp: Value, rh: Value, wind: Value) -> Column:
    t = col(temp)
    vapour = (col(rh) / 100.0) * 6.105 * F.exp((17.27 * t) / (237.7 + t))
    return t + 0.33 * vapour - 0.7 * col(wind) - 4.0


def wet_bulb_c(temp: Value, rh: Value) -> Column:
    """Stull wet-bulb estimate."""
    t = col(temp)
    r = clip(rh, 0.0, 100.0)
    return (
        t * F.atan(0.151977 * F.sqrt(r + 8.313659))
        + F.atan(t + r)
        - F.atan(r - 1.676331)
        + 0.00391838 * F.pow(r, 1.5) * F.atan(0.023101 * r)
        - 4.686035
    )


def dewpoint_depression(temp: Value, dewpoint: Value) -> Column:
    return col(temp) - col(dewpoint)


def pwat_proxy(temp: Value, rh: Value, pressure_hpa: Value = 1010.0) -> Column:
    """Precipitable water estimate; a missing pressure counts as factor 1."""
    p = col(pressure_hpa)
    factor = F.when(p.isNull(), lit(1.0)).otherwise(clamp((p - 700.0) / 350.0, 0.5, 1.2))
    raw = 0.18 * (col(temp) + 5.0) * (col(rh) / 100.0) * factor
    return F.when(raw.isNotNull(), F.greatest(lit(0.0), raw))


def ivt_proxy(wind: Value, pwat: Value) -> Column:
    return clip(col(wind) * col(pwat) * 2.5, 0.0)


def cape_proxy(temp: Value, rh: Value) -> Column:
    return clip(col(temp) - 28.0, 0.0) * clip(col(rh) - 35.0, 0.0) * 6.0


def bowen_proxy(temp: Value, rh: Value) -> Column:
    raw = lit(0.3) + 2.2 * (1.0 - clamp(col(rh) / 100.0)) + clamp((col(temp) - 25.0) / 25.0, 0.0, 1.5)
    return F.when(col(temp).isNotNull() & col(rh).isNotNull(), F.greatest(lit(0.0), raw))


def net_radiation(shortwave: Value, longwave: Value = None, albedo: float = 0.23) -> Column:
    return (1.0 - albedo) * col(shortwave) + F.coalesce(col(longwave), lit(-80.0))


def precip_anomaly(observed: Value, climatology: Value) -> Column:
    return col(observed) - col(climatology)


def precip_flag(amount: Value, heavy: float = 25.0, extreme: float = 50.0) -> Column:
    """0 below heavy, 1 heavy, 2 extreme, NULL when missing."""
    x = col(amount)
    return F.when(x >= extreme, lit(2.0)).when(x >= heavy, lit(1.0)).when(x.isNotNull(), lit(0.0))


def wind_speed(u: Value, v: Value) -> Column:
    return F.hypot(col(u), col(v))


def speed_shear(upper: Value, lower: Value) -> Column:
    return F.abs(col(upper) - col(lower))


def vector_shear(u_low: Value, v_low: Value, u_high: Value, v_high: Value) -> Column:
    return F.hypot(col(u_high) - col(u_low), col(v_high) - col(v_low))


def convective_ratio(convective: Value, total: Value, form: str = "masked") -> Column:
    """Convective share 0..1; ``masked`` needs a total above 0.1 mm, ``epsilon`` pads the total."""
    c, t = col(convective), col(total)
    if form == "epsilon":
        return clip(c / (t + 1.0e-6), 0.0, 1.0)
    return F.when(t > 0.1, clip(c / t, 0.0, 1.0))


def coriolis(latitude: Value) -> Column:
    return 2.0 * 7.2921159e-5 * F.sin(F.radians(col(latitude)))


def flash_flood_score(p1: Value, p6: Value, p24: Value, slope: Value = None, soil: Value = None, impervious: Value = None) -> Column:
    def or_default(x: Value, d: float) -> Column:
        return F.coalesce(col(x), lit(d))

    rain = F.greatest(or_default(p1, 0.0) / 35.0, or_default(p6, 0.0) / 80.0, or_default(p24, 0.0) / 140.0)
    ground = (
        0.20 * clamp(or_default(slope, 5.0) / 25.0)
        + 0.20 * clamp(or_default(soil, 0.25))
        + 0.15 * clamp(or_default(impervious, 0.15))
    )
    return clamp(0.75 * rain + ground)


def dust_score(wind: Value, gust: Value = None, soil: Value = None, vegetation: Value = None, visibility: Value = None) -> Column:
    w = F.coalesce(col(wind), lit(0.0))
    blown = F.greatest(w / 16.0, F.coalesce(col(gust), w) / 22.0)
    bare = 0.35 * (1.0 - clamp(F.coalesce(col(soil), lit(0.15)) / 0.35)) + 0.25 * (
        1.0 - clamp(F.coalesce(col(vegetation), lit(0.2)) / 0.45)
    )
    seen = 0.20 * (1.0 - clamp(F.coalesce(col(visibility), lit(20.0)) / 10.0))
    return clamp(0.65 * blown + bare + seen)


def dry_heat_score(temp: Value, rh: Value, wind: Value = None, vegetation: Value = None) -> Column:
    """0 when temperature or humidity is missing."""
    score = clamp(
        0.45 * clamp((col(temp) - 35.0) / 12.0)
        + 0.45 * clamp(vpd_kpa(temp, rh) / 5.0)
        + 0.15 * clamp(F.coalesce(col(wind), lit(0.0)) / 10.0)
        + 0.15 * (1.0 - clamp(F.coalesce(col(vegetation), lit(0.25)) / 0.5))
    )
    return F.when(col(temp).isNotNull() & col(rh).isNotNull(), score).otherwise(lit(0.0))


def dust_risk_proxy(wind: Value, aod: Value, surface_mass: Value) -> Column:
    """Weighted sum of three tests, at most 1; a missing input fails its test."""

    def step(test: Column, weight: float) -> Column:
        return F.when(test, lit(weight)).otherwise(lit(0.0))

    total = step(col(wind) >= 8.0, 0.4) + step(col(aod) >= 0.3, 0.3) + step(col(surface_mass) >= 5.0e-4, 0.3)
    return F.least(lit(1.0), total)
