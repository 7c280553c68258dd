"""Queries of neighbour and vertical operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import stencil as st
from gridwarden.workload.registry import query, r

SLOPES = """s AS (SELECT *, lag({0}) OVER y AS ya, lead({0}) OVER y AS yb, lag({0}) OVER x AS xa, lead({0}) OVER x AS xb,
  lag(latitude) OVER y AS la, lead(latitude) OVER y AS lb, lag(longitude) OVER x AS oa, lead(longitude) OVER x AS ob
  FROM field WINDOW y AS (PARTITION BY sheet, longitude ORDER BY latitude), x AS (PARTITION BY sheet, latitude ORDER BY longitude)),
g AS (SELECT sheet, latitude, longitude, {0} AS z,
  CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN (yb - ya) / radians(lb - la) WHEN lb IS NOT NULL THEN (yb - {0}) / radians(lb - latitude)
    WHEN la IS NOT NULL THEN ({0} - ya) / radians(latitude - la) END / 6371e3 AS gy,
  CASE WHEN oa IS NOT NULL AND ob IS NOT NULL THEN (xb - xa) / radians(ob - oa) WHEN ob IS NOT NULL THEN (xb - {0}) / radians(ob - longitude)
    WHEN oa IS NOT NULL THEN ({0} - xa) / radians(longitude - oa) END / 6371e3 / cos(radians(latitude)) AS gx FROM s)"""


@query(
    "slope_deg",
    ("field",),
    f"WITH {SLOPES.format('elevation_m')} SELECT sheet, latitude, longitude, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope_deg FROM g",
)
def _(t):
    return st.slope_deg(t.field, keys=["sheet"]).select("sheet", "latitude", "longitude", r("slope_deg").alias("slope_deg"))


@query(
    "horizontal_gradient",
    ("field",),
    f"WITH {SLOPES.format('elevation_m')} SELECT sheet, latitude, longitude, round(1e3 * gy, 6) AS dy, round(1e3 * gx, 6) AS dx FROM g",
)
def _(t):
    out = st.horizontal_gradient(t.field, ["elevation_m"], ["sheet"])
    return out.select("sheet", "latitude", "longitude", r(F.col("elevation_m_dy") * 1e3).alias("dy"), r(F.col("elevation_m_dx") * 1e3).alias("dx"))


def _two(body: str) -> str:
    v = SLOPES.format("v").replace("s AS (", "sv AS (").replace("FROM s)", "FROM sv)").replace("g AS (", "gv AS (")
    u = SLOPES.format("u").replace("s AS (", "su AS (").replace("FROM s)", "FROM su)").replace("g AS (", "gu AS (")
    return f"WITH {v}, {u} {body} FROM gv JOIN gu ON gv.sheet = gu.sheet AND gv.latitude = gu.latitude AND gv.longitude = gu.longitude"


@query(
    "vorticity",
    ("field",),
    _two(
        "SELECT gv.sheet, gv.latitude, gv.longitude, round(1e5 * (gv.gx - gu.gy), 6) AS relative, "
        "round(1e5 * (gv.gx - gu.gy + 2 * 72921159e-12 * sin(radians(gv.latitude))), 6) AS absolute"
    ),
)
def _(t):
    out = st.vorticity(t.field, "u", "v", ["sheet"])
    rel, abso = r(F.col("relative_vorticity850") * 1e5), r(F.col("absolute_vorticity850") * 1e5)
    return out.select("sheet", "latitude", "longitude", rel.alias("relative"), abso.alias("absolute"))


@query(
    "flux_divergence",
    ("field",),
    _two("SELECT gv.sheet, gv.latitude, gv.longitude, round(1e5 * (gu.gx + gv.gy), 6) AS divergence, round(-1e5 * (gu.gx + gv.gy), 6) AS convergence"),
)
def _(t):
    out = st.flux_divergence(t.field, "u", "v", ["sheet"])
    return out.select("sheet", "latitude", "longitude", r(F.col("ivt_divergence") * 1e5).alias("divergence"), r(F.col("ivt_convergence") * 1e5).alias("convergence"))


@query(
    "vapor_integrals",
    ("profiles",),
    """WITH l AS (SELECT profile, level * 1e2 AS p, q, q * u AS qu, q * v AS qv FROM profiles),
    d AS (SELECT profile, lead(p) OVER w - p AS dp, (q + lead(q) OVER w) / 2e0 AS q, (qu + lead(qu) OVER w) / 2e0 AS qu, (qv + lead(qv) OVER w) / 2e0 AS qv
      FROM l WINDOW w AS (PARTITION BY profile ORDER BY p)),
    i AS (SELECT profile, coalesce(sum(dp * q), 0) / 980665e-5 AS pwat, coalesce(sum(dp * qu), 0) / 980665e-5 AS fu, coalesce(sum(dp * qv), 0) / 980665e-5 AS fv FROM d GROUP BY 1)
    SELECT profile, round(pwat, 5) AS pwat, round(fu, 5) AS ivt_u, round(fv, 5) AS ivt_v, round(sqrt(fu * fu + fv * fv), 5) AS ivt FROM i""",
)
def _(t):
    out = st.vapor_integrals(t.profiles, ["profile"])
    return out.select("profile", *[r(c, 5).alias(c) for c in ("pwat", "ivt_u", "ivt_v", "ivt")])


@query(
    "level_winds",
    ("profiles",),
    """WITH p AS (SELECT profile, max(CASE WHEN level = 925 THEN u END) AS u9, max(CASE WHEN level = 925 THEN v END) AS v9, max(CASE WHEN level = 925 THEN q END) AS q9,
      max(CASE WHEN level = 850 THEN u END) AS u8, max(CASE WHEN level = 850 THEN v END) AS v8, max(CASE WHEN level = 850 THEN q END) AS q8,
      max(CASE WHEN level = 300 THEN u END) AS u3, max(CASE WHEN level = 300 THEN v END) AS v3, max(CASE WHEN level = 200 THEN u END) AS u2,
      max(CASE WHEN level = 200 THEN v END) AS v2, max(CASE WHEN level = 500 THEN z END) AS z5 FROM profiles GROUP BY 1)
    SELECT profile, round(sqrt(u9 * u9 + v9 * v9), 6) AS wind925_speed, round(sqrt(u8 * u8 + v8 * v8), 6) AS wind850_speed,
      round(sqrt(u3 * u3 + v3 * v3), 6) AS jet300_speed, round(sqrt(u2 * u2 + v2 * v2), 6) AS jet200_speed,
      round(sqrt((u3 - u8) * (u3 - u8) + (v3 - v8) * (v3 - v8)), 6) AS wind_shear_850_300, round(sqrt((u2 - u8) * (u2 - u8) + (v2 - v8) * (v2 - v8)), 6) AS wind_shear_850_200,
      round(q9 * sqrt(u9 * u9 + v9 * v9), 6) AS moisture_transport925, round(q8 * sqrt(u8 * u8 + v8 * v8), 6) AS moisture_transport850,
      round(z5 / 980665e-5, 5) AS geopotential_height500, CASE WHEN sqrt(u8 * u8 + v8 * v8) >= 12 THEN 1 ELSE 0 END AS low_level_jet_flag,
      CASE WHEN sqrt((u2 - u8) * (u2 - u8) + (v2 - v8) * (v2 - v8)) >= 20 THEN 1 ELSE 0 END AS strong_shear_flag FROM p""",
)
def _(t):
    out = st.level_winds(t.profiles, ["profile"])
    speeds = ("wind925_speed", "wind850_speed", "jet300_speed", "jet200_speed", "wind_shear_850_300", "wind_shear_850_200")
    speeds += ("moisture_transport925", "moisture_transport850")
    flags = ("low_level_jet_flag", "strong_shear_flag")
    return out.select(
        "profile", *[r(c).alias(c) for c in speeds], r("geopotential_height500", 5).alias("geopotential_height500"), *[F.col(c).cast("int").alias(c) for c in flags]
    )
