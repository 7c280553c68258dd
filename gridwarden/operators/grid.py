"""Grid shaping: cells, cropping, coordinate repair, regridding, level and variable merging.

A grid is a long table, one row per (time, latitude, longitude[, level]).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.constants import (
    DOMAIN_BOX,
    GRID_STEP,
    LATITUDE_NAMES,
    LEVEL_NAMES,
    LONGITUDE_NAMES,
    TIME_NAMES,
    VARIABLE_NAMES,
)
from gridwarden.functions.basic import Value, check, col, first_existing, float_columns, literal_map, usable
from gridwarden.session import cut_lineage

Box = tuple[float, float, float, float]


def axis_size(start: float, stop: float, step: float) -> int:
    return int(round((stop - start) / step)) + 1


def standard_grid(
    spark: SparkSession, box: Box = DOMAIN_BOX, step: float = GRID_STEP, prefix: str = "cell", trim_multiple: int = 1
) -> DataFrame:
    """All cells of a box, as one distributed range (no cross join).

    ``trim_multiple`` shortens both axes to a multiple, as patch-based models need.
    """
    rows = axis_size(box[0], box[2], step) // trim_multiple * trim_multiple
    cols = axis_size(box[1], box[3], step) // trim_multiple * trim_multiple
    cell = spark.range(rows * cols)
    return cell.select(
        F.round(F.lit(box[0]) + F.floor(F.col("id") / cols) * step, 10).alias("latitude"),
        F.round(F.lit(box[1]) + (F.col("id") % cols) * step, 10).alias("longitude"),
    ).select(cell_id("latitude", "longitude", prefix).alias("grid_id"), "latitude", "longitude")


def cell_id(lat: Value, lon: Value, prefix: str = "cell", digits: int = 1) -> Column:
    both = col(lat).isNotNull() & col(lon).isNotNull()
    return F.when(both, F.format_string(f"{prefix}_%.{digits}f_%.{digits}f", col(lat), col(lon)))


def crop(df: DataFrame, box: Box = DOMAIN_BOX, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Inclusive box filter; written before any join so that it reaches the scan."""
    return df.filter(F.col(lat).between(box[0], box[2]) & F.col(lon).between(box[1], box[3]))


def normalize_coords(df: DataFrame, box: Box = DOMAIN_BOX, wrap: str = "signed") -> DataFrame:
    """Rename coordinate aliases, undo swapped axes, wrap longitudes.

    ``signed`` moves longitudes above 180 to -180..180; ``positive`` moves negative ones to 0..360. The
    swap test needs the coordinate ranges: a one-row aggregate that is part of the plan, so nothing runs before the result is asked for.
    """
    renames = {}
    for target, names in (
        ("latitude", LATITUDE_NAMES),
        ("longitude", LONGITUDE_NAMES),
        ("time", TIME_NAMES),
        ("level", LEVEL_NAMES),
    ):
        found = first_existing([c.lower() for c in df.columns], [n.lower() for n in names])
        if found:
            actual = next(c for c in df.columns if c.lower() == found)
            if actual != target:
                renames[actual] = target
    out = df.withColumnsRenamed(renames)
    if "latitude" not in out.columns or "longitude" not in out.columns:
        return out
    ranges = out.agg(
        F.min("latitude").alias("a"), F.max("latitude").alias("b"), F.min("longitude").alias("c"), F.max("longitude").alias("d")
    )
    ranges = ranges.select(F.lit(1).alias("_one"), F.coalesce(_looks_swapped(box), F.lit(False)).alias("_swapped"))
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(ranges), "_one")
    crossed = {"latitude": "longitude", "longitude": "latitude"}
    out = out.select(*[F.when(F.col("_swapped"), F.col(crossed[c])).otherwise(F.col(c)).alias(c) if c in crossed else c for c in out.columns if c not in ("_one", "_swapped")])
    lon = F.col("longitude")
    if wrap == "positive":
        wrapped = F.when(lon < 0, F.pmod(lon, F.lit(360.0))).otherwise(lon)
    else:
        wrapped = F.when(lon > 180.0, F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).otherwise(lon)
    return out.withColumn("longitude", wrapped)


def _looks_swapped(box: Box) -> Column:
    """From the ranges a..b of latitudes and c..d of longitudes: they miss the box, and fit it the other way round."""

    def overlaps(low: str, high: str, a: float, b: float) -> Column:
        return (F.col(low) <= b) & (F.col(high) >= a)

    fits = overlaps("a", "b", box[0], box[2]) & overlaps("c", "d", box[1], box[3])
    return ~fits & overlaps("a", "b", box[1], box[3]) & overlaps("c", "d", box[0], box[2])


def sanitize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill values, NaN and infinities become NULL in the given (default: all floating) columns."""
    return df.withColumns({c: usable(c) for c in (columns or float_columns(df))})


def axis_index(value: Value, start: float, step: float) -> Column:
    """Nearest index on a regular axis."""
    return F.round((col(value) - start) / step).cast("int")


def regrid_nearest(
    source: DataFrame,
    target: DataFrame,
    values: Sequence[str],
    origin: tuple[float, float],
    step: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Value of the nearest source cell per target cell, by index arithmetic and one equi-join.

    ``origin`` is the source grid's first latitude and longitude. Targets beyond the source grid get NULL.
    """
    src = source.select(
        *keys, axis_index("latitude", origin[0], step).alias("_i"), axis_index("longitude", origin[1], step).alias("_j"), *values
    )
    cells = target.withColumns({"_i": axis_index("latitude", origin[0], step), "_j": axis_index("longitude", origin[1], step)})
    on = ["_i", "_j", *[k for k in keys if k in target.columns]]
    return cells.join(src, on, "left").drop("_i", "_j")


def regrid_bilinear(
    source: DataFrame,
    target: DataFrame,
    values: Sequence[str],
    origin: tuple[float, float],
    step: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Linear interpolation in latitude and longitude.

    Only corners with a weight above zero count, so a target on a grid node needs just that node; a
    missing corner with weight gives NULL. Each target row becomes at most four keyed rows, meets the
    source by equi-join, and the weighted parts are summed (with partial sums before the shuffle).
    """
    shared = [k for k in keys if k in target.columns]
    own = [k for k in keys if k not in target.columns]
    y = F.round((F.col("latitude") - origin[0]) / step, 9)
    x = F.round((F.col("longitude") - origin[1]) / step, 9)
    fy, fx = y - F.floor(y), x - F.floor(x)
    corners = F.array(
        *[
            F.struct(
                (F.floor(y) + i).cast("int").alias("_i"),
                (F.floor(x) + j).cast("int").alias("_j"),
                ((fy if i else 1.0 - fy) * (fx if j else 1.0 - fx)).alias("_w"),
            )
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    wanted = target.select("latitude", "longitude", *shared, F.explode(F.filter(corners, lambda c: c["_w"] > 0)).alias("_c"))
    wanted = wanted.select("latitude", "longitude", *shared, "_c.*")
    src = source.select(
        *keys, axis_index("latitude", origin[0], step).alias("_i"), axis_index("longitude", origin[1], step).alias("_j"), *values
    )
    joined = wanted.join(src, ["_i", "_j", *shared], "inner" if own else "left")
    out = joined.groupBy("latitude", "longitude", *keys).agg(
        F.sum("_w").alias("_weight"),
        *[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values],
        *[F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"_w_{v}") for v in values],
    )
    full = {v: F.when(F.col(f"_w_{v}") > 1.0 - 1.0e-9, F.col(v)) for v in values}
    return out.withColumns(full).drop("_weight", *[f"_w_{v}" for v in values])


def regrid_patch(
    source: DataFrame,
    values: Sequence[str],
    origin: tuple[float, float],
    step: float,
    box: Box = DOMAIN_BOX,
    target_step: float = GRID_STEP,
    multiple: int = 4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Bilinear values on a grid whose axes are trimmed to a multiple; ``lat_index`` counts from the north."""
    spark = source.sparkSession
    rows = axis_size(box[0], box[2], target_step) // multiple * multiple
    target = standard_grid(spark, box, target_step, trim_multiple=multiple).drop("grid_id")
    out = regrid_bilinear(crop(source, _padded(box, step)), target, values, origin, step, keys)
    return out.withColumn("lat_index", F.lit(rows - 1) - axis_index("latitude", box[0], target_step))


def _padded(box: Box, step: float) -> Box:
    return (box[0] - step, box[1] - step, box[2] + step, box[3] + step)


def select_level(df: DataFrame, level: int) -> DataFrame:
    return df.filter(F.col("level") == level).drop("level")


def pivot_levels(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Several (variable, level) pairs to columns in one aggregate."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col("level") == level, F.col(var))).alias(name) for name, (var, level) in wanted.items()]
    )


def merge_levels(primary: DataFrame, supplement: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Union of two level sets; where both hold a level the primary wins.

    One aggregate with partial combine: the smallest (priority, values) per key, no window over raw rows.
    """
    both = primary.select(*keys, *values, F.lit(0).alias("_p")).unionByName(supplement.select(*keys, *values, F.lit(1).alias("_p")))
    return both.groupBy(*keys).agg(F.min_by(F.struct(*values), "_p").alias("_v")).select(*keys, "_v.*")


def merge_variables(
    primary: DataFrame, supplement: DataFrame, keys: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """Full outer join on the keys; each variable falls back to the supplement. Required ones must exist."""
    names = [c for c in primary.columns if c not in keys] + [
        c for c in supplement.columns if c not in keys and c not in primary.columns
    ]
    missing = [r for r in required if r not in names]
    if missing:
        raise KeyError(f"required variables are missing: {missing}")
    left = primary.withColumnsRenamed({c: f"_p_{c}" for c in primary.columns if c not in keys})
    right = supplement.withColumnsRenamed({c: f"_s_{c}" for c in supplement.columns if c not in keys})
    joined = left.join(right, list(keys), "full")

    def value(name: str) -> Column:
        parts = [f"{side}{name}" for side in ("_p_", "_s_") if f"{side}{name}" in joined.columns]
        return F.coalesce(*[F.col(p) for p in parts]).alias(name)

    return joined.select(*keys, *[value(n) for n in names])


def nearest_point(
    grid: DataFrame, points: DataFrame, origin: tuple[float, float], step: float, size: tuple[int, int], keys: Sequence[str] = ()
) -> DataFrame:
    """The grid cell nearest to each point, with all its values.

    Points are snapped to the index of a regular grid (held to its edges), so many points cost one
    equi-join. Point columns keep their names; cell coordinates come as cell_latitude, cell_longitude.
    """

    def snapped(value: str, start: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), axis_index(value, start, step)))

    left = points.withColumns({"_i": snapped("latitude", origin[0], size[0]), "_j": snapped("longitude", origin[1], size[1])})
    right = grid.withColumns(
        {"_i": axis_index("latitude", origin[0], step), "_j": axis_index("longitude", origin[1], step)}
    ).withColumnsRenamed({"latitude": "cell_latitude", "longitude": "cell_longitude"})
    joined = left.join(right, ["_i", "_j", *keys], "left").drop("_i", "_j")
    return joined.withColumn("grid_id", cell_id("cell_latitude", "cell_longitude"))


def hottest_point(df: DataFrame, variable: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Cell with the largest value per day; missing counts as lowest, ties go to the first in grid order.

    The largest value, the first latitude and the first longitude of a day are found one after the other by aggregates of
    numbers, which need no sort; only rows of the cell found are gathered whole.
    """
    others = [c for c in df.columns if c not in by]
    lowest = F.lit(float("-inf"))
    rank = {"_v": F.col(variable), "_a": -F.col("latitude"), "_b": -F.col("longitude")}
    # days compare as structs, in which nulls are equal
    rows = df.withColumns({"_g": F.struct(*[F.col(c) for c in by]), **{n: F.coalesce(c.cast("double"), lowest) for n, c in rank.items()}})
    known, found = ["_g"], None
    for n in rank:
        left = rows if found is None else rows.join(found, known)
        found = cut_lineage(left.groupBy(*known).agg(F.max(n).alias(n)), "hottest")
        known.append(n)
    cells = rows.join(found, known).groupBy("_g").agg(F.first(F.struct(*others)).alias("_r"))
    return cells.select(*[F.col(f"_g.{c}").alias(c) for c in by], "_r.*")


def fields_to_grid(fields: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Parallel value and cell arrays to one row per (valid_time, cell) with a column per variable."""
    cell = fields.select(
        normalize_variable("variable").alias("variable"), "valid_time", F.explode(F.arrays_zip("values", "grid")).alias("_z")
    ).select("variable", "valid_time", F.col("_z.grid.lat").alias("latitude"), F.col("_z.grid.lon").alias("longitude"), usable("_z.values").alias("value"))
    return cell.groupBy("valid_time", "latitude", "longitude").pivot("variable", list(variables)).agg(F.max("value"))


def normalize_variable(value: Value) -> Column:
    """Canonical variable name, or the name itself when it has no alias."""
    return F.coalesce(F.try_element_at(literal_map(VARIABLE_NAMES), col(value)), col(value))


def flatten_daily(df: DataFrame, values: Sequence[str], how: str = "first", prefix: str = "cell") -> DataFrame:
    """One row per (date, cell): the first time slice of the day, or the maximum over the day."""
    keyed = df.withColumn("date", F.to_date("time"))
    if how == "first":
        rows = keyed.groupBy("date", "latitude", "longitude").agg(F.min_by(F.struct(*values), "time").alias("_v"))
        rows = rows.select("date", "latitude", "longitude", "_v.*")
    else:
        rows = keyed.groupBy("date", "latitude", "longitude").agg(*[F.max(v).alias(v) for v in values])
    return rows.withColumn("grid_id", cell_id("latitude", "longitude", prefix, 4))


def first_finite_slice(df: DataFrame, value: str, axis: str, by: Sequence[str]) -> DataFrame:
    """Keep, per group, the first slice along an extra axis that has any value (else the first slice)."""
    slices = df.groupBy(*by, axis).agg(F.count(value).alias("_n"))
    chosen = slices.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("_n") > 0, F.col(axis))), F.min(axis)).alias(axis)
    )
    return df.join(chosen, [*by, axis], "left_semi")


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{what} is missing columns: {missing}")


def require_valid_date(df: DataFrame, name: str = "date", what: str = "table") -> DataFrame:
    """Dates as DATE; an unreadable one fails the job when it is met, without a pass of its own."""
    from gridwarden.functions.basic import date_of

    parsed = date_of(name)
    return df.withColumn(name, check(parsed.isNotNull(), parsed, f"{what} contains invalid '{name}' values"))


