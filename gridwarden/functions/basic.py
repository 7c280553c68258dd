"""Small column helpers. Missing is NULL: NaN is turned into NULL where data enters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwarden.constants import FILL_MAGNITUDE, FILL_VALUES

Value = Column | str | float | int | None


def col(value: Value) -> Column:
    """Column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(None).cast("double") if value is None else F.lit(float(value))


def lit(value: float) -> Column:
    return F.lit(float(value))


def clamp(value: Value, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp to a range; a missing value becomes the lower bound."""
    x = col(value)
    return F.when(x.isNull(), lit(low)).otherwise(F.greatest(lit(low), F.least(lit(high), x)))


def clip(value: Value, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a range; a missing value stays missing."""
    x = col(value)
    out = x
    if high is not None:
        out = F.least(lit(high), out)
    if low is not None:
        out = F.greatest(lit(low), out)
    return F.when(x.isNotNull(), out)


def mask_range(value: Value, low: float | None = None, high: float | None = None) -> Column:
    """Values outside the range become NULL."""
    x = col(value)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (x >= low)
    if high is not None:
        keep = keep & (x <= high)
    return F.when(keep, x)


def usable(value: Value) -> Column:
    """NaN, infinities, fill sentinels and magnitudes of fill size become NULL."""
    x = col(value).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < FILL_MAGNITUDE) & ~x.isin(*FILL_VALUES), x)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def round_half_even(value: Value, digits: int) -> Column:
    return F.bround(col(value), digits)


def text(value: Value) -> Column:
    """Trimmed text; missing and the words nan, none and null become ''."""
    x = F.trim(F.coalesce(col(value).cast("string"), F.lit("")))
    return F.when(F.lower(x).isin("nan", "none", "null"), F.lit("")).otherwise(x)


def first_existing(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """The first of ``names`` present among ``columns``."""
    have = set(columns)
    return next((n for n in names if n in have), None)


def pick(df: DataFrame, *names: str, default: Value = None) -> Column:
    """Column of the first existing name as double, else the default."""
    name = first_existing(df.columns, names)
    return F.col(name).cast("double") if name else col(default)


def literal_map(table: Mapping[str, str]) -> Column:
    items: list[Column] = []
    for key, value in table.items():
        items += [F.lit(key), F.lit(value)]
    return F.create_map(*items)


def mean_present(*values: Value, default: float = 0.0) -> Column:
    """Mean of the values that are present, else the default."""
    present = F.filter(F.array(*[col(v) for v in values]), lambda v: v.isNotNull())
    total = F.aggregate(present, lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(present) > 0, total / F.size(present)).otherwise(lit(default))


def safe_ratio(numerator: Value, denominator: Value, eps: float = 1.0e-6) -> Column:
    d = col(denominator)
    return F.when(F.abs(d) > eps, col(numerator) / d)


def flag(value: Value, threshold: float, op: str = ">=") -> Column:
    """0/1 flag; a missing value is 0."""
    x = col(value)
    test = {">=": x >= threshold, ">": x > threshold, "<=": x <= threshold, "<": x < threshold}[op]
    return F.coalesce(test, F.lit(False)).cast("tinyint")


def to_unit(value: Value, source: str, target: str) -> Column:
    """Convert between the units the grids come in; equal units pass through."""
    if source == target:
        return col(value)
    x = col(value)
    rules = {("K", "degC"): x - 273.15, ("Pa", "hPa"): x / 100.0, ("m", "mm"): x * 1000.0}
    if (source, target) not in rules:
        raise ValueError(f"no rule from {source} to {target}")
    return rules[(source, target)]


def date_of(value: Value) -> Column:
    """DATE from a date, timestamp or text; NULL when it cannot be read."""
    return F.try_to_date(col(value).cast("string").substr(1, 10))


def check(ok: Column, value: Column, message: str) -> Column:
    """``value`` when ``ok`` holds, else the job fails with ``message``."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns whose expensive expressions are evaluated exactly once per row.

    A one-element explode is a step the optimizer does not merge with the projections above it, so the
    expressions are not copied into every place their column is used.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*df.columns, packed).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])
