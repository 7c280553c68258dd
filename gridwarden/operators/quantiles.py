"""Exact grouped quantiles by bracketing sketches.

One aggregate gives every group a mergeable rank sketch of each value column, combined map-side. A sketch knows the value at
any rank up to a stated share of the group, so two of its values bracket a wanted rank for certain. In a second pass
only the values inside the bracket move, and the count of those beyond it on the nearer side; their running counts give the
value at the rank. A group of any size is treated alike: the bracket of a small one holds a few values, that of a
large one a small share of it, which is counted per value and spread over tasks before it is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.session import cut_lineage

#: The sketch errs by at most one part in so many of a group's ranks.
ACCURACY = 2000
#: Distances from the wanted share at which sketch values are asked for.
_STEPS = (0.0025, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35)


def _bracket(values: Column, p: float, n: Column) -> tuple[Column, Column]:
    """Least and largest value that can have the wanted rank; NULL for no bound.

    ``values`` are sketch values at p - step and p + step for each step. The distance must be worth the sketch's error
    twice and two ranks more, for rounding.
    """
    low = high = F.lit(None).cast("double")
    for i, step in reversed(list(enumerate(_STEPS))):
        wide = F.lit(step) >= 2.0 / ACCURACY + 2.0 / F.greatest(n, F.lit(1))
        low = F.when(wide, values[2 * i] if p - step > 0 else F.lit(None)).otherwise(low)
        high = F.when(wide, values[2 * i + 1] if p + step < 1 else F.lit(None)).otherwise(high)
    return low, high


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """Linear-interpolated quantiles per group, one column ``<name>_p<percent>`` each; missing values and NaN skipped.

    A null key is a group like any other. A group without a value for a name has null there, also if it has no value at
    all; without keys an empty input gives no row.
    """
    value = {n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in wanted}
    rows = df.select(F.struct(*[F.col(k) for k in keys]).alias("_g") if keys else F.lit(0).alias("_g"), *[c.alias(n) for n, c in value.items()])
    targets = [(name, float(p)) for name in wanted for p in wanted[name]]
    sketches = []
    for i, (name, p) in enumerate(targets):
        asked = [min(1.0, max(0.0, x)) for step in _STEPS for x in (p - step, p + step)]
        sketches.append(F.percentile_approx(name, asked, ACCURACY).alias(f"_s{i}"))
    counts = [F.count(name).alias(f"_n{i}") for i, (name, _) in enumerate(targets)]
    sketched = rows.groupBy("_g").agg(*counts, *sketches)
    bounds = []
    for i, (_, p) in enumerate(targets):
        low, high = _bracket(F.col(f"_s{i}"), p, F.col(f"_n{i}"))
        bounds.append(F.struct(low.alias("low"), high.alias("high")).alias(f"_b{i}"))
    # groups compare as structs, in which nulls are equal
    brackets = cut_lineage(sketched.select("_g", *[f"_n{i}" for i in range(len(targets))], *bounds), "quantile-brackets")
    entries = {}
    for i, (name, p) in enumerate(targets):
        v, low, high = F.col(name), F.col(f"_b{i}.low"), F.col(f"_b{i}.high")
        under, over = F.coalesce(v < low, F.lit(False)), F.coalesce(v > high, F.lit(False))
        # values beyond the bracket on the nearer side are only counted, those on the other side do not move
        far, near = (under, over) if p >= 0.5 else (over, under)
        entries[f"_t{i}"], entries[f"_v{i}"] = F.when(v.isNotNull() & ~far, F.lit(i)), F.when(~near, v)
    # the explode holds columns alone: Spark may interpret it, and what it holds is not copied into a filter before it
    held = F.array(*[F.struct(F.col(f"_t{i}").alias("t"), F.col(f"_v{i}").alias("v")) for i in range(len(targets))])
    moved = rows.join(brackets, "_g").select("_g", *[c.alias(n) for n, c in entries.items()]).select("_g", F.explode(held).alias("_e")).filter("_e.t is not null")
    counted = moved.groupBy("_g", F.col("_e.t").alias("_t"), F.col("_e.v").alias("_v")).agg(F.count("*").alias("_m"))
    # ranks are counted from the nearer end: the largest values first for a share of one half and more
    upper = F.lit(False)
    for i, (_, p) in enumerate(targets):
        upper = F.when(F.col("_t") == i, F.lit(p >= 0.5)).otherwise(upper)
    counted = counted.withColumn("_o", F.when(upper, -F.col("_v")).otherwise(F.col("_v")))
    inside = Window.partitionBy("_g", "_t").orderBy(F.col("_o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_to", F.sum("_m").over(inside)).filter("_v is not null")
    placed = placed.join(brackets.select("_g", *[f"_n{i}" for i in range(len(targets))]), "_g")
    picks = []
    for i, (name, p) in enumerate(targets):
        at = (F.col(f"_n{i}") - 1) * F.lit(p)
        own = F.col("_t") == i

        def ranked(rank: Column) -> Column:
            from_end = (F.col(f"_n{i}") - 1 - rank) if p >= 0.5 else rank
            return F.max(F.when(own & (from_end >= F.col("_to") - F.col("_m")) & (from_end < F.col("_to")), F.col("_v")))

        picks += [ranked(F.floor(at)).alias(f"_low{i}"), ranked(F.ceil(at)).alias(f"_high{i}")]
    found = placed.groupBy("_g").agg(*picks)
    out = brackets.join(found, "_g", "left")
    columns = []
    for i, (name, p) in enumerate(targets):
        at = (F.col(f"_n{i}") - 1) * F.lit(p)
        columns.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (at - F.floor(at))).alias(f"{name}_p{round(p * 100)}"))
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *columns)


#: Bins of ``binned_quantiles``.
BINS_PER_DOUBLING = 256
_OFFSET = 1 << 20


def _bin(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * BINS_PER_DOUBLING).cast("long") + _OFFSET
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def binned_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """The same for groups that have values, by value bins in place of sketches: no sketch is held, all values move."""
    names = list(wanted)
    melted = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])).alias("_m")
    ).select(*keys, F.col("_m.c").alias("_c"), F.col("_m.v").alias("_v"))
    melted = melted.filter(F.col("_v").isNotNull()).withColumn("_b", _bin(F.col("_v")))
    group = [*keys, "_c"]
    bins = melted.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns(
        {"_total": F.sum("_n").over(Window.partitionBy(*group)), "_start": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    )
    probs = F.lit(None)
    for i, name in enumerate(names):
        probs = F.when(F.col("_c") == i, F.array(*[F.lit(float(p)) for p in wanted[name]])).otherwise(probs)

    def rank(p: Column) -> Column:
        at = (F.col("_total") - 1) * p
        return F.struct(p.alias("p"), F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))

    def in_bin(r: Column) -> Column:
        end = F.col("_start") + F.col("_n")
        return ((r["low"] >= F.col("_start")) & (r["low"] < end)) | ((r["high"] >= F.col("_start")) & (r["high"] < end))

    targets = bins.withColumn("_ranks", F.filter(F.transform(probs, rank), in_bin)).filter(F.size("_ranks") > 0)
    targets = targets.select(*group, "_b", "_start", "_ranks")
    values = melted.join(targets.select(*group, "_b"), [*group, "_b"], "left_semi").groupBy(*group, "_b", "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    placed = values.join(targets, [*group, "_b"]).withColumns(
        {"_from": F.col("_start") + F.col("_at"), "_to": F.col("_start") + F.col("_at") + F.col("_n")}
    )
    placed = placed.withColumn("_r", F.explode("_ranks"))

    def at_rank(name: str) -> Column:
        r = F.col(f"_r.{name}")
        return F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v")))

    found = placed.groupBy(*group, F.col("_r.p").alias("_p")).agg(
        at_rank("low").alias("_low"), at_rank("high").alias("_high"), F.max("_r.part").alias("_part")
    )
    found = found.withColumn("_q", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
    return found.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("_c") == i) & (F.col("_p") == float(p)), F.col("_q"))).alias(f"{name}_p{round(p * 100)}")
            for i, name in enumerate(names)
            for p in wanted[name]
        ]
    )
