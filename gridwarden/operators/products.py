"""Briefings and warning products built from the risks of one record."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.constants import DEGRADED_NOTE, INDUSTRIES, NO_FACTOR_TEXT
from gridwarden.operators.risk import RULES


_HUNDREDTHS = [f"({n / 100:.2f})" for n in range(101)]


def _shown(probability: Column) -> Column:
    """A probability with two digits in brackets; those from 0 to 1 are looked up, which costs less than to format them."""
    place = (F.round(probability, 2) * 100 + 0.5).cast("int")
    return F.when(probability.between(0.0, 1.0), F.get(F.array(*[F.lit(text) for text in _HUNDREDTHS]), place)).otherwise(F.format_string("(%.2f)", probability))


def _with_texts(df: DataFrame, entries: int) -> DataFrame:
    """Texts of the risks of medium level and above, or of all of them if none is.

    Entries are addressed one by one, so all of it is generated code; functions over array elements would be interpreted.
    """
    risks = [F.get("risks", F.lit(i)) for i in range(entries)]

    def bits(tests: Callable[[Column], Column]) -> Column:
        return reduce(Column.bitwiseOR, [F.when(tests(r), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(risks)])

    high, there = bits(lambda r: r["risk_level"] != "low"), bits(lambda r: r["hazard_type"].isNotNull())
    fits = F.when(F.size("risks") > entries, F.raise_error(F.lit(f"a record has more than {entries} risks")).cast("int"))
    rows = df.withColumn("_used", F.coalesce(fits, F.when(high != 0, high).otherwise(there)))
    used = [F.col("_used").bitwiseAND(F.lit(1 << i)) != 0 for i in range(entries)]

    def chosen(value: Callable[[Column], Column]) -> list[Column]:
        return [F.when(u, value(r)) for u, r in zip(used, risks)]

    summary = F.concat_ws("；", *chosen(lambda r: F.concat(r["hazard_type"], F.lit(":"), r["risk_level"], _shown(r["risk_probability"]))))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty) for c in chosen(lambda r: F.slice(r["contributing_factors"], 1, 2))]
    factors = F.array_join(F.sort_array(F.array_distinct(F.concat(*lists))), "；")
    degraded = reduce(or_, [u & ((r["source_status"] == "degraded") | (r["inference_mode"] == "degraded_rule_fallback")) for u, r in zip(used, risks)])
    note = F.lit("")
    if "grounding_note" in df.columns:
        note = F.coalesce(F.concat(F.lit(" 说明："), F.nullif(F.col("grounding_note"), F.lit(""))), F.lit(""))
    return rows.withColumns(
        {
            "_summary": summary,
            "_factors": F.coalesce(F.nullif(factors, F.lit("")), F.lit(NO_FACTOR_TEXT)),
            "_note": F.when(degraded, F.lit(DEGRADED_NOTE)).otherwise(note),
            "_hazards": F.concat(*[F.coalesce(c, empty) for c in chosen(lambda r: F.array(r["hazard_type"]))]),
        }
    )


def _heads(industry: str) -> dict[str, Column]:
    """What is fixed in the texts for an industry."""
    name, advice = INDUSTRIES[industry]
    return {"industry": F.lit(industry), "name": F.lit(f"{name}预警简报：当前识别风险为 "), "advice": F.lit(f"。建议：{advice}"), "tail": F.lit(f" briefing for {industry}: hazards=")}


def _briefing(head: Mapping[str, Column]) -> dict[str, Column]:
    tail = (head["tail"], F.col("_summary"), F.lit("."))
    return {
        "industry": head["industry"],
        "zh": F.concat(head["name"], F.col("_summary"), F.lit("。主要依据："), F.col("_factors"), head["advice"], F.col("_note")),
        "en": F.concat(F.lit("Placeholder English"), *tail),
        "ar": F.concat(F.lit("Arabic placeholder"), *tail),
        "hazards": F.col("_hazards"),
    }


def _struct(fields: Mapping[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _briefings() -> Column:
    return F.array(*[_struct(_briefing(_heads(i))) for i in INDUSTRIES])


def industry_briefings(df: DataFrame, keep: Sequence[str], entries: int = len(RULES)) -> DataFrame:
    """One row per record and industry. ``df`` carries the array ``risks`` with at most ``entries`` of them; no join and no shuffle is needed.

    The industries come before the texts, so a text is written once, into its row.
    """
    rows = _with_texts(df, entries).withColumn("_head", F.explode(F.array(*[_struct(_heads(i)) for i in INDUSTRIES])))
    head = {n: F.col(f"_head.{n}") for n in _heads(next(iter(INDUSTRIES)))}
    return rows.select(*keep, *[c.alias(n) for n, c in _briefing(head).items()])


def warning_product(df: DataFrame, area: str, keep: Sequence[str], entries: int = len(RULES)) -> DataFrame:
    """One nested row per record: risks, briefings, review flag and status."""
    review = F.exists("risks", lambda r: r["risk_level"].isin("high", "extreme"))
    out = _with_texts(df, entries).select(
        *keep,
        F.col(area).alias("area"),
        "risks",
        _briefings().alias("briefings"),
        review.alias("human_review_required"),
        F.when(review, "pending").otherwise("not_required").alias("review_status"),
        F.lit("draft").alias("status"),
    )
    return out.withColumn("product_id", F.concat(F.lit("warning-"), F.substring(F.sha1(F.concat_ws("|", "area", *keep)), 1, 12)))
