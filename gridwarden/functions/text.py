"""Free-text location handling: canonical text, province and region resolution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwarden import gazetteer
from gridwarden.functions.basic import Value, col, literal_map, text

NATIONWIDE = "saudi_arabia"


def canonical_text(value: Value) -> Column:
    """Lower case with every run of other characters turned into one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(value).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def slug(value: Value) -> Column:
    return F.regexp_replace(F.lower(text(value)), "[ /]", "_")


def _canonical(word: str) -> str:
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in word.lower())
    return " ".join(kept.split())


def _found(canonical: Column, places: list[tuple[str, str]]) -> Column:
    """Array of (position, rank, region) for the places that occur as whole tokens in the text."""
    padded = F.concat(F.lit(" "), canonical, F.lit(" "))
    table = F.array(
        *[F.struct(F.lit(f" {p} ").alias("token"), F.lit(i).alias("rank"), F.lit(r).alias("region")) for i, (p, r) in enumerate(places)]
    )
    hits = F.transform(
        table, lambda t: F.struct(F.instr(padded, t["token"]).alias("position"), t["rank"].alias("rank"), t["region"].alias("region"))
    )
    return F.filter(hits, lambda h: h["position"] > 0)


def _longest_first(table: Mapping[str, str]) -> list[tuple[str, str]]:
    return sorted(((_canonical(p), r) for p, r in table.items() if _canonical(p)), key=lambda x: -len(x[0]))


def province_alias(value: Value, table: Mapping[str, str] = gazetteer.FLOOD_PLACES) -> Column:
    """Province of a name by direct lookup, else the lower-case name itself."""
    name = F.lower(text(value))
    return F.coalesce(F.try_element_at(literal_map(table), name), name)


def resolve_provinces(*values: Value, table: Mapping[str, str] = gazetteer.FLOOD_PLACES) -> Column:
    """Distinct provinces named in the texts, in order of appearance."""
    places = _longest_first(table)
    parts = []
    for value in values:
        name = F.lower(text(value))
        direct = F.try_element_at(literal_map(table), name)
        hits = F.transform(F.array_sort(_found(canonical_text(value), places)), lambda h: h["region"])
        parts.append(F.concat(F.array_compact(F.array(direct)), hits))
    return F.array_distinct(F.concat(*parts))


def province_to_region(value: Value, table: Mapping[str, str] = gazetteer.FLOOD_PLACES) -> Column:
    """Region id of a province name: bracketed notes dropped, aliases applied, spaces to underscores."""
    name = F.regexp_replace(F.lower(text(value)), "[_-]", " ")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+", " "))
    region = F.regexp_replace(F.coalesce(F.try_element_at(literal_map(table), name), name), " ", "_")
    return F.when(region.isin("", "unknown"), F.lit("")).otherwise(region)


def resolve_heat_regions(
    value: Value,
    table: Mapping[str, str] = gazetteer.HEAT_PLACES,
    provinces: Mapping[str, str] = gazetteer.FLOOD_PLACES,
) -> Column:
    """Region ids named in an extreme-heat text; longer place names are looked at first."""
    canonical = canonical_text(value)
    merged: dict[str, str] = {}
    for place, province in provinces.items():
        merged.setdefault(_canonical(place), province.replace(" ", "_"))
    for place, regions in table.items():
        if " " not in regions:
            merged.setdefault(place, regions)
    places = sorted(((p, r) for p, r in merged.items() if p), key=lambda x: -len(x[0]))
    by_rank = F.transform(
        F.array_sort(F.transform(_found(canonical, places), lambda h: F.struct(h["rank"].alias("rank"), h["region"].alias("region")))),
        lambda h: h["region"],
    )
    direct = F.try_element_at(literal_map(table), canonical)
    return F.when(direct.isNotNull(), F.split(direct, " ")).otherwise(F.array_distinct(by_rank))


def location_token(value: Value) -> Column:
    """Lower case without outer quotes; hyphens and underscores become spaces."""
    name = F.regexp_replace(F.lower(text(value)), "^[\"'`]+|[\"'`]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, "[-_]", " "), r"\s+", " "))


def dust_region(
    value: Value, aliases: Mapping[str, str] = gazetteer.DUST_ALIASES, places: Mapping[str, str] = gazetteer.DUST_PLACES
) -> Column:
    """Region id of one location name; unknown names become their own id."""
    token = location_token(value)
    known = literal_map({**places, **aliases})
    return F.coalesce(F.try_element_at(known, token), F.regexp_replace(token, " ", "_"))


def resolve_dust_regions(value: Value) -> Column:
    """Distinct region ids of a text that lists places with commas, slashes, semicolons, 'and' or '&'."""
    parts = F.filter(F.split(F.lower(text(value)), r"\s*(?:,|/|;|\band\b|&)\s*"), lambda p: p != "")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: dust_region(p)), lambda r: r != ""))


def residual_tokens(value: Value, provinces: Column, table: Mapping[str, str] = gazetteer.FLOOD_PLACES) -> Column:
    """Words left in a location text once resolved place names and filler words are taken out."""
    names = sorted({(_canonical(p), prov) for p, prov in table.items()} | {(prov, prov) for prov in table.values()})
    names.sort(key=lambda x: (-len(x[0]), x[0]))
    known = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(prov).alias("province")) for p, prov in names])
    used = F.filter(known, lambda k: F.array_contains(provinces, k["province"]))
    left = F.aggregate(
        used,
        F.concat(F.lit(" "), canonical_text(value), F.lit(" ")),
        lambda acc, k: F.replace(acc, F.concat(F.lit(" "), k["place"], F.lit(" ")), F.lit(" ")),
    )
    left = F.regexp_replace(left, r"\b(and|or|the|region|regions|province|provinces|governorate|governorates)\b", " ")
    return F.filter(F.split(F.trim(left), r"\s+"), lambda w: w != "")
