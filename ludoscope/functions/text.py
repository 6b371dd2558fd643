"""String and nested-array expressions of the catalogue records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def first_filled(preferred: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(preferred, F.lit("")), fallback)


def name_key(name: Column) -> Column:
    """Join key of two catalogues that only share the title."""
    return F.lower(F.trim(name))


def joined_names(entries: Column) -> Column:
    """``[{name: A}, {name: B}]`` -> ``"A, B"``; nameless entries are left out."""
    names = F.filter(F.transform(entries, lambda e: e["name"]), filled)
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def joined_companies(involved: Column, role: str) -> Column:
    """Names of the companies whose ``role`` flag is set."""
    in_role = F.filter(involved, lambda c: c[role])
    return joined_names(F.transform(in_role, lambda c: c["company"]))


def split_csv(text: Column, cap: int | None = None) -> Column:
    """``" a, ,b"`` -> ``["a", "b"]``, keeping at most ``cap`` items; NULL -> empty array."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    items = F.coalesce(items, F.array().cast("array<string>"))
    return F.slice(items, 1, cap) if cap else items


def owners_midpoint(owners_range: Column) -> Column:
    """Middle of ``"100,000 .. 200,000"`` as bigint; 0 for anything else."""
    ends = F.split(F.replace(owners_range, F.lit(","), F.lit("")), r"\.\.")

    def end(i: int) -> Column:
        return F.trim(F.get(ends, F.lit(i))).try_cast("bigint")

    return F.coalesce(F.call_function("div", end(0) + end(1), F.lit(2)), F.lit(0).cast("bigint"))


def cents_to_dollars(cents: Column) -> Column:
    return F.coalesce(F.round(cents.try_cast("double") / 100, 2), F.lit(0.0))


def tags_to_string(tags: Column) -> Column:
    """Tag field kept as JSON text: an object gives its keys, a list its items, other text itself."""
    as_map = F.array_join(F.map_keys(F.from_json(tags, "map<string,string>")), ", ")
    as_list = F.array_join(F.from_json(tags, "array<string>"), ", ")
    start = F.substring(F.ltrim(tags), 1, 1)
    return F.coalesce(
        F.when(start == "{", as_map).when(start == "[", as_list),
        tags,
        F.lit(""),
    )
