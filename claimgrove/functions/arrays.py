"""Set relations, ordered unions and scoped role lookup on array/map columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrove.functions.text import is_blank, strip


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def set_relation(a: Column, b: Column) -> Column:
    """equal | subset | superset | overlap | disjoint, comparing as sets."""
    left, right = is_subset(a, b), is_subset(b, a)
    return (
        F.when(left & right, F.lit("equal"))
        .when(left, F.lit("subset"))
        .when(right, F.lit("superset"))
        .when(F.arrays_overlap(a, b), F.lit("overlap"))
        .otherwise(F.lit("disjoint"))
    )


def ordered_distinct(*arrays: Column) -> Column:
    """Concatenate, drop nulls, keep the first of each value."""
    joined = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.array_compact(joined))


def entity_set(c: Column) -> Column:
    """Trimmed, unique, sorted names; null when any entry is blank or null."""
    bad = F.exists(c, lambda e: e.isNull() | is_blank(e))
    return F.when(~bad, F.array_sort(F.array_distinct(F.transform(c, strip))))


def entity_set_json(c: Column) -> Column:
    """JSON text of the entity set, blanks after separators as in a plain dump."""
    quoted = F.transform(
        entity_set(c), lambda e: F.regexp_replace(F.to_json(F.array(e)), r"^\[|\]$", "")
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def first_reason(*ladder: tuple[Column, str | Column]) -> Column:
    """First matching reason of an ordered ladder, else null."""
    steps = [
        F.when(condition, F.lit(reason) if isinstance(reason, str) else reason)
        for condition, reason in ladder
    ]
    return F.coalesce(*steps)


def violations(*checks: tuple[Column, str]) -> Column:
    """All failed checks of a row, in the given order; a null check counts as failed."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(condition, F.lit(False)), F.lit(name))
                for condition, name in checks
            ]
        )
    )


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def scoped_roles(source_id: Column, start: Column, end: Column, roles: Column) -> Column:
    """Roles of the one `source:start:end` scope that contains the span.

    `roles` is MAP<scope key, MAP<role, STRUCT<source_id, char_start, char_end, ...>>>.
    Scoped entries shadow the whole-source entry; a malformed key, a role that
    leaves its scope, or several containing scopes give null (unresolved).
    """
    entries = F.filter(
        F.map_entries(roles), lambda e: F.startswith(e["key"], F.concat(source_id, F.lit(":")))
    )

    def bound(entry: Column, part: int) -> Column:
        return F.nullif(
            F.regexp_extract(
                F.substring(entry["key"], F.length(source_id) + 2, F.length(entry["key"])),
                "^(0|[1-9][0-9]*):(0|[1-9][0-9]*)$",
                part,
            ),
            F.lit(""),
        ).try_cast("int")

    malformed = F.exists(
        entries,
        lambda e: bound(e, 1).isNull() | bound(e, 2).isNull() | (bound(e, 2) <= bound(e, 1)),
    )
    matching = F.filter(
        entries, lambda e: (bound(e, 1) <= start) & (start < end) & (end <= bound(e, 2))
    )

    def leaves(entry: Column) -> Column:
        return F.exists(
            F.map_values(entry["value"]),
            lambda r: r.isNotNull()
            & (
                (r["source_id"] != source_id)
                | ~(
                    (bound(entry, 1) <= r["char_start"])
                    & (r["char_start"] < r["char_end"])
                    & (r["char_end"] <= bound(entry, 2))
                )
            ),
        )

    whole = F.try_element_at(roles, source_id)
    empty = F.create_map().cast(
        "map<string,struct<source_id:string,char_start:int,char_end:int>>"
    )
    return (
        F.when(F.size(entries) == 0, F.coalesce(whole, empty))
        .when(malformed | F.exists(matching, leaves) | (F.size(matching) != 1), F.lit(None))
        .otherwise(F.get(matching, F.lit(0))["value"])
    )
