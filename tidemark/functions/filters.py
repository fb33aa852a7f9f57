"""Filters: label masks, and a `where` mapping compiled to one Column.

A where mapping is {field: value} or {field: {operator: value, ...}}, with $and and $or
over lists of mappings. Missing fields are null: $ne and $nin hold for them, the other
operators do not, and equality with None does. Unknown operators are refused when the
filter is compiled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the Column of a field's name, given the operand it is compared with
Field = Callable[[str, Any], Column]


def plain(name: str, _: Any = None) -> Column:
    return F.col(name)


def label_match(label: str | Column, require_all: int = 0, require_any: int = 0, exclude: int = 0) -> Column:
    """Every bit of require_all, one of require_any (if any are asked for), none of exclude."""
    label = F.col(label) if isinstance(label, str) else label
    hold = label.bitwiseAND(F.lit(require_all)) == require_all
    if require_any:
        hold &= label.bitwiseAND(F.lit(require_any)) != 0
    return hold & (label.bitwiseAND(F.lit(exclude)) == 0)


def page_can_match(union: str | Column, require_all: int = 0, require_any: int = 0) -> Column:
    """Whether a page with this union of labels may hold a match (exclusion says nothing of a union)."""
    return label_match(union, require_all, require_any)


def where(condition: Mapping[str, Any] | None, field: Field = plain) -> Column:
    """The condition as a Column that is never null. field: the Column of a name."""
    if not condition:
        return F.lit(True)
    return reduce(Column.__and__, (_entry(k, v, field) for k, v in condition.items()))


def json_field(column: str | Column) -> Field:
    """Fields of a JSON text column, read as the kind of their operand: a field of another
    kind counts as missing. For a text operand an array is matched by its elements."""
    c = F.try_parse_json(F.col(column) if isinstance(column, str) else column)

    def field(name: str, want: Any = None) -> Column:
        path = f"$['{name}']"
        sample = next((x for x in want if x is not None), None) if isinstance(want, (list, tuple)) else want
        if isinstance(sample, bool):
            return F.try_variant_get(c, path, "boolean")
        if isinstance(sample, (int, float)):
            return F.try_variant_get(c, path, "double")
        return F.try_variant_get(c, path, "string")

    return field


def _contains(have: Column, want: Any) -> Column:
    """Containment in a text, or in a JSON array of texts."""
    items = F.try_variant_get(F.try_parse_json(have), "$", "array<string>")
    return F.when(have.startswith("["), F.coalesce(F.array_contains(items, want), F.lit(False))).otherwise(F.coalesce(F.contains(have, F.lit(want)), F.lit(False)))


def _entry(key: str, value: Any, field: Field) -> Column:
    if key in ("$and", "$or"):
        if isinstance(value, (str, bytes)) or not isinstance(value, Sequence):
            raise ValueError(f"{key} takes a list of mappings")
        parts = [where(v, field) for v in value]
        return reduce(Column.__and__ if key == "$and" else Column.__or__, parts, F.lit(key == "$and"))
    if key.startswith("$"):
        raise ValueError(f"unknown operator {key}")
    if isinstance(value, Mapping):
        return reduce(Column.__and__, (_operator(field(key, v if o != "$regex" else ""), o, v) for o, v in value.items()), F.lit(True))
    return _equal(field(key, value), value)


def _equal(have: Column, want: Any) -> Column:
    if isinstance(want, (list, tuple)):
        want = F.array(*(F.lit(x) for x in want))
    return have.eqNullSafe(want if isinstance(want, Column) else F.lit(want))


def _in(have: Column, wants: Any) -> Column:
    if isinstance(wants, (str, bytes, Mapping)):
        raise ValueError("$in and $nin take a list")
    wants = list(wants)
    some = [w for w in wants if w is not None]
    hold = F.coalesce(have.isin(some), F.lit(False)) if some else F.lit(False)
    return hold | have.isNull() if None in wants else hold


def _operator(have: Column, operator: str, want: Any) -> Column:
    no = F.lit(False)
    match operator:
        case "$eq":
            return _equal(have, want)
        case "$ne":
            return ~_equal(have, want)
        case "$gt":
            return F.coalesce(have > want, no)
        case "$gte":
            return F.coalesce(have >= want, no)
        case "$lt":
            return F.coalesce(have < want, no)
        case "$lte":
            return F.coalesce(have <= want, no)
        case "$in":
            return _in(have, want)
        case "$nin":
            return ~_in(have, want)
        case "$contains":
            return _contains(have, want)
        case "$has":  # the list form of containment: an array column holds the value
            return F.coalesce(F.array_contains(have, want), no)
        case "$regex":
            return F.coalesce(have.cast("string").rlike(want), no)
    raise ValueError(f"unknown operator {operator}")
