"""Metadata filters as Column predicates.

A filter is ``{field: value}`` (equals) or ``{field: {"operator": ..., "value": ...}}``; all must hold. Blank
values are skipped. ``mode="hits"`` filters search hits (exact field names, unknown operators keep, bounds
of ``between`` must be numbers); ``mode="strict"`` filters documents (any case, unknown operators drop).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a null or missing field does, by operator: kept if listed.
_KEEP_NULL = {"hits": {"not_equals", "between", "includes", "not_includes", "unknown"}, "strict": {"not_equals", "between", "not_includes", "unknown"}}
_KNOWN = {"equals", "not_equals", "contains", "greater_than", "less_than", "between", "in", "includes", "not_includes"}


def _number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _bounds(value: Any) -> tuple[Any, Any]:
    if isinstance(value, dict):
        return value.get("min"), value.get("max")
    return (value[0], value[1]) if isinstance(value, (list, tuple)) and len(value) == 2 else (None, None)


def predicate(field: Column, spec: Any, mode: str = "hits") -> Column | None:
    """The condition on one field, or None if the filter is blank. Never null."""
    operator, value = (spec.get("operator", "equals"), spec.get("value")) if isinstance(spec, dict) else ("equals", spec)
    if value is None or value == "" or value == []:
        return None
    text = F.lower(field.cast("string"))
    number = field.cast("string").try_cast("double")
    values = [str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]
    kind = operator if operator in _KNOWN else "unknown"
    if kind in ("equals", "not_equals"):
        found = text == F.lit(str(value).lower())
        found = ~found if kind == "not_equals" else found
    elif kind == "contains":
        found = text.contains(str(value).lower())
    elif kind in ("greater_than", "less_than"):
        limit = _number(value)
        found = F.lit(False) if limit is None else number > limit if kind == "greater_than" else number < limit
    elif kind == "between":
        low, high = _bounds(value)
        if mode == "strict":
            low, high = _number(low), _number(high)
        whole = all(isinstance(b, (int, float)) for b in (low, high))
        found = number.between(low, high) if whole else F.lit(False)
    elif kind in ("in", "includes", "not_includes"):
        found = text.isin(values)
        found = ~found if kind == "not_includes" else found
    else:
        found = F.lit(mode == "hits")
    return F.when(field.isNull(), F.lit(kind in _KEEP_NULL[mode])).otherwise(F.coalesce(found, F.lit(False)))


def field_column(columns: list[str], name: str, mode: str = "hits") -> Column:
    """A column by its exact name, or in any case for documents; null if there is none."""
    if name in columns:
        return F.col(name)
    if mode == "strict":
        for c in columns:
            if c.lower() == name.lower():
                return F.col(c)
    return F.lit(None).cast("string")


def map_value(meta: Column, name: str, mode: str = "hits") -> Column:
    """A field of a metadata map, by exact name or in any case (the first that fits)."""
    if mode == "hits":
        return F.try_element_at(meta, F.lit(name))
    return F.get(F.filter(F.map_entries(meta), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def apply_filters(df: DataFrame, filters: dict[str, Any] | None, mode: str = "hits", metadata: str | None = None) -> DataFrame:
    """Rows that meet all filters, over columns or over the fields of a metadata map."""
    for name, spec in (filters or {}).items():
        field = map_value(F.col(metadata), name, mode) if metadata else field_column(df.columns, name, mode)
        condition = predicate(field, spec, mode)
        if condition is not None:
            df = df.where(condition)
    return df
