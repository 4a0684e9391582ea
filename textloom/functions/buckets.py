"""Field-name rules and the age and income buckets, as Column expressions.

They follow the established behaviour to the letter, also where it is odd: a hyphen before a number is its
sign, and an amount like ``89k`` counts both as 89000 and as 89.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import strip

# Labels of the buckets, with en dashes.
AGE_LABELS = ["18–29", "30–44", "45–59", "60+"]
INCOME_LABELS = ["Under $25k", "$25k–$49k", "$50k–$74k", "$75k+"]
INCOME_LIMITS = [25_000, 50_000, 75_000]
AGE_LIMITS = [30, 45, 60]


def field_key(name: str) -> str:
    """A field's name without case, underscores and white space."""
    return re.sub(r"[_\s]+", "", name.strip().lower())


def field_key_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[_\s]+", "")


def _numbers(c: Column, pattern: str = r"(-?\d+(?:\.\d+)?)") -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: x.cast("double"))


def numbers(c: Column) -> Column:
    """All numbers of a text, in which commas are dropped first."""
    return _numbers(F.regexp_replace(c, ",", ""))


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "—-", "––"), " ", "")


def _bucket(value: Column, limits: list[int], labels: list[str]) -> Column:
    out = F.when(value < limits[0], labels[0])
    for limit, label in zip(limits[1:], labels[1:], strict=False):
        out = out.when(value < limit, label)
    return out.otherwise(labels[-1])


def age_bucket(c: Column) -> Column:
    """The bucket of an age given as number, range or label. Anything else, and ages below 18, stay."""
    s = strip(c.cast("string"))
    key, found = _dashed(s), numbers(s)
    age = F.when(F.size(found) >= 2, (F.array_min(found) + F.array_max(found)) / 2).otherwise(F.get(found, F.lit(0)))
    return F.when(key.isin(AGE_LABELS), key).when(age.isNull() | (age < 18), c.cast("string")).otherwise(_bucket(age, AGE_LIMITS, AGE_LABELS))


# Fixed values in the next two functions: words and marks of incomes (k, under, over, more, to, $, +).
def income_bucket(c: Column) -> Column:
    """The bucket of an income given as text. Without a number it stays."""
    s = strip(c.cast("string"))
    key = F.lower(_dashed(s))
    out = None
    for label in INCOME_LABELS:
        same = key == F.lit(label.lower().replace(" ", ""))
        out = F.when(same, label) if out is None else out.when(same, label)
    low = F.regexp_replace(F.lower(s), ",", "")
    found = F.concat(F.transform(_numbers(low, r"(\d+(?:\.\d+)?)\s*k"), lambda x: x * 1000.0), _numbers(low))
    holds = lambda *marks: _any([low.contains(m) for m in marks])
    small = (F.array_max(found) < 1000) & holds("$", "k", "under", "+", "-", "–", "to")
    found = F.when(small, F.transform(found, lambda x: x * 1000.0)).otherwise(found)
    value = (
        F.when(low.contains("under"), F.array_min(found) - 1)
        .when(holds("+", "over", "more"), F.array_max(found))
        .when(F.size(found) >= 2, (F.array_min(found) + F.array_max(found)) / 2)
        .otherwise(F.get(found, F.lit(0)))
    )
    return out.when(value.isNull(), c.cast("string")).otherwise(_bucket(value, INCOME_LIMITS, INCOME_LABELS))


def numeric_income_bucket(c: Column) -> Column:
    """The bucket of an income that is a number."""
    return F.when(c.isNotNull(), _bucket(c.cast("double"), INCOME_LIMITS, INCOME_LABELS))


def numeric_age_bucket(c: Column) -> Column:
    """The bucket of an age that is a number; below 18 it stays, as text."""
    return F.when(c < 18, c.cast("string")).when(c.isNotNull(), _bucket(c.cast("double"), AGE_LIMITS, AGE_LABELS))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def normalized_value(name: str, c: Column) -> Column:
    """A metadata column by its name's rule: ages, incomes, or as it is."""
    key = field_key(name)
    if key.endswith("age"):
        return age_bucket(c)
    return income_bucket(c) if "income" in key else c
