"""Declared rules over records: structure, meaning, release. One pass gives all findings of a row.

A rule is a condition under which a row is wrong. Structural rules are made
from a table of keywords (type by the read schema; required, enum, pattern,
bounds, unique items, dependent fields, one of several).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``wrong`` is true (not null) for a row that breaks the rule."""

    code: str
    field: str
    wrong: Column
    message: str
    severity: str = "error"


def required(code: str, field: str) -> Rule:
    return Rule(code, field, F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == ""), f"{field} is required")


def one_of(code: str, field: str, allowed: Iterable[str]) -> Rule:
    return Rule(code, field, F.col(field).isNotNull() & ~F.col(field).isin(*allowed), f"{field} isn't allowed")


def matches(code: str, field: str, pattern: str) -> Rule:
    return Rule(code, field, ~F.col(field).rlike(f"^(?:{pattern})$"), f"{field} has another form")


def bounded(code: str, field: str, low: float | None = None, high: float | None = None) -> Rule:
    below = F.lit(False) if low is None else F.col(field) < low
    above = F.lit(False) if high is None else F.col(field) > high
    return Rule(code, field, below | above, f"{field} is out of bounds")


def sized(code: str, field: str, low: int = 0, high: int = 2**31 - 1) -> Rule:
    return Rule(code, field, ~F.length(field).between(low, high), f"{field} has a wrong length")


def unique_items(code: str, field: str) -> Rule:
    return Rule(code, field, F.size(F.array_distinct(field)) != F.size(field), f"{field} repeats entries")


def dependent(code: str, field: str, *others: str) -> Rule:
    lacking = F.lit(False)
    for other in others:
        lacking = lacking | F.col(other).isNull()
    return Rule(code, field, F.col(field).isNotNull() & lacking, f"{field} needs {', '.join(others)}")


def exactly_one(code: str, *fields: str) -> Rule:
    there = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return Rule(code, fields[0], there != 1, f"exactly one of {', '.join(fields)}")


def findings(rows: DataFrame, key: str, rules: list[Rule], release: bool = False) -> DataFrame:
    """severity, code, path (key/field), message of every broken rule; in a release warnings are errors."""
    each = [
        F.when(F.coalesce(r.wrong, F.lit(False)), F.struct(F.lit("error" if release else r.severity).alias("severity"), F.lit(r.code).alias("code"), F.concat_ws("/", F.col(key).cast("string"), F.lit(r.field)).alias("path"), F.lit(r.message).alias("message")))
        for r in rules
    ]
    return rows.select(F.inline(F.array_compact(F.array(*each))))


def rederived(rows: DataFrame, key: str, stated: str, again: Column) -> DataFrame:
    """Keys whose stated value isn't what its definition gives."""
    return rows.where(~F.col(stated).eqNullSafe(again)).select(key)


def order_key(path: Column) -> Column:
    """A sort key for paths: numbers before names, numbers by value."""
    return F.transform(F.split(path, "/"), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 12, "0"))).otherwise(F.concat(F.lit("1"), x)))


def errors(found: DataFrame) -> DataFrame:
    """The findings that are errors."""
    return found.where("severity = 'error'")


def in_languages(rows: DataFrame, lang: str, wanted: list[str], known: list[str]) -> DataFrame:
    """Rows of the wanted languages (all known ones if none are named); one that isn't known is an error."""
    strange = sorted(set(wanted) - set(known))
    if strange:
        raise ValueError(f"unknown languages: {', '.join(strange)}")
    return rows.where(F.col(lang).isin(*(wanted or known)))


def supported(rows: DataFrame, version: str, versions: list[int]) -> DataFrame:
    """The rows, or an error if one has a version that isn't supported."""
    fits = F.coalesce(F.col(version).isin(*versions), F.lit(False))
    return rows.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported version "), F.coalesce(F.col(version).cast("string"), F.lit("none")))).cast("boolean")))
