"""Fields of records as column expressions: allowed fields, leaves, codes, forms, labels, dates and numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def allowed_fields(fields: Column, allowed: list[str], status: str = "draft") -> tuple[Column, Column]:
    """A map of fields with the allowed ones alone and the status set, and the other fields' names in order."""
    names = F.array(*[F.lit(x) for x in allowed])
    kept = F.map_filter(fields, lambda k, v: F.array_contains(names, k) & (k != "status"))
    unknown = F.array_sort(F.array_except(F.map_keys(fields), names))
    return F.map_concat(kept, F.create_map(F.lit("status"), F.lit(status))), F.coalesce(unknown, F.array().cast("array<string>"))


def corrected(fields: Column, values: dict[str, Column], removed: list[str]) -> Column:
    """A map of fields after corrections: some set, some removed."""
    gone = F.array(*[F.lit(x) for x in [*removed, *values]])
    kept = F.map_filter(fields, lambda k, v: ~F.array_contains(gone, k))
    if not values:
        return kept
    return F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]))


def _leaves(value: object, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _leaves(inner, f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        for place, inner in enumerate(value):
            yield from _leaves(inner, f"{path}/{place}")
    elif value is not None:
        yield path, value if isinstance(value, str) else json.dumps(value)


_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_LEAVES)
def leaves(values: pd.Series) -> pd.Series:
    """All leaves of JSON texts at any depth, in order: JSON pointer and text; none for null or a text that isn't JSON."""

    def one(text: str | None) -> list[tuple[str, str]]:
        try:
            return [] if text is None else list(_leaves(json.loads(text), ""))
        except ValueError:
            return []

    return values.map(one, na_action=None)


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first condition that holds, else the default."""
    found = None
    for condition, name in rules:
        found = F.when(condition, name) if found is None else found.when(condition, name)
    return F.lit(default) if found is None else found.otherwise(default)


def labelled(key: Column, labels: dict[object, str], default: str) -> Column:
    """A label from a map, the default for what it lacks."""
    if not labels:
        return F.lit(default)
    held = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(held, key), F.lit(default))


def reason_codes(rules: list[tuple[str, Column]]) -> Column:
    """The codes of the rules that a record breaks, in the rules' order; a condition that is null isn't broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), code) for code, wrong in rules]))


def structured_error(parts: list[Column], keyword: Column, codes: dict[str, str], message: Column) -> Column:
    """An error as (code, path, message): a stable code for its keyword, a dotted path, blanks of the message collapsed."""
    path = F.array_join(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull() & (x != "")), ".")
    return F.struct(labelled(keyword, codes, "invalid").alias("code"), F.when(path == "", "$").otherwise(path).alias("path"), F.trim(F.regexp_replace(message, r"\s+", " ")).alias("message"))


def form_choice(form: Column, choices: list[str]) -> Column:
    """The one box of a form that is ticked; null where none or several are, or it is none of the choices."""
    ticked = F.regexp_extract_all(form, F.lit(r"(?m)^[ \t]*- \[[xX]\] (\w+)[ \t]*$"), F.lit(1))
    only = F.get(ticked, F.lit(0))
    return F.when((F.size(ticked) == 1) & only.isin(*choices), only)


def protected_hash(form: Column) -> Column:
    """Hash of a form without what may be edited: which boxes are ticked, and notes."""
    blank = F.regexp_replace(F.regexp_replace(form, r"(?m)^([ \t]*- \[)[ xX](\] )", "$1 $2"), r"(?m)^(Note:).*$", "$1")
    return F.sha2(blank, 256)


def is_iso_date(c: Column) -> Column:
    """Whether a text is a calendar date written as YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_iso_datetime(c: Column) -> Column:
    """Whether a text is a date and time with a zone, as ISO 8601 writes them."""
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(shaped & F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")).isNotNull(), F.lit(False))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def within(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Whether two numbers are the same but for rounding."""
    return F.abs(a - b) <= tolerance


def percentage(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; null where the whole is 0."""
    return F.when(whole != 0, F.floor(100 * part / whole)).cast("long")


def fingerprint(content: Column) -> Column:
    """(sha256, size_bytes) of a content, text or binary."""
    return F.struct(F.sha2(content.cast("binary"), 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"))


def ordered_distinct(items: Column) -> Column:
    """Items in the order of their first places, each once, empty ones left out."""
    return F.filter(F.array_distinct(items), lambda x: x.isNotNull() & (x != ""))


def key_differences(keys: Column, required: list[str], allowed: list[str] | None = None) -> tuple[Column, Column]:
    """Required keys that a record lacks, and keys that aren't allowed (by default the required ones), both sorted."""
    needed, known = (F.array(*[F.lit(x) for x in names]) for names in (required, allowed or required))
    return F.array_sort(F.array_except(needed, keys)), F.array_sort(F.array_except(keys, known))


def sanitised_metadata(fields: Column, allowed: dict[str, int]) -> Column:
    """A generator's metadata with the allowed fields alone, each on one safe line of at most so many characters; what isn't safe is left out."""
    most = F.create_map(*[x for k, n in allowed.items() for x in (F.lit(k), F.lit(n))])
    line = lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))
    fits = lambda k, v: F.coalesce((F.length(line(v)) > 0) & (F.length(line(v)) <= F.try_element_at(most, k)) & ~v.rlike(r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"), F.lit(False))
    return F.transform_values(F.map_filter(fields, fits), lambda k, v: line(v))


def edited_setting(text: Column, section: str, key: str, value: Column) -> Column:
    """A settings text in which one key of a section has another value: its line is replaced, or added below the section's head; a section that isn't there is added at the end. Other lines stay as they are."""
    head = rf"(?m)^\[\Q{section}\E\][ \t]*(?:#.*)?$"
    within = rf"((?:\A|[\s\S]*?\n)\[\Q{section}\E\][ \t]*(?:#[^\n]*)?\n(?:(?!\[)[^\n]*\n)*?)\Q{key}\E[ \t]*=[^\n]*"
    line = F.concat(F.lit(f"{key} = "), value)
    safe = F.regexp_replace(line, r"([\\$])", r"\\$1")
    ended = F.when(F.endswith(text, F.lit("\n")) | (text == ""), text).otherwise(F.concat(text, F.lit("\n")))
    replaced = F.regexp_replace(ended, F.lit(rf"\A{within}"), F.concat(F.lit("$1"), safe))
    below = F.regexp_replace(ended, F.lit(head), F.concat(F.lit(rf"[{section}]" + "\n"), safe))
    return F.when(ended.rlike(rf"\A{within}"), replaced).when(ended.rlike(head), below).otherwise(F.concat(ended, F.lit(f"[{section}]\n"), line, F.lit("\n")))
