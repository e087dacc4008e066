"""Canonical JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a semantic hash leaves out at every level (fixed values).
REVIEW_KEYS = ("source_hash", "source_id", "status", "translation_status", "review_notes")


def _sorted(value: Column, kind: T.DataType, drop: tuple[str, ...]) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if f.name not in drop), key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType, drop).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType, drop))
    return value


def canonical_json(df: DataFrame, columns: list[str] | None = None, drop: tuple[str, ...] = ()) -> Column:
    """A row's columns as compact JSON with sorted keys; absent (null) fields are left out."""
    schema = T.StructType([f for f in df.schema.fields if f.name in (columns or df.columns)])
    return F.to_json(_sorted(F.struct(*[F.col(f.name) for f in schema.fields]), schema, drop))


def semantic_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Hash of a record without its review and link keys."""
    return F.sha2(canonical_json(df, columns, REVIEW_KEYS), 256)


def content_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


def content_id(prefix: str, size: int, *parts: Column) -> Column:
    """An id from content: the parts joined by NUL, hashed, and cut."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.array_join(F.array(*parts), "\x00"), 256), 1, size)))


def upper_hex(value: Column, size: int) -> Column:
    """The first digits (an even number) of a text's SHA-256 in capitals.

    Not by ``upper``: an executor's first call of it (or of ``lower``) makes Spark's table of all characters' cases, gigabytes of garbage for which the heap grows.
    """
    return F.hex(F.unhex(F.substring(F.sha2(value, 256), 1, size)))


def integrity_holds(df: DataFrame, field: str) -> Column:
    """Whether a record's own hash field is that of its other fields."""
    return F.col(field) == F.sha2(canonical_json(df, [c for c in df.columns if c != field]), 256)
