"""Rendering records to texts, cutting texts into records, packing them under byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def split_sections(texts: DataFrame, key: str, text: str, mark: str = r"(?m)^## ([A-Z]+)\n") -> DataFrame:
    """Sections of texts at their heading lines: name, ordinal from 0, body (heading included), in order.

    What comes before the first heading is the section with an empty name; all
    bodies together are the text again.
    """
    cut = F.split(F.regexp_replace(F.col(text), mark, "\u0001$0"), "\u0001")
    parts = texts.select(key, F.posexplode(cut).alias("ordinal", "body"))
    return parts.withColumn("name", F.regexp_extract("body", mark, 1)).where("ordinal > 0 OR body <> ''").select(key, "name", "ordinal", "body")


def pack_records(records: DataFrame, by: list[str], order: str, size: Column, budget: int, wrapper: Column | int = 0) -> DataFrame:
    """Parts of consecutive records whose sizes and wrapper stay within a budget: part from 1.

    The greedy rule starts a part when the next record doesn't fit, so each part's
    start depends on the one before: an ordered fold over a group's sizes. A
    record above the budget is a part of its own, marked ``over``.
    """
    base = wrapper if isinstance(wrapper, Column) else F.lit(wrapper)
    rows = records.withColumn("_size", size.cast("long")).withColumn("_base", base.cast("long"))
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_size").alias("s"), F.col("_base").alias("b")))).alias("_l"))
    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:string,part:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["part"] > 0) & (acc["used"] + x["s"] + x["b"] <= budget)
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(part.alias("part"), F.when(fits, acc["used"] + x["s"]).otherwise(x["s"]).alias("used"), F.array_append(acc["out"], F.struct(x["o"].cast("string").alias("o"), part.alias("part"))).alias("out"))

    folded = listed.select(*by, F.explode(F.aggregate("_l", start, step, lambda a: a["out"])).alias("_p")).select(*by, F.col("_p.o").alias("_o"), F.col("_p.part").alias("part"))
    joined = rows.withColumn("_o", F.col(order).cast("string")).join(folded, [*by, "_o"])
    return joined.withColumn("over", F.col("_size") + F.col("_base") > budget).drop("_o", "_size", "_base")


def offsets(parts: DataFrame, by: list[str], order: str, size: Column) -> DataFrame:
    """Ordinal and byte offset of each part."""
    w = Window.partitionBy(*by).orderBy(order)
    return parts.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def render(records: DataFrame, by: list[str], order: str, line: Column) -> DataFrame:
    """Records' lines joined in order: text per group."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"])
    return records.groupBy(*by).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """A template with its placeholders filled; one that is left is an error."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return F.when(out.rlike(r"\{\{|\}\}"), F.raise_error(F.concat(F.lit("unresolved placeholder in: "), F.substring(out, 1, 80)))).otherwise(out)


def verify_parts(parts: DataFrame, whole: DataFrame, by: list[str], order: str, body: str, text: str) -> DataFrame:
    """Groups whose parts, in order, aren't the whole text."""
    joined = parts.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("b")))), lambda x: x["b"]), "").alias("_again"))
    return whole.join(joined, by, "left").where(~F.col(text).eqNullSafe(F.col("_again"))).select(*by)


def publish(versions: DataFrame, published: DataFrame, path: str, digest: str) -> DataFrame:
    """What publishing content-addressed files does: "new", "same" (nothing to do) or "conflict" (an error)."""
    old = published.select(F.col(path), F.col(digest).alias("_there"))
    state = F.when(F.col("_there").isNull(), "new").when(F.col("_there") == F.col(digest), "same").otherwise("conflict")
    return versions.join(old, path, "left").withColumn("state", state).drop("_there")


def record_units(rows: DataFrame, keys: list[str], text: Column, mark: str) -> DataFrame:
    """keys, ordinal (from 0), unit and offset (bytes before it) of a section's indivisible slices; joined by the mark they are the section again."""
    units = rows.select(*keys, F.posexplode(F.split(text, F.lit("\\Q" + mark + "\\E"))).alias("ordinal", "unit"))
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.octet_length("unit") + len(mark.encode())
    return units.withColumn("offset", F.coalesce(F.sum(sizes).over(before), F.lit(0)))
