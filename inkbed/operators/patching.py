"""Patches on texts: bounds and verbatim checks, assembly, unique replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_patch(text: Column, start: Column, end: Column, original: Column) -> Column:
    """X-01: ok, out_of_bounds or not_verbatim (half-open code point ranges)."""
    held = F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
    return F.when((start < 0) | (end < start) | (end > F.length(text)), "out_of_bounds").when(held != original, "not_verbatim").otherwise("ok")


def assemble(texts: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """X-02: key and text with all good patches applied; failed is the number of the others.

    Patches (key, start, end, original, replacement) don't overlap; they are applied from the end on, so ranges stay valid.
    """
    checked = patches.join(texts.select(key, "text"), key).withColumn("_s", check_patch(F.col("text"), F.col("start"), F.col("end"), F.col("original")))
    row = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("replacement").alias("r"))
    grouped = checked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_s") == "ok", row))).alias("_p"), F.count_if(F.col("_s") != "ok").alias("failed"))
    joined = texts.join(grouped, key, "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint,r:string>>")

    def put(t: Column, p: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), p["s"].cast("int")), p["r"], F.substring(t, p["e"].cast("int") + 1, F.length(t)))

    patched = F.aggregate(F.reverse(F.coalesce("_p", none)), F.col("text"), put)
    return joined.select(key, patched.alias("text"), F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"))


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences that don't overlap."""
    return F.when(F.length(part) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.nullif(F.length(part), F.lit(0))).cast("bigint"))


def unique_replace(text: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """X-03: (status, text): not_found, ambiguous, or replaced once."""
    n = occurrences(text, old)
    status = F.when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("replaced")
    return status, F.when(n == 1, F.replace(text, old, new)).otherwise(text)


def assemble_sections(sections: DataFrame, drafts: DataFrame, by: str, order: str) -> DataFrame:
    """X-10, U-10: the drafts of each document in order, with a marker line for each section that has none."""
    piece = F.coalesce(F.col("draft"), F.concat(F.lit("% MISSING: "), F.col(order).cast("string")))
    rows = sections.join(drafts, [by, order], "left").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))).alias("_x"), F.count_if(F.col("draft").isNull()).alias("missing"))
    return rows.select(by, F.array_join(F.transform("_x", lambda s: s["p"]), "\n").alias("text"), F.col("missing").cast("bigint").alias("missing"))
