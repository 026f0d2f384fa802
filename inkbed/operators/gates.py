"""Validation as queries: each check selects its violations, and a gate is open only if a check ran and found none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_references(rows: DataFrame, column: str, target: DataFrame, target_column: str, check: str, key: str) -> DataFrame:
    """J-06 to J-08: rows whose reference resolves to nothing: check, locator, reason.  Nulls are missing, too."""
    known = target.select(F.col(target_column).alias("_known")).distinct()
    lost = rows.join(known, rows[column] == known["_known"], "left_anti")
    return lost.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("locator"), F.concat(F.lit(f"{column}="), F.coalesce(F.col(column).cast("string"), F.lit("null"))).alias("reason"))


def duplicate_keys(rows: DataFrame, keys: list[str], check: str) -> DataFrame:
    """A-21: keys that occur more than once."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return many.select(F.lit(check).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("locator"), F.concat(F.lit("count="), F.col("_n").cast("string")).alias("reason"))


def violations(rows: DataFrame, failed: Column, check: str, key: str, reason: Column) -> DataFrame:
    """Rows that fail a condition; a null condition fails (closed by default)."""
    return rows.filter(F.coalesce(failed, F.lit(True))).select(F.lit(check).alias("check"), F.col(key).cast("string").alias("locator"), reason.alias("reason"))


def roll_up(found: list[DataFrame], ran: DataFrame, required: list[str]) -> DataFrame:
    """V-06, V-16: one row for each required check: gate, n_violations, passed (it ran and found nothing).

    ran: one row (column check) for each check that did run.
    """
    spark = ran.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "check string")
    counts = reduce(DataFrame.unionByName, found).groupBy("check").agg(F.count("*").alias("n"))
    out = wanted.join(ran.withColumn("_ran", F.lit(True)), "check", "left").join(counts, "check", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(F.col("check").alias("gate"), n.cast("bigint").alias("n_violations"), (F.coalesce("_ran", F.lit(False)) & (n == 0)).alias("passed"))


def allowed(state: Column, good: tuple[str, ...]) -> Column:
    """F-10: an allow list; null is not on it."""
    return F.coalesce(state, F.lit("")).isin(*good)


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U-01, U-05, U-08: keys and status (preserved, missing, added) of two key sets."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").otherwise("preserved")
    return x.join(y, keys, "full").select(*keys, status.alias("status"))


def stable_sample(rows: DataFrame, identity: str, first: Column, n: int, seed: str) -> DataFrame:
    """T-03: all rows that come first, then others by the hash of seed and identity until there are n.

    The hash order is cut by a top-n, which Spark takes from each task's own top n.
    """
    marked = rows.withColumn("_first", F.coalesce(first, F.lit(False))).withColumn("_hash", F.sha2(F.concat_ws(":", F.lit(seed), F.col(identity).cast("string")), 256))
    known = marked.filter("_first")
    have = known.count()
    rest = marked.filter("NOT _first").orderBy("_hash", identity).limit(max(0, n - have))
    return known.unionByName(rest).drop("_first", "_hash")


def latest(rows: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """W-13, W-14: the columns of the last row of each group."""
    best = F.max(F.struct(order.alias("_o"), *columns))
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, *[F.col(f"_b.{c}").alias(c) for c in columns])


def repeats(rows: DataFrame, by: list[str], order: str, signature: str) -> DataFrame:
    """W-15 to W-17: for each row: seen_before (any earlier row has its signature), no_op (the one before has) and nth."""
    w = W.partitionBy(*by, signature).orderBy(order)
    nth = F.row_number().over(w)
    before = F.lag(signature).over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("nth", nth.cast("bigint")).withColumn("seen_before", F.col("nth") > 1).withColumn("no_op", F.coalesce(before == F.col(signature), F.lit(False)))


def capped(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """W-16: rows of repeats() with stop: the cap of ``most`` cycles, else a signature that was there before, else null."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("stop", F.when(place > most, "cycle cap").when(F.col("seen_before"), "repeated signature"))
