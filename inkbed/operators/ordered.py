"""Ranks, running sums and quantiles of groups of any size: rows are dealt by ranges of their order, so that no group is one task's.

A range of the sort order goes to a task; sums inside of it are a window, and what lies before it is the sum over the earlier ranges, a
row for each group and task.  Equal rows of one group can't be cut apart by ranges: callers add them up before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.session import written


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], totals: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with running sums (own row included) over a group in the given order, and the group's ``totals`` (name: name of a sum).

    Null groups and null values of the order are like others, nulls first.  The rows are written once.
    """
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    dealt = rows.withColumns(values).repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()).transform(written)
    inside = W.partitionBy("_slice", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    parts = dealt.groupBy("_slice", *by).agg(*(F.sum(v).alias(v) for v in values))
    group = W.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    before = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    names = list(sums)
    offsets = parts.select(
        F.col("_slice").alias("_s"),
        *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)),
        *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{i}") for i, v in enumerate(values)),
        *(F.sum(f"_v{names.index(of)}").over(group).alias(name) for name, of in (totals or {}).items()),
    )
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    summed = dealt.withColumns({f"_r{i}": F.sum(f"_v{i}").over(inside) for i in range(len(names))}).join(offsets, same)
    kept = [c for c in rows.columns if c not in names]
    return summed.select(*kept, *((F.col(f"_r{i}") + F.col(f"_o{i}")).alias(n) for i, n in enumerate(names)), *(totals or {}))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of each group, between neighbours by proportion: the group, and a column for each point.

    Equal values are added up first; then ranks say where a quantile lies, so no task holds a group's values.  Nulls don't count;
    a group of nulls alone has no row; ``by`` may be empty (one row, none if there is no value).
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running(cells, by, ["_value"], {"_upto": F.col("_n")}, {"_all": "_upto"})
    at = lambda rank: F.min(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_value")))
    found = []
    for i, q in enumerate(points.values()):
        place = (F.col("_all") - 1) * F.lit(float(q))
        found += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    one = ranked.groupBy(*by).agg(*found)
    if not by:
        one = one.filter("_lo0 IS NOT NULL")
    return one.select(*by, *((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name) for i, name in enumerate(points)))
