"""Metrics over documents, reviews and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import quantiles


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, or ``empty`` where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.nullif(whole, F.lit(0)))


def calibration(rows: DataFrame, predicted: Column, actual: Column, by: list[str], held_out: int = 20) -> DataFrame:
    """A-12: confusion counts, precision, recall, F1, accuracy; calibrated from an F1 of 0.8 and ``held_out`` rows on."""
    counts = rows.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = counts.withColumn("precision", p).withColumn("recall", r).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), total))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("calibrated", (F.col("f1") >= 0.8) & (total >= held_out))


def running_budget(rows: DataFrame, by: list[str], order: list[str], amount: Column, cap: int) -> DataFrame:
    """A-05: spent so far in each row and whether it crosses the cap there."""
    spent = F.sum(amount).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("over", F.col("spent") > cap).withColumn("crosses", F.col("over") & (F.col("spent") - amount <= cap))


def status_ledger(rows: DataFrame, source: str, status: str) -> DataFrame:
    """A-03: counts by source and status with totals by source and overall; null stands for all."""
    return rows.rollup(source, status).agg(F.count("*").alias("n"))


def exemplar_position(values: DataFrame, by: str, value: str) -> DataFrame:
    """A-14: median, least and greatest of a value for each group, and the median over the overall one (null where there is no value).

    Medians come from ranks of the sorted values, so a group may be of any size; nulls don't count.
    """
    bounds = values.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))
    medians = quantiles(values, [by], value, {"median": 0.5}).withColumnRenamed(by, "_by")
    per = bounds.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left")
    overall = quantiles(values, [], value, {"_all": 0.5})
    return per.withColumn("_all", overall.select("_all").scalar()).select(by, "median", "least", "greatest", ratio(F.col("median"), F.col("_all")).alias("relative"))


def placed_paragraphs(paragraphs: DataFrame, key: str) -> DataFrame:
    """W-19: paragraphs (key, paragraph, words: array) with base, the running number of their first word; only their sizes are sorted."""
    before = W.partitionBy(key).orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)
    return paragraphs.withColumn("base", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)).cast("bigint"))


def introductions(placed: DataFrame, key: str) -> DataFrame:
    """W-10: the first use of each term: key, term, paragraph, offset, uses.

    Words are numbered in the order of paragraphs, so the least paragraph and the least offset of a term are those of its first use; both are
    single values, which Spark adds up by hashes, without a sort of all words.
    """
    tokens = placed.select(key, "paragraph", "base", F.posexplode("words").alias("_p", "term"))
    first = tokens.groupBy(key, "term").agg(F.min("paragraph").alias("paragraph"), F.min(F.col("base") + F.col("_p")).alias("offset"), F.count("*").alias("uses"))
    return first.select(key, "term", "paragraph", "offset", "uses")


def pacing(paragraphs: DataFrame, key: str, reach: int = 1500, burst: int = 3) -> DataFrame:
    """A-13, W-09, W-11: pacing of the introduction of terms in each document.

    paragraphs: key, paragraph, words (array of terms); rows without a key don't count.  Live load of a paragraph is the number of terms
    introduced within ``reach`` before its end; a burst is a paragraph with ``burst`` introductions or more.  Words are shuffled and exploded once,
    by key, and all that follows stays in these partitions: an entry behind a paragraph's words stands for its end, so ends and first uses come
    from one table.  A load is a running sum of the terms introduced by an end less those out of reach there (rows that only documents longer than
    ``reach`` have).  It is at most ``reach`` + 1, which bounds the buffer of its percentile.
    """
    n, at = F.size("words"), F.col("base") + F.col("_p")
    placed = placed_paragraphs(paragraphs.filter(F.col(key).isNotNull()), key).withColumn("_last", F.sum(n).over(W.partitionBy(key)) - 1).filter(n > 0)
    tokens = placed.select(key, "paragraph", "base", "_last", (F.col("base") + n - 1).alias("_end"), F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("_p", "_term"))
    closes = F.when(at > F.col("_end"), F.col("paragraph"))  # null for words
    gone = F.when(at + reach < F.col("_last"), at + reach + 1)  # the first place that a term used here is out of reach of
    first = tokens.groupBy(key, "_term", closes.alias("_closes")).agg(F.min("_end").alias("_end"), F.min(gone).alias("_gone"), F.count("*").alias("_uses"))
    word = F.col("_closes").isNull()
    met = first.groupBy(key, "_end", F.when(word, F.col("_gone")).alias("_gone")).agg(
        F.count_if(word).alias("new"), F.sum(F.when(word, F.col("_uses")).otherwise(0)).alias("words"), F.count_if(word & (F.col("_uses") == 1)).alias("single"), F.count_if(~word).alias("ends")
    )
    names, none = ("new", "words", "single", "ends"), F.lit(0).cast("bigint")
    come = F.struct(F.col("_end").alias("at"), *names, none.alias("old"))
    go = F.struct(F.col("_gone").alias("at"), *(none.alias(c) for c in names), F.col("new").alias("old"))
    events = met.select(key, F.inline(F.when(F.col("_gone").isNull(), F.array(come)).otherwise(F.array(come, go))))
    events = events.groupBy(key, "at").agg(*(F.sum(c).alias(c) for c in (*names, "old")))
    load = F.sum(F.col("new") - F.col("old")).over(W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    is_end = F.col("ends") > 0
    sums = events.withColumn("_load", F.when(is_end, load)).groupBy(key).agg(
        F.sum("words").alias("words"), F.sum("new").alias("terms"), F.sum("single").alias("_single"), F.count_if(is_end).alias("_ends"), F.count_if(is_end & (F.col("new") >= burst)).alias("_bursts"),
        F.max("new").alias("max_burst"), F.avg("_load").alias("load_mean"), F.percentile("_load", F.lit(0.95)).alias("load_p95"),
    )
    return sums.select(
        key, "words", "terms", ratio(F.col("words"), F.col("terms")).alias("words_per_term"), ratio(1000.0 * F.col("terms"), F.col("words")).alias("intro_per_1000"),
        ratio(F.col("_single"), F.col("terms")).alias("singleton_share"), (F.col("words") / F.col("terms")).alias("mean_uses"), ratio(F.col("_bursts"), F.col("_ends")).alias("burst_share"), "max_burst", "load_mean", "load_p95",
    )
