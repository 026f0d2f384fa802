"""Mixing sources to target weights by a low-discrepancy schedule (native).

The mix is a sequence of slots of ``block`` words each, a number that doesn't depend on the corpus.  Slot t belongs to the
source in whose share of the cumulative weights the t-th point of a golden-ratio sequence falls, so every stretch of the
schedule is close to the target weights.  Each source's documents are laid out on a line of words in a hashed (shuffled)
order; the line, pass after pass, is cut off at the source's target in whole words and cut into equal blocks; the k-th slot
of a source takes its k-th block.  Blocks that the schedule has no slot for (a few for each source, by rounding) follow in
slots of their own at the end.  So each source delivers its target to the word.  All of it is arithmetic on whole
numbers and hashes, and reruns agree.

Scale: running sums and ranks go over (source, hash bucket) and a small table of bucket totals, so a source that holds a third
of all rows is spread over all tasks; slots find their source by a join on cells of the circle, so many sources cost no more
for each slot than few; the schedule meets the blocks by (source, number), which no source can make hot.  Tables of one row for
each source, and for each source and bucket, are gathered.

Defined cases: a null source is a source of its own, last in order; null and empty texts have size 0 and are taken 0 words; a
very long text is many blocks of many slots; repeated rows are laid out one after another, those of one hash in order of size;
rows without doc_id are shuffled by their texts; extra columns are not carried, so their names don't matter; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import WORD
from .tables import kept

#: Weights by the source's place in code point order, repeating, and the most passes over a source.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Words in a block, whatever the size of the corpus.
BLOCK = 256
#: 2**32 / golden ratio, the step of the schedule's points on a circle of 2**32.
GOLDEN_STEP = 2654435769
CIRCLE = 1 << 32
#: The circle has 2**32 / 2**CELL_BITS cells, by which points meet shares.
CELL_BITS = 20
#: The most sources whose shares are broadcast (24 bytes each, and as many again for the cells).
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and _own, the digest of a text without doc_id, by which it is shuffled."""
    own = F.when(F.col("doc_id").isNull(), F.md5("text"))
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), own.alias("_own"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row for each source: source, rank (0, 1, ...), source_size and target.

    Water filling in closed form: in ascending order of cap over weight, sources are capped for as long as the
    level that the rest would get is above their cap; the others share what is left by weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")
    )
    every = W.partitionBy(F.lit(1))
    filling = every.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    cap = F.col("source_size") * max_passes
    leveled = weighted.withColumn(
        "level", (F.sum("source_size").over(every) - max_passes * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ).withColumn("capped", F.col("level") * F.col("weight") >= cap)
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)["level"]
    return leveled.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(level * F.col("weight"))).select(
        "source", "rank", "source_size", "target"
    )


def _prefix(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of value over the earlier rows of the same keys, in order of (bucket, order), without one task for each key."""
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_in_bucket"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_here", F.sum(value).over(inside) - value)
        .join(offsets, [*keys, bucket])
        .withColumn(name, F.col("_here") + F.col("_offset"))
        .drop("_here", "_offset")
    )


def bucket_digits(rows: int, most: int = 20_000) -> int:
    """Hex digits of the shuffle key that make buckets of some ``most`` rows."""
    digits = 2
    while rows > most * 16**digits:
        digits += 1
    return digits


def layout(sized: DataFrame, ranks: DataFrame, digits: int) -> DataFrame:
    """Documents on their source's line of words, in shuffled order: adds rank and start.

    The order is that of md5(doc_id), of the text where there is none, whatever the number of buckets, which are its first hex digits.
    """
    same = sized["source"].eqNullSafe(ranks["source"])
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), "_own", F.lit(""))
    rows = sized.join(ranks, same).drop(ranks["source"]).withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    return _prefix(rows, ["rank"], "_bucket", [F.col("_key"), F.col("size")], F.col("size"), "start").drop("_bucket", "_key", "_own")


def schedule(targets_: DataFrame, slots: int, buckets: int) -> DataFrame:
    """slot, rank of its source, and k: its number among the source's slots (0, 1, ...)."""
    spark = targets_.sparkSession
    whole = W.partitionBy(F.lit(1))
    ends = targets_.filter("target > 0").withColumn("_sum", F.sum("target").over(whole.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    bounds = ends.select("rank", F.round(F.col("_sum") / F.max("_sum").over(whole) * CIRCLE).cast("bigint").alias("_to"))
    bounds = bounds.withColumn("_since", F.lag("_to", 1, 0).over(whole.orderBy("rank"))).filter("_since < _to")
    cells = bounds.withColumn("_cell", F.explode(F.sequence(F.shiftright("_since", CELL_BITS), F.shiftright(F.col("_to") - 1, CELL_BITS))))
    if targets_.count() <= BROADCAST_SOURCES:
        cells = F.broadcast(cells)
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN_STEP % CIRCLE).alias("_point"))
    dealt = points.withColumn("_cell", F.shiftright("_point", CELL_BITS)).join(cells, "_cell").filter("_point >= _since AND _point < _to")
    dealt = dealt.select("slot", "rank", F.floor(F.col("slot") * buckets / slots).alias("_bucket"))
    return _prefix(dealt, ["rank"], "_bucket", [F.col("slot")], F.lit(1).cast("bigint"), "k").drop("_bucket")


def goals_in_words(targets_: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Adds goal: the target in whole words, by rounded running sums, so that the goals add up as the targets do."""
    by_rank = W.partitionBy(F.lit(1)).orderBy("rank")
    rows = targets_.withColumn("_end", F.round(F.sum("target").over(by_rank.rowsBetween(W.unboundedPreceding, 0))).cast("bigint"))
    own = F.col("_end") - F.coalesce(F.lag("_end").over(by_rank), F.lit(0))
    return rows.withColumn("goal", F.least(own, F.col("source_size") * max_passes)).drop("_end")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block: int = BLOCK) -> DataFrame:
    """The mix itself: slot, pass, doc_id, source and the words [from, to) of the document that the slot takes."""
    return _mixed(docs, weights, max_passes, block)[0].select("slot", "pass", "doc_id", "source", "from", "to")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block: int = BLOCK) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target and taken, the words that the mix takes of it.

    Where the schedule puts them: pieces (0 if nothing is taken), first_slot and last_slot (null then).
    """
    pieces, placed = _mixed(docs, weights, max_passes, block)
    sums = pieces.groupBy("rank", "start").agg(  # a place is one document's
        F.sum(F.col("to") - F.col("from")).alias("taken"), F.count("*").alias("pieces"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )
    none = F.lit(None).cast("bigint")
    empty = placed.filter("size = 0").withColumns({"taken": none, "pieces": none, "first_slot": none, "last_slot": none})
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("taken", "pieces")]
    columns = ["doc_id", "source", "size", "source_size", "target", *counts, "first_slot", "last_slot"]
    return placed.filter("size > 0").join(sums, ["rank", "start"], "left").select(*columns).unionByName(empty.select(*columns))


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_passes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(pieces, layout)."""
    sized = kept(sizes(docs), "sizes")  # the texts are read once
    goals = kept(goals_in_words(targets(sized, weights, max_passes), max_passes), "targets")  # one row for each source
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slots = -(-total // block)
    placed = kept(layout(sized, goals, bucket_digits(rows)), "layout")
    dealt = kept(schedule(goals.select("rank", "target"), slots, max(64, slots // 20_000)).select("slot", "rank", "k"), "schedule")
    had = goals.join(dealt.groupBy("rank").agg(F.count("*").alias("_had")), "rank", "left")
    lacks = had.select("rank", F.coalesce("_had", F.lit(0)).alias("_had"), F.ceil(F.col("goal") / block).alias("_need")).withColumn("_lack", F.greatest(F.col("_need") - F.col("_had"), F.lit(0)))
    earlier = F.coalesce(F.sum("_lack").over(W.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lacks = lacks.withColumn("_before", earlier).filter("_lack > 0")
    final = lacks.select("rank", "_had", "_before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lack") - 1)).alias("_i"))
    dealt = dealt.unionByName(final.select((F.lit(slots) + F.col("_before") + F.col("_i")).alias("slot"), "rank", (F.col("_had") + F.col("_i")).alias("k")))
    lines = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_passes - 1).cast("bigint"))))
    lines = lines.withColumn("_at", F.col("pass") * F.col("source_size") + F.col("start")).withColumn("_end", F.least(F.col("_at") + F.col("size"), F.col("goal"))).filter("_at < _end")
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_end") - 1) / block)
    cuts = lines.withColumn("k", F.explode(F.sequence(first, last)))
    begin, end = F.col("k") * block, (F.col("k") + 1) * block
    # a table of slots is small as a file, but not in memory: never broadcast
    pieces = cuts.hint("merge").join(dealt, ["rank", "k"]).select(
        "slot",
        "pass",
        "rank",
        "start",
        "doc_id",
        "source",
        (F.greatest(begin, F.col("_at")) - F.col("_at")).alias("from"),
        (F.least(end, F.col("_end")) - F.col("_at")).alias("to"),
    )
    return pieces, placed
