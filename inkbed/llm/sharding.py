"""Uniform shuffle into shards by a hypergeometric communication matrix (native).

Documents lie in partitions.  First only counts are drawn: a matrix says how many rows of each partition go to each shard, distributed
exactly as a uniform random permutation of all rows would have it, while its columns add up to the shards' sizes, which are fixed
(at most one apart).  Then each partition permutes its rows and cuts them up by its line of the matrix, the rows are exchanged,
and each shard permutes what it got.  Every order of all rows is equally likely, as far as the hashes that stand for coins are random.

The matrix is drawn from the top down: a node of a tree has a number of rows for each shard, and deals them to up to ``FAN`` children,
one multivariate hypergeometric draw for each.  A draw inverts the distribution by the ratios of neighbouring probabilities, from
``REACH`` deviations below the mode to as many above it (what lies beyond has a smaller chance than a coin of 53 bits can show).  All coins are hashes of a
document's id, size and checksum, of the seed, and of places in the tree, so that reruns and retries of tasks agree.

Scale: rows of some 50 bytes are shuffled twice, by partition and by shard and bucket; texts stay where they are.  Partitions have
about ``ROWS`` rows, the matrix is a line of counts for each of them and is drawn by as many tasks as its nodes; a partition that
repeated rows make too large is cut up by place.  A draw takes time with the square root of its rows; the root's, some minute in one
task for 10**11 rows, are the slowest.  A shard of any size is permuted in buckets: the hash that orders it says which.

Defined cases: a null text has size 8 and the checksum of an empty one; rows without doc_id are dealt like others; repeated rows are
rows of their own, each with a slot; which of them has which doesn't show; very long texts are read once; extra columns are not
carried, so their names don't matter; fewer rows than shards leave the last shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .columns import let
from .tables import kept

SHARDS = 24
#: Bytes that each document counts beside its text (fixed value).
OVERHEAD = 8
#: Rows of a partition, on average, and the least number of partitions.
ROWS = 20_000
PARTITIONS = 64
#: A partition of more than so many times ROWS is cut up.
OVERFULL = 3
#: Children of a node of the tree in which the matrix is drawn.
FAN = 8
#: Deviations from the mode up to which a draw looks.
REACH = 9
SEED = 20240


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_sizes(rows: int, shards: int) -> list[int]:
    """At most one apart, the larger ones first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def coin(*of: Column | int | str) -> Column:
    """A number from 0 up to 1 that goes by the given values: 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*(x if isinstance(x, Column) else F.lit(x) for x in of)), 11) * F.lit(2.0**-53)


def hypergeometric(u: Column, urn: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` balls are marked, if an urn has so many and so many of them are: the quantile at u (bigint).

    Chances go by their ratio to the one at the lowest value looked at, so no factorial is needed.
    """

    def bounds(v: Column) -> Column:
        least = F.greatest(F.lit(0).cast("bigint"), v["n"] + v["k"] - v["t"])
        most = F.least(v["n"], v["k"])
        mode = F.floor((v["n"] + 1) * ((v["k"] + 1) / (v["t"] + 2)))
        p = v["k"] / v["t"]
        reach = F.ceil(REACH * F.sqrt(v["n"] * p * (1 - p) * ((v["t"] - v["n"]) / F.greatest(v["t"] - 1, F.lit(1).cast("bigint")))) + REACH)
        return F.struct(F.greatest(least, F.least(mode - reach, most)).alias("lo"), F.least(most, F.greatest(mode + reach, least)).alias("hi"))

    def search(v: Column, b: Column) -> Column:
        values = F.sequence(b["lo"], b["hi"])
        # chance of the next value over that of x
        ratio = lambda x: ((v["k"] - x).cast("double") * (v["n"] - x)) / ((x + 1).cast("double") * (v["t"] - v["k"] - v["n"] + x + 1))
        after = lambda s, x: F.when(x < b["hi"], s * ratio(x)).otherwise(F.lit(0.0))
        start = F.struct(F.lit(1e-100).alias("p"), F.lit(0.0).alias("sum"))
        total = F.aggregate(values, start, lambda s, x: F.struct(after(s["p"], x).alias("p"), (s["sum"] + s["p"]).alias("sum")), lambda s: s["sum"])
        begin = F.struct(F.lit(1e-100).alias("p"), F.lit(0.0).alias("sum"), b["lo"].alias("x"))
        return let(
            total * v["u"],
            lambda goal: F.aggregate(
                values,
                begin,
                lambda s, x: F.struct(
                    after(s["p"], x).alias("p"),
                    (s["sum"] + s["p"]).alias("sum"),
                    F.when((s["sum"] + s["p"] <= goal) & (x < b["hi"]), x + 1).otherwise(s["x"]).alias("x"),
                ),
                lambda s: s["x"],
            ),
        )

    given = F.struct(u.alias("u"), urn.alias("t"), marked.alias("k"), drawn.alias("n"))
    return let(
        given,
        lambda v: F.when((v["n"] == 0) | (v["k"] == 0), F.lit(0).cast("bigint"))
        .when(v["k"] == v["t"], v["n"])
        .when(v["n"] == v["t"], v["k"])
        .otherwise(let(bounds(v), lambda b: search(v, b))),
    )


def dealt(room: Column, rows: Column, *of: Column | int) -> Column:
    """How many of ``rows`` rows go to each shard, if all shards' room together is the urn (array of bigint)."""
    none = F.array().cast("array<bigint>")
    total = F.aggregate(room, F.lit(0).cast("bigint"), lambda s, x: s + x)
    start = F.struct(total.alias("urn"), rows.alias("left"), none.alias("got"))

    def step(s: Column, r: Column) -> Column:
        x = hypergeometric(coin(*of, F.size(s["got"])), s["urn"], r, s["left"])
        return let(x, lambda n: F.struct((s["urn"] - r).alias("urn"), (s["left"] - n).alias("left"), F.concat(s["got"], F.array(n)).alias("got")))

    return F.aggregate(room, start, step, lambda s: s["got"])


def _family_dealt(seed: int, level: int) -> Column:
    """Of a node's room, what each of its children gets, one after the other: array of (child, counts)."""
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<struct<child:bigint,counts:array<bigint>>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        def after(got: Column) -> Column:
            rest = F.zip_with(s["room"], got, lambda a, b: a - b)
            return F.struct(rest.alias("room"), F.concat(s["out"], F.array(F.struct(c["child"].alias("child"), got.alias("counts")))).alias("out"))

        return let(dealt(s["room"], c["rows"], seed, level, c["child"]), after)

    return F.aggregate("children", start, step, lambda s: s["out"])


def matrix(sizes: DataFrame, partitions: int, rows: int, shards: int, seed: int) -> DataFrame:
    """partition and counts: a line of the communication matrix for each row (partition, rows) of ``sizes``; partitions lie in [0, partitions)."""
    spark = sizes.sparkSession
    levels = 1
    while FAN**levels < partitions:
        levels += 1
    room = F.array(*(F.lit(n).cast("bigint") for n in shard_sizes(rows, shards)))
    nodes = spark.range(1).select(F.col("id").alias("node"), room.alias("room"))
    for level in range(levels - 1, -1, -1):
        child = F.floor(F.col("partition") / FAN**level)
        below = sizes.groupBy(child.alias("child")).agg(F.sum("rows").cast("bigint").alias("rows"))
        family = below.groupBy(F.floor(F.col("child") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "rows"))).alias("children"))
        drawn = nodes.join(family, "node").select(F.explode(_family_dealt(seed, level)).alias("c"))
        nodes = drawn.select(F.col("c.child").alias("node"), F.col("c.counts").alias("room"))
        if level:
            nodes = kept(nodes, "matrix")
    return nodes.select(F.col("node").alias("partition"), F.col("room").alias("counts"))


def _partitioned(rows: DataFrame, count: int, per: int) -> tuple[DataFrame, int, DataFrame]:
    """Rows with their partition, the number of partitions, and a table of their sizes (partition, rows)."""
    n = max(PARTITIONS, -(-count // per))
    sizes = kept(rows.groupBy((F.pmod("_deal", F.lit(n))).alias("partition")).agg(F.count("*").alias("rows")), "partitions")
    full = sizes.filter(F.col("rows") > OVERFULL * per)
    placed = rows.withColumn("partition", F.pmod("_deal", F.lit(n)))
    if full.isEmpty():
        return placed, n, sizes
    # repeated rows, or rows without doc_id and text: they are cut up by place, into partitions beyond the others
    parts = F.ceil(F.col("rows") / per)
    most = full.agg(F.max(parts)).first()[0]
    cut = full.select(F.col("partition").alias("_full"), parts.alias("_parts"))
    placed = placed.join(cut, F.col("partition") == F.col("_full"), "left")
    beyond = n + F.col("_full") * most + F.pmod(F.xxhash64("_place"), F.col("_parts"))
    placed = kept(placed.withColumn("partition", F.coalesce(beyond, "partition")).drop("_full", "_parts"), "placed")
    return placed, n * (most + 1), placed.groupBy("partition").agg(F.count("*").alias("rows"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, per: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in each shard)."""
    own = ("doc_id", "size", "text_crc32")
    rows = kept(measured(docs).withColumns({"_deal": F.xxhash64(F.lit(seed), *own), "_place": F.monotonically_increasing_id()}), "rows")  # texts are read once
    count = rows.count()
    placed, n, sizes = _partitioned(rows, count, per)
    lines = kept(matrix(sizes, n, count, shards, seed), "matrix")

    # each partition permutes its rows; the line of the matrix cuts them up
    order = W.partitionBy("partition").orderBy(F.xxhash64(F.lit(seed + 1), *own), *own, "_place")
    ends = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("bigint"), lambda s, x: s + x))
    cuts = lines.select("partition", ends.alias("ends"))
    inside = placed.withColumn("_at", F.row_number().over(order)).join(cuts, "partition")
    shard = F.size(F.filter("ends", lambda e: e < F.col("_at")))
    key = F.xxhash64(F.lit(seed + 2), "partition", "_at")
    sent = inside.select(*own, shard.alias("shard"), key.alias("_key"))

    # each shard permutes what it got: in buckets, the hash's upper part, so that no task has a whole shard
    buckets = max(4, -(-count // (per * shards)))
    bucket = F.floor((F.shiftrightunsigned("_key", 11) * F.lit(2.0**-53)) * buckets)
    sent = kept(sent.withColumn("_bucket", bucket), "sent")
    by_bucket = sent.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_bucket.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inner = W.partitionBy("shard", "_bucket").orderBy(F.shiftrightunsigned("_key", 1), "_key", *own)
    ranked = sent.withColumn("_rank", F.row_number().over(inner) - 1).join(offsets, ["shard", "_bucket"])
    return ranked.select(*own, "shard", (F.col("_rank") + F.col("_offset")).cast("bigint").alias("slot"))
