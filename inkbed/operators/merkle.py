"""Hash trees of tables: one digest for each subtree of keys, and a diff that reads only the subtrees that differ.

Rows are leaves; the hash of a row's key says where it stands, one hex digit a level, so two trees of one depth have the same shape
whatever rows are missing.  A bucket at the lowest level hashes its rows in order, and a node above hashes its children: no node has
more than ``FAN`` of them, no task gathers a table, and a change touches one path.  Trees are written with a folder for each of
the first ``FOLDERS`` digits, which a diff opens only where the digests of those folders differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbed.session import written

FAN = 16
#: Digits of the hash that name a folder: at most 16**2 folders.
FOLDERS = 2
#: Rows of a bucket at the lowest level, on average.
BUCKET_ROWS = 64
_LEAF, _NODE = "key string, place string, digest string", "level int, prefix string, digest string"


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values as JSON, in order, nulls kept: no two rows of different values have one text."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def depth_for(rows: int) -> int:
    """Levels below the root so that a bucket has some BUCKET_ROWS rows; at least the folders' digits."""
    depth = FOLDERS
    while rows > BUCKET_ROWS * FAN**depth:
        depth += 1
    return depth


def leaves(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key (as text), place (hash of the key) and digest of each row."""
    name = F.col(key).cast("string")
    return rows.select(name.alias("key"), F.sha2(F.coalesce(F.concat(F.lit("="), name), F.lit("null")), 256).alias("place"), row_digest(columns).alias("digest"))


def _digest_of(*order: str) -> Column:
    """One digest for a node: of its children's names and digests in order."""
    children = F.sort_array(F.collect_list(F.struct(*order, "digest")))
    return F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", *(x[c] for c in order), x["digest"])), ","), 256)


def nodes(leaf: DataFrame, depth: int) -> DataFrame:
    """level (0: the root), prefix and digest of all nodes that have a leaf below; a level is made of the one below it."""
    level = leaf.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(_digest_of("place").alias("digest")).transform(written)
    out = level.select(F.lit(depth).alias("level"), "prefix", "digest")
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, k).alias("_p")).agg(_digest_of("prefix").alias("digest")).withColumnRenamed("_p", "prefix").transform(written)
        out = out.unionByName(level.select(F.lit(k).alias("level"), "prefix", "digest"))
    return out


def write(rows: DataFrame, key: str, columns: Sequence[str], path: str, depth: int) -> None:
    """Writes a table's tree: ``leaves`` and ``nodes`` by folder, and ``top`` with the levels down to the folders."""
    leaf = leaves(rows, key, columns).withColumn("folder", F.substring("place", 1, FOLDERS))
    leaf.repartition("folder").write.partitionBy("folder").parquet(f"{path}/leaves")
    found = nodes(rows.sparkSession.read.schema(f"{_LEAF}, folder string").parquet(f"{path}/leaves"), depth)
    below = found.filter(F.col("level") > FOLDERS).withColumn("folder", F.substring("prefix", 1, FOLDERS))
    below.repartition("folder").write.partitionBy("folder").parquet(f"{path}/nodes")
    found.filter(F.col("level") <= FOLDERS).write.parquet(f"{path}/top")


def root(spark: SparkSession, path: str) -> str | None:
    """The digest of a whole table; None for an empty one."""
    found = spark.read.schema(_NODE).parquet(f"{path}/top").filter("level = 0").first()
    return found["digest"] if found else None


def _differing(old: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """Where two tables of (on, digest) differ: nodes of either side alone, too."""
    both = old.select(on, F.col("digest").alias("_old")).join(new.select(on, F.col("digest").alias("_new")), on, "full")
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(on)


def _part(spark: SparkSession, path: str, kind: str, folders: list[str]) -> DataFrame:
    fields = _LEAF if kind == "leaves" else _NODE
    return spark.read.schema(f"{fields}, folder string").parquet(f"{path}/{kind}").filter(F.col("folder").isin(folders))


def diff(spark: SparkSession, old: str, new: str, depth: int) -> DataFrame:
    """key and change (added, removed, changed) between two written trees of one depth whose keys are unique.

    The levels of the folders come first: equal ones (at most 256, known to the driver) are never opened.  Below, each level keeps the
    children of nodes that differ; leaves are read in buckets that differ.
    """
    top = [spark.read.schema(_NODE).parquet(f"{p}/top").filter(F.col("level") == FOLDERS) for p in (old, new)]
    folders = sorted(r["prefix"] for r in _differing(*top, "prefix").collect())
    wanted = None
    for k in range(FOLDERS + 1, depth + 1):
        level = [_part(spark, p, "nodes", folders).filter(F.col("level") == k) for p in (old, new)]
        if wanted is not None:
            above = wanted.withColumnRenamed("prefix", "_above")
            level = [x.join(above, F.substring("prefix", 1, k - 1) == F.col("_above"), "left_semi") for x in level]
        wanted = _differing(*level, "prefix")
    leaf = [_part(spark, p, "leaves", folders) for p in (old, new)]
    if wanted is not None:
        leaf = [x.join(wanted.withColumnRenamed("prefix", "_above"), F.substring("place", 1, depth) == F.col("_above"), "left_semi") for x in leaf]
    before, after = (x.select("place", F.struct("key", "digest").alias(n)) for x, n in zip(leaf, ("_old", "_new"), strict=True))
    both = before.join(after, "place", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old.digest") != F.col("_new.digest"), "changed")
    return both.select(F.coalesce("_old.key", "_new.key").alias("key"), change.alias("change")).filter("change IS NOT NULL")
