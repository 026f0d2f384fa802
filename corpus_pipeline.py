"""A corpus in five stages: language, near duplicates, repeated passages, contamination, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the shared folder and read
again as the next stage's docs.  All but the last return the columns of their docs.

Defined cases: an empty table passes through all stages as an empty one; extra columns, of whatever name, travel on; documents
without doc_id are neither copies' representatives nor cut, are judged by their own text, and are mixed like others; null and
empty texts go in the first stage; rows of one doc_id with different texts are different documents, repeated rows are one from
the second stage on; very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbed.llm import decontamination, jaccard, langid, mixing, suffixes
from inkbed.llm.tables import kept


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is among ids (column _id), nulls included."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any text in a language go."""
    found = langid.language_of(docs, langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))
    return docs.filter(found != langid.UNKNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the least doc_id stays, once; documents without doc_id all stay."""
    found = kept(jaccard.grouped(docs), "components")
    first = found.filter("doc_id = component_id")
    named, others = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # a doc_id doesn't tell the texts apart: the group's row is that of a doc_id and a class
        chosen = first.groupBy("doc_id", "part").agg(F.min("class").alias("class")).select(F.col("doc_id").alias("_id"), "class")
        rows = jaccard.classed(named).withColumn("_id", F.col("_row.doc_id").cast("bigint"))
        rest = rows.join(chosen, ["_id", "class"], "left_semi").dropDuplicates(["_id", "class"]).select("_row.*")
    else:
        rest = _holding(named, first.select(F.col("doc_id").alias("_id")))
    return rest.unionByName(others)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that also start earlier are cut out of the texts."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(True).alias("_is"), *others).alias("_others"))
    cut = suffixes.removed(rows, keep_text=True, keep=("_others",))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[new.get(c, F.col("_others")[c]).alias(c) for c in docs.columns])


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.taken(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("mix", mix),
]

#: The language stage learns a classifier, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
