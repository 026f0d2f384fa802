"""Segmentation of texts into gapless located spans, windows over spans, and line ranges of sections.

Offsets are code points (half-open), as Spark's length and substring count them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """G-06, C-27: key, line_no, start, end and line of each line; the line break belongs to the line before it."""
    lines = docs.select(key, F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    placed = lines.select(key, F.posexplode("l").alias("line_no", "line"), F.size("l").alias("_n"))
    size = F.length("line") + F.when(F.col("line_no") < F.col("_n") - 1, 1).otherwise(0)
    before = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    out = placed.withColumn("_size", size).withColumn("start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return out.select(key, F.col("line_no").cast("bigint").alias("line_no"), F.col("start").cast("bigint"), (F.col("start") + F.col("_size")).cast("bigint").alias("end"), "line")


def span_kind(line):
    """Kind of a line span: whitespace, heading (no end mark and at most 8 words) or prose."""
    return F.when(F.trim(line) == "", "whitespace").when(~line.rlike("[.!?]$") & (F.size(F.split(line, " ")) <= 8), "heading").otherwise("prose")


def span_id(source_hash, source_file, start, end):
    """Identity of a span: "span-" and 16 hex digits of the hash of its parts, joined by NUL."""
    joined = F.concat_ws("\u0000", source_hash, source_file, start.cast("string"), end.cast("string"))
    return F.concat(F.lit("span-"), F.substring(F.sha2(joined, 256), 1, 16))


def object_id(source_file, kind, start, end):
    """Identity of a protected object, in the same way."""
    joined = F.concat_ws("\u0000", source_file, kind, start.cast("string"), end.cast("string"))
    return F.concat(F.lit("obj-"), F.substring(F.sha2(joined, 256), 1, 16))


def windows(spans: DataFrame, key: str, order: str, size: int = 15, overlap: int = 3) -> DataFrame:
    """G-15: spans dealt to overlapping windows: window k holds the spans from k * stride on, ``size`` of them.

    Windows begin at each stride that is inside the sequence, so the last may be a subset of the one before.
    """
    stride = size - overlap
    rn = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    numbered = spans.withColumn("_rn", rn)
    first = F.greatest(F.lit(0), F.ceil((F.col("_rn") - (size - 1)) / stride))
    return numbered.withColumn("window", F.explode(F.sequence(first.cast("bigint"), F.floor(F.col("_rn") / stride)))).withColumn("role", F.lit("core"))


def neighbours(windowed: DataFrame, spans: DataFrame, key: str, order: str, reach: int = 2) -> DataFrame:
    """G-15: the spans up to ``reach`` before and after each window."""
    edges = windowed.groupBy(key, "window").agg(F.min("_rn").alias("_lo"), F.max("_rn").alias("_hi"))
    near = edges.withColumn("_rn", F.explode(F.concat(F.sequence(F.col("_lo") - reach, F.col("_lo") - 1), F.sequence(F.col("_hi") + 1, F.col("_hi") + reach))))
    numbered = spans.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)
    return near.select(key, "window", "_rn").join(numbered, [key, "_rn"])


def section_ranges(lines: DataFrame, key: str, is_heading) -> DataFrame:
    """C-38, W-12: first and last line of each section; the first begins at line 0; without a heading the whole is one."""
    marked = lines.withColumn("_h", is_heading.cast("int"))
    every = W.partitionBy(key)
    number = F.sum("_h").over(every.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    placed = marked.withColumn("section", F.greatest(number, F.lit(1)))  # what is before the first heading belongs to its section
    return placed.groupBy(key, "section").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def section_structure(lines: DataFrame, key: str) -> DataFrame:
    """C-38, J-20: sections and subsections of a file's lines (key, line_no from 1, line) with inclusive line ranges.

    key, title, first_line, last_line, parent (null for a section).  The first section begins at line 1; a file without a section is one,
    "(entire file)".  A subsection belongs to the section in whose lines it starts and ends with it at the latest; one before all sections
    belongs to none and is left out.
    """
    n = lines.groupBy(key).agg(F.max("line_no").alias("_n"))
    head = lambda name: F.regexp_extract("line", "\\\\" + name + "\\{([^}]+)\\}", 1)
    heads = lines.select(key, "line_no", head("section").alias("_s"), head("subsection").alias("_u")).filter("_s != '' OR _u != ''")
    secs = heads.filter("_s != ''").withColumn("_next", F.lead("line_no").over(W.partitionBy(key).orderBy("line_no"))).join(n, key)
    secs = secs.select(key, F.trim("_s").alias("title"), F.col("line_no").alias("_at"), F.coalesce(F.col("_next") - 1, "_n").alias("last_line"))
    none = F.lit(None).cast("string")
    first = F.when(F.row_number().over(W.partitionBy(key).orderBy("_at")) == 1, F.lit(1)).otherwise(F.col("_at"))
    sections = secs.select(key, "title", first.cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"), none.alias("parent"))
    whole = n.join(secs.select(key).distinct(), key, "left_anti").select(key, F.lit("(entire file)").alias("title"), F.lit(1).cast("bigint").alias("first_line"), F.col("_n").cast("bigint").alias("last_line"), none.alias("parent"))
    marks = heads.filter("_s = ''").select(key, F.trim("_u").alias("title"), F.col("line_no").alias("_at"))
    held = marks.join(secs.select(F.col(key).alias("_k"), F.col("title").alias("parent"), F.col("_at").alias("_from"), F.col("last_line").alias("_to")), (F.col(key) == F.col("_k")) & F.col("_at").between(F.col("_from"), F.col("_to")))
    end = F.lead("_at").over(W.partitionBy(key, "_from").orderBy("_at")) - 1
    subs = held.select(key, "title", F.col("_at").cast("bigint").alias("first_line"), F.coalesce(end, "_to").cast("bigint").alias("last_line"), "parent")
    return sections.unionByName(whole).unionByName(subs)


def matches(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, raw, start: each match of a pattern without groups, with its place; the text between matches tells where they are."""
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("raw"))
    found = rows.select(key, F.posexplode(parts).alias("_i", "_m")).select(key, "_i", F.col("_m.gap").alias("_gap"), F.col("_m.raw").alias("raw"))
    size = F.length("_gap") + F.coalesce(F.length("raw"), F.lit(0))
    end = F.sum(size).over(W.partitionBy(key).orderBy("_i"))
    return found.withColumn("start", end - F.coalesce(F.length("raw"), F.lit(0))).filter("raw IS NOT NULL").select(key, "raw", "start")
