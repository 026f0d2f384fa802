"""Registration of queries and helpers that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader: ``t("documents")`` is that table."""

    def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return put


def manuscripts(docs: DataFrame) -> DataFrame:
    """Documents as small LaTeX files: doc_id, tex and a revised copy (what changes goes by doc_id)."""
    bs, nl = F.chr(F.lit(92)), F.lit("\n")
    head = F.concat(bs, F.lit("section{D"), F.col("doc_id").cast("string"), F.lit("}\n\n"))
    body = F.replace("text", nl, F.lit("\n\n"))
    cite, label = F.concat(bs, F.lit("cite{"), F.col("source"), F.lit("}")), F.concat(bs, F.lit("label{d"), F.col("doc_id").cast("string"), F.lit("}"))
    m = F.col("doc_id") % 5
    new_cite = F.when(m == 1, F.concat(bs, F.lit("cite{x"), F.col("source"), F.lit("}"))).when(m == 2, F.concat(bs, F.lit("cite{ "), F.col("source"), F.lit("}"))).otherwise(cite)
    new_label = F.when(m == 0, F.lit("")).when(m == 3, F.concat(label, F.lit(" "), bs, F.lit("label{extra}"))).otherwise(label)
    tail = lambda c, l: F.concat(F.lit("\n\nSee "), c, F.lit(" "), l, F.lit(", again "), cite, F.lit("."))
    return docs.select("doc_id", F.concat(head, body, tail(cite, label)).alias("tex"), F.concat(head, body, tail(new_cite, new_label)).alias("revised"))


#: The same view in SQL.
MANUSCRIPTS = """
m AS (
  SELECT doc_id, chr(92) || 'section{D' || doc_id || '}' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'See ' AS base,
         chr(92) || 'cite{' || source || '}' AS cite, chr(92) || 'label{d' || doc_id || '}' AS lab, doc_id % 5 AS k, source FROM documents
),
ms AS (
  SELECT doc_id, base || cite || ' ' || lab || ', again ' || cite || '.' AS tex,
         base || CASE k WHEN 1 THEN chr(92) || 'cite{x' || source || '}' WHEN 2 THEN chr(92) || 'cite{ ' || source || '}' ELSE cite END || ' '
         || CASE k WHEN 0 THEN '' WHEN 3 THEN lab || ' ' || chr(92) || 'label{extra}' ELSE lab END || ', again ' || cite || '.' AS revised FROM m
)"""

#: Lines with offsets in SQL: l(doc_id, line_no, start, "end", line).
LINES = """
l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line, len(ls) AS n FROM l0),
l2 AS (SELECT *, length(line) + CASE WHEN line_no < n - 1 THEN 1 ELSE 0 END AS size FROM l1),
l AS (SELECT doc_id, line_no::BIGINT AS line_no, line, size, (sum(size) OVER (PARTITION BY doc_id ORDER BY line_no) - size)::BIGINT AS start,
      (sum(size) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS "end" FROM l2)"""

#: The bibliographic form of text in SQL.
BIB = "trim(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def canonical_sql(*values: str) -> str:
    """The text of functions.text.canonical in SQL."""
    return " || ".join(f"coalesce(length(({v})::VARCHAR) || ':' || ({v})::VARCHAR || ';', 'null;')" for v in values)
