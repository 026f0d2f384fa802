"""A bundle of review records that is derived from the documents' lines, the same in Spark and in SQL, with some defects.

A document is a baseline; its lines are spans, three lines a concept; concepts follow one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbed.operators import segment

from .base import LINES


class Bundle:
    """Tables of the bundle, made when asked for."""

    def __init__(self, t) -> None:
        self.lines = segment.line_spans(t("documents")).select("doc_id", "line_no", "start", "end", "line")

    @property
    def spans(self) -> DataFrame:
        return self.lines.select(
            "doc_id",
            "line_no",
            "start",
            "end",
            "line",
            F.expr("doc_id || ':' || line_no").alias("span_id"),
            F.expr("CASE WHEN (doc_id + line_no) % 11 = 0 THEN 'unresolved' WHEN line_no % 3 = 2 THEN 'non_substantive_scaffolding' ELSE 'concept_bearing' END").alias("disposition"),
            F.expr("CASE WHEN line_no % 3 != 2 AND (doc_id + line_no) % 13 != 0 THEN 'C' || doc_id || ':' || (line_no div 3) END").alias("concept_id"),
            F.expr("CASE WHEN line_no % 3 = 2 AND (doc_id + line_no) % 17 != 0 THEN 'S' || doc_id || ':' || line_no END").alias("scaffolding_id"),
        )

    @property
    def concepts(self) -> DataFrame:
        rows = self.lines.filter("line_no % 3 = 0").select("doc_id", F.expr("line_no div 3").alias("k"))
        return rows.select(
            "doc_id",
            "k",
            F.expr("'C' || doc_id || ':' || k").alias("concept_id"),
            F.expr("CASE (doc_id + k) % 9 WHEN 0 THEN 'proposed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'ambiguous' ELSE 'accepted' END").alias("review_status"),
            F.expr("CASE WHEN (doc_id + k) % 19 != 0 THEN ((doc_id * 7 + k) % 10) / 10D END").alias("confidence"),
        )

    @property
    def links(self) -> DataFrame:
        """Spans that concepts name; some don't exist, some are far away."""
        own = self.lines.filter("line_no % 3 != 2").selectExpr("'C' || doc_id || ':' || (line_no div 3) AS concept_id", "CASE WHEN (doc_id + line_no) % 23 = 0 THEN doc_id || ':x' ELSE doc_id || ':' || line_no END AS span_id", "doc_id")
        far = self.lines.filter("line_no % 3 = 0 AND line_no > 0").selectExpr("'C' || doc_id || ':0' AS concept_id", "doc_id || ':' || line_no AS span_id", "doc_id")
        return own.unionByName(far)

    @property
    def scaffolding(self) -> DataFrame:
        return self.lines.filter("line_no % 3 = 2").selectExpr(
            "doc_id", "'S' || doc_id || ':' || line_no AS scaffolding_id", "element_at(array('unresolved', 'move_backstage', 'remove_nonconcept', 'retain'), CAST((doc_id + line_no) % 4 + 1 AS INT)) AS decision", "(doc_id + line_no) % 5 != 0 AS extracted"
        )

    @property
    def dependencies(self) -> DataFrame:
        return self.concepts.filter("k > 0").selectExpr(
            "doc_id",
            "'D' || doc_id || ':' || k AS dependency_id",
            "CASE (doc_id + k) % 10 WHEN 3 THEN 'C' || doc_id || ':' || (k + 1000) WHEN 4 THEN concept_id WHEN 5 THEN NULL ELSE 'C' || doc_id || ':' || (k - 1) END AS prerequisite",
            "concept_id AS dependent",
        )

    @property
    def obligations(self) -> DataFrame:
        return self.concepts.filter("(doc_id + k) % 14 != 6").selectExpr(
            "doc_id",
            "k",
            "'O' || doc_id || ':' || k AS obligation_id",
            "CASE (doc_id + k) % 16 WHEN 3 THEN NULL WHEN 5 THEN 'C' || doc_id || ':none' ELSE concept_id END AS concept_id",
            "(doc_id + k) % 6 != 5 AS active",
            "(doc_id + 2 * k) % 7 AS functions",
            "CASE WHEN (doc_id + 3 * k) % 8 = 0 THEN 'unresolved' ELSE 'unassessed' END AS status",
            "CASE WHEN (doc_id + k) % 12 = 5 THEN '' ELSE 'merged' END AS reason",
        )

    @property
    def planned(self) -> DataFrame:
        """Concepts of units: two each, some twice, some missing, some unknown."""
        own = self.concepts.filter("(doc_id + k) % 12 != 7").selectExpr("'U' || doc_id || ':' || (k div 2) AS unit_id", "concept_id", "doc_id")
        twice = self.concepts.filter("(doc_id + k) % 20 = 1").selectExpr("'U' || doc_id || ':' || ((k + 2) div 2) AS unit_id", "concept_id", "doc_id")
        unknown = self.concepts.filter("(doc_id + k) % 25 = 2").selectExpr("'U' || doc_id || ':' || (k div 2) AS unit_id", "concept_id || 'x' AS concept_id", "doc_id")
        return own.unionByName(twice).unionByName(unknown)

    @property
    def assigned(self) -> DataFrame:
        """Obligations of units; some are assigned to none, some don't exist."""
        own = self.concepts.filter("(doc_id + k) % 15 != 7").selectExpr("'U' || doc_id || ':' || (k div 2) AS unit_id", "'O' || doc_id || ':' || k AS obligation_id")
        return own


BUNDLE = f"""{LINES},
sp AS (SELECT doc_id, line_no, start, "end", line, doc_id || ':' || line_no AS span_id,
  CASE WHEN (doc_id + line_no) % 11 = 0 THEN 'unresolved' WHEN line_no % 3 = 2 THEN 'non_substantive_scaffolding' ELSE 'concept_bearing' END AS disposition,
  CASE WHEN line_no % 3 <> 2 AND (doc_id + line_no) % 13 <> 0 THEN 'C' || doc_id || ':' || (line_no // 3) END AS concept_id,
  CASE WHEN line_no % 3 = 2 AND (doc_id + line_no) % 17 <> 0 THEN 'S' || doc_id || ':' || line_no END AS scaffolding_id FROM l),
co AS (SELECT doc_id, line_no // 3 AS k, 'C' || doc_id || ':' || (line_no // 3) AS concept_id,
  CASE (doc_id + line_no // 3) % 9 WHEN 0 THEN 'proposed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'ambiguous' ELSE 'accepted' END AS review_status,
  CASE WHEN (doc_id + line_no // 3) % 19 <> 0 THEN ((doc_id * 7 + line_no // 3) % 10) / 10.0 END AS confidence FROM l WHERE line_no % 3 = 0),
li AS (SELECT 'C' || doc_id || ':' || (line_no // 3) AS concept_id, CASE WHEN (doc_id + line_no) % 23 = 0 THEN doc_id || ':x' ELSE doc_id || ':' || line_no END AS span_id, doc_id FROM l WHERE line_no % 3 <> 2
  UNION ALL SELECT 'C' || doc_id || ':0', doc_id || ':' || line_no, doc_id FROM l WHERE line_no % 3 = 0 AND line_no > 0),
sc AS (SELECT doc_id, 'S' || doc_id || ':' || line_no AS scaffolding_id, ['unresolved', 'move_backstage', 'remove_nonconcept', 'retain'][((doc_id + line_no) % 4 + 1)::INT] AS decision, (doc_id + line_no) % 5 <> 0 AS extracted FROM l WHERE line_no % 3 = 2),
de AS (SELECT doc_id, 'D' || doc_id || ':' || k AS dependency_id,
  CASE (doc_id + k) % 10 WHEN 3 THEN 'C' || doc_id || ':' || (k + 1000) WHEN 4 THEN concept_id WHEN 5 THEN NULL ELSE 'C' || doc_id || ':' || (k - 1) END AS prerequisite, concept_id AS dependent FROM co WHERE k > 0),
ob AS (SELECT doc_id, k, 'O' || doc_id || ':' || k AS obligation_id, CASE (doc_id + k) % 16 WHEN 3 THEN NULL WHEN 5 THEN 'C' || doc_id || ':none' ELSE concept_id END AS concept_id,
  (doc_id + k) % 6 <> 5 AS active, (doc_id + 2 * k) % 7 AS functions, CASE WHEN (doc_id + 3 * k) % 8 = 0 THEN 'unresolved' ELSE 'unassessed' END AS status,
  CASE WHEN (doc_id + k) % 12 = 5 THEN '' ELSE 'merged' END AS reason FROM co WHERE (doc_id + k) % 14 <> 6),
pl AS (SELECT 'U' || doc_id || ':' || (k // 2) AS unit_id, concept_id, doc_id FROM co WHERE (doc_id + k) % 12 <> 7
  UNION ALL SELECT 'U' || doc_id || ':' || ((k + 2) // 2), concept_id, doc_id FROM co WHERE (doc_id + k) % 20 = 1
  UNION ALL SELECT 'U' || doc_id || ':' || (k // 2), concept_id || 'x', doc_id FROM co WHERE (doc_id + k) % 25 = 2),
asg AS (SELECT 'U' || doc_id || ':' || (k // 2) AS unit_id, 'O' || doc_id || ':' || k AS obligation_id FROM co WHERE (doc_id + k) % 15 <> 7)"""
