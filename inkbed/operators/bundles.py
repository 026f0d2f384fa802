"""Records and bundles of records: typed schemas, single-record rules, links, frozen baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.functions.text import canonical

from .readiness import blockers, union

#: Schemas of the record types (Spark DDL) and the fields that a record must have.
SCHEMAS = {
    "SourceSpan": "record_id STRING, source_file STRING, byte_start BIGINT, byte_end BIGINT, line_start BIGINT, line_end BIGINT, coverage_disposition STRING",
    "SourceConcept": "record_id STRING, concept_id STRING, review_status STRING, source_span_ids ARRAY<STRING>, occurrences ARRAY<STRUCT<span_id: STRING>>",
    "ConceptDependency": "record_id STRING, dependency_id STRING, prerequisite_concept_id STRING, dependent_concept_id STRING, relation STRING, review_status STRING",
    "ExplanationObligation": "record_id STRING, obligation_id STRING, concept_id STRING, active BOOLEAN, required_teaching_functions ARRAY<STRING>, fulfillment_status STRING",
    "RewriteUnit": "record_id STRING, unit_id STRING, source_file STRING, concept_ids ARRAY<STRING>, source_span_ids ARRAY<STRING>",
    "SemanticPreflightResult": "record_id STRING, status STRING, frozen_concept_count BIGINT, supported_concept_count BIGINT, retention DOUBLE",
}
REQUIRED = {name: [part.split(" ")[0] for part in ddl.replace("STRUCT<span_id: STRING>", "X").split(", ")[:2]] for name, ddl in SCHEMAS.items()}
#: What enumerated fields may hold.
ALLOWED = {"coverage_disposition": ("unresolved", "concept_bearing", "non_substantive_scaffolding", "protected_structural"), "review_status": ("proposed", "ambiguous", "accepted", "rejected")}


def validate(records: DataFrame, expected: str, key: str = "key") -> DataFrame:
    """V-10: JSON records (key, json) against the schema of a type: (check, locator, reason) for what is malformed, of another type, lacks a
    field or holds a value that isn't allowed.  A record that can't be read has no other finding."""
    ddl = f"record_type STRING, {SCHEMAS[expected]}, _corrupt STRING"
    own = records.select(F.col(key).alias("_k"), F.from_json("json", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    parts = [blockers(own, broken, "schema", F.col("_k"), F.lit("malformed"))]
    whole = own.filter(~broken)
    parts.append(blockers(whole, ~F.col("r.record_type").eqNullSafe(expected), "schema", F.col("_k"), F.concat(F.lit("record_type is "), F.coalesce("r.record_type", F.lit("missing")))))
    for field in REQUIRED[expected]:
        parts.append(blockers(whole, F.col(f"r.{field}").isNull(), "schema", F.col("_k"), F.lit(f"{field} is missing")))
    for field, values in ALLOWED.items():
        if f"{field} STRING" in SCHEMAS[expected]:
            parts.append(blockers(whole, F.col(f"r.{field}").isNotNull() & ~F.col(f"r.{field}").isin(*values), "schema", F.col("_k"), F.concat(F.lit(f"{field} is "), f"r.{field}")))
    return union(parts)


def record_semantics(spans: DataFrame, dependencies: DataFrame, preflights: DataFrame) -> DataFrame:
    """V-09: rules on single records: ranges, self dependency, retention = supported / frozen, a pass only with all supported."""
    frozen, supported = F.col("frozen").cast("double"), F.col("supported").cast("double")
    wrong = (F.col("frozen") > 0) & (F.col("retention").isNull() | (F.abs(F.col("retention") - supported / frozen) > 1e-12))
    return union([
        blockers(spans, F.col("byte_end") <= F.col("byte_start"), "record", F.col("span_id"), F.lit("byte_end must be greater than byte_start")),
        blockers(spans, F.col("line_end") < F.col("line_start"), "record", F.col("span_id"), F.lit("line_end must not be less than line_start")),
        blockers(dependencies, F.col("prerequisite") == F.col("dependent"), "record", F.col("dependency_id"), F.lit("a concept cannot depend on itself")),
        blockers(preflights, wrong, "record", F.col("preflight_id"), F.lit("retention must equal supported / frozen")),
        blockers(preflights, (F.col("status") == "pass") & ~F.col("supported").eqNullSafe(F.col("frozen")), "record", F.col("preflight_id"), F.lit("a pass needs every concept supported")),
    ])


def unsupported_functions(obligations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Part of V-09: fulfilled obligations (obligation_id, status, functions: array) without supported evidence (obligation_id, function, verdict) for a function."""
    proven = evidence.filter("verdict = 'supported'").select("obligation_id", "function").distinct()
    due = obligations.filter("status = 'fulfilled'").select("obligation_id", F.explode("functions").alias("function"))
    lost = due.join(proven, ["obligation_id", "function"], "left_anti").groupBy("obligation_id").agg(F.array_join(F.sort_array(F.collect_set("function")), ", ").alias("_f"))
    return blockers(lost, F.lit(True), "record", F.col("obligation_id"), F.concat(F.lit("lacks evidence for: "), "_f"))


def reverse_links(forward: DataFrame, backward: DataFrame, keys: list[str], check: str) -> DataFrame:
    """J-07, V-08: pairs that only one of two sides names: (keys, side)."""
    a, b = forward.select(*keys).distinct(), backward.select(*keys).distinct()
    one = a.join(b, keys, "left_anti").withColumn("side", F.lit("no reverse link"))
    other = b.join(a, keys, "left_anti").withColumn("side", F.lit("no forward link"))
    return one.unionByName(other).withColumn("check", F.lit(check))


def correspondence_links(concepts: DataFrame, correspondences: DataFrame, revisions: DataFrame) -> DataFrame:
    """V-08: correspondences (correspondence_id, concept_id, verdict, revision_id, candidate_hash, baseline_id) against accepted concepts and
    revisions (revision_id, child_hash, baseline_id): missing or other revisions, unknown concepts, concepts that nothing supports."""
    check, own = "correspondence", F.col("correspondence_id")
    known = concepts.filter("review_status = 'accepted'").select("concept_id").distinct()
    met = correspondences.join(revisions.select(F.col("revision_id").alias("_r"), "child_hash", F.col("baseline_id").alias("_b")), F.col("revision_id") == F.col("_r"), "left")
    supported = correspondences.filter("verdict = 'supported'").select("concept_id").distinct()
    return union([
        blockers(met, F.col("_r").isNull(), check, own, F.lit("names a missing revision")),
        blockers(met, F.col("_r").isNotNull() & ~F.col("child_hash").eqNullSafe(F.col("candidate_hash")), check, own, F.lit("another candidate hash")),
        blockers(met, F.col("_r").isNotNull() & ~F.col("baseline_id").eqNullSafe(F.col("_b")), check, own, F.lit("another baseline")),
        blockers(correspondences.join(known, "concept_id", "left_anti"), F.lit(True), check, own, F.concat(F.lit("links an unknown concept: "), F.coalesce("concept_id", F.lit("nothing")))),
        blockers(known.join(supported, "concept_id", "left_anti"), F.lit(True), check, F.col("concept_id"), F.lit("lacks supported correspondence")),
    ])


def component_digest(rows: DataFrame, by: str, key: str, columns: list[str]) -> DataFrame:
    """V-07, V-28: of each baseline (by) the count and the hash of its rows in order of their key.

    Rows are hashed where they are; only hashes are gathered, for each baseline.
    """
    one = F.sha2(canonical(*(F.col(c) for c in columns)), 256)
    hashes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sha2(hashes, 256).alias("digest"))


def frozen_baseline(baselines: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """V-07, V-28: baselines (by, n, digest, covered) against what their components are now (by, n, digest, covered); nothing there is a mismatch."""
    now = actual.select(F.col(by).alias("_by"), F.col("n").alias("_n"), F.col("digest").alias("_d"), F.col("covered").alias("_c"))
    met, own = baselines.join(now, F.col(by) == F.col("_by"), "left"), F.col(by)
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    return union([
        blockers(met, differs("n", "_n"), "baseline", own, F.lit("component count mismatch")),
        blockers(met, differs("digest", "_d"), "baseline", own, F.lit("component hash mismatch")),
        blockers(met, differs("covered", "_c"), "baseline", own, F.lit("covered bytes mismatch")),
    ])


def plan_completeness(planned: DataFrame, concepts: DataFrame) -> DataFrame:
    """U-03: concepts in more than one unit, in none, or planned but not known.  planned: unit_id, concept_id."""
    many = planned.groupBy("concept_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    own, known, have = F.col("concept_id"), concepts.select("concept_id").distinct(), planned.select("concept_id").distinct()
    return union([
        blockers(many, F.lit(True), "plan", own, F.lit("appears in multiple units")),
        blockers(known.join(have, "concept_id", "left_anti"), F.lit(True), "plan", own, F.lit("missing in plan")),
        blockers(have.join(known, "concept_id", "left_anti"), F.lit(True), "plan", own, F.lit("not in baseline")),
    ])


def unit_clusters(members: DataFrame, spans: DataFrame, most_gap: int) -> DataFrame:
    """N-10: spans of a unit (members: unit_id, concept_id, span_id) in clusters without gaps over ``most_gap``: unit_id, cluster (1, 2, ...),
    n_spans, n_concepts (a concept may be in several), first, last and the gap before it.  Spans that aren't known are left out."""
    placed = members.select("unit_id", "span_id").distinct().join(spans.select("span_id", "start", "end"), "span_id")
    order = W.partitionBy("unit_id").orderBy("start", "end", "span_id")
    gap = F.col("start") - F.lag("end").over(order)
    cut = placed.withColumn("_gap", gap).withColumn("cluster", (F.sum(F.when(F.col("_gap") > most_gap, 1).otherwise(0)).over(order) + 1).cast("bigint"))
    cut = cut.withColumn("_new", F.when(F.col("_gap") > most_gap, F.col("_gap")))
    own = cut.groupBy("unit_id", "cluster").agg(F.count("*").alias("n_spans"), F.min("start").alias("first"), F.max("end").alias("last"), F.max("_new").alias("gap_before"))
    held = members.join(cut.select("unit_id", "span_id", "cluster"), ["unit_id", "span_id"]).groupBy("unit_id", "cluster").agg(F.count_distinct("concept_id").alias("n_concepts"))
    return own.join(held, ["unit_id", "cluster"])


def external_prerequisites(members: DataFrame, dependencies: DataFrame) -> DataFrame:
    """N-10: prerequisites of a unit's concepts that the unit doesn't hold itself: unit_id, prerequisite."""
    held = members.select("unit_id", "concept_id").distinct()
    wanted = held.join(dependencies.select(F.col("dependent").alias("concept_id"), "prerequisite"), "concept_id").select("unit_id", "prerequisite").filter("prerequisite IS NOT NULL").distinct()
    return wanted.join(held.withColumnRenamed("concept_id", "prerequisite"), ["unit_id", "prerequisite"], "left_anti")


def passengers(planned: DataFrame, concept_spans: DataFrame, unit_spans: DataFrame) -> DataFrame:
    """N-11: concepts of a unit (unit_id, concept_id) none of whose spans (concept_id, span_id) is among the unit's (unit_id, span_id)."""
    seated = planned.join(concept_spans, "concept_id").join(unit_spans, ["unit_id", "span_id"], "left_semi").select("unit_id", "concept_id").distinct()
    return planned.select("unit_id", "concept_id").distinct().join(seated, ["unit_id", "concept_id"], "left_anti")


def concept_locality(concepts: DataFrame, links: DataFrame, spans: DataFrame, most: int = 10 * 1024) -> DataFrame:
    """F-02, F-03: concepts (concept_id) by the range of their spans (links: concept_id, span_id): concept_id, range, reason (null: valid).

    The range goes from the first start to the end of the span that starts last, as the reference of locality has it.
    """
    met = links.join(spans.select(F.col("span_id").alias("_s"), "start", "end"), F.col("span_id") == F.col("_s"), "left")
    last = F.max(F.when(F.col("_s").isNotNull(), F.struct("start", "end")))["end"]
    sums = met.groupBy("concept_id").agg((last - F.min("start")).alias("range"), F.min(F.when(F.col("_s").isNull(), F.col("span_id"))).alias("_lost"))
    out = concepts.select("concept_id").distinct().join(sums.withColumn("_has", F.lit(True)), "concept_id", "left")
    reason = F.when(F.col("_has").isNull(), "no_source_spans").when(F.col("_lost").isNotNull(), F.concat(F.lit("span_id_not_found: "), "_lost")).when(F.col("range") > most, "span_range_exceeds_threshold")
    return out.select("concept_id", F.when(F.col("_lost").isNull(), F.col("range")).alias("range"), reason.alias("reason"))


def known_sources(links: DataFrame, spans: DataFrame) -> DataFrame:
    """F-04: concept_id of concepts with at least one known span."""
    return links.join(spans.select("span_id").distinct(), "span_id", "left_semi").select("concept_id").distinct()


def by_confidence(concepts: DataFrame, least: float = 0.7) -> DataFrame:
    """F-05: route of each concept; a null confidence goes to adjudication."""
    return concepts.select("concept_id", F.when(F.col("confidence") >= least, "accepted").otherwise("adjudicate").alias("route"))


def scaffolding_spans(spans: DataFrame, links: DataFrame) -> DataFrame:
    """F-12: spans that no concept names and that are not protected structure."""
    return spans.filter("coalesce(disposition, '') != 'protected_structural'").join(links.select("span_id").distinct(), "span_id", "left_anti")


def exempt(line: Column, ranges: Column) -> Column:
    """F-07: whether a line is in any of the ranges (array of structs lo, hi; both ends in)."""
    return F.exists(ranges, lambda r: (line >= r["lo"]) & (line <= r["hi"]))
