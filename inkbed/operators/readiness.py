"""Readiness of a frozen inventory for rewriting: each check returns its blockers as rows (check, locator, reason).

Tables are flat: a reference from a record to many others is a table of pairs.  Checks fail closed: what is missing blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that block.
OPEN_REVIEW, OPEN_SCAFFOLDING, OPEN_OBLIGATION = ("proposed", "ambiguous"), ("unresolved",), ("unresolved",)


def blockers(rows: DataFrame, when: Column, check: str, locator: Column, reason: Column) -> DataFrame:
    return rows.filter(when).select(F.lit(check).alias("check"), locator.cast("string").alias("locator"), reason.alias("reason"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _missing(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and resolves to nothing."""
    return rows.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def classification_resolved(spans: DataFrame, concepts: DataFrame, scaffolding: DataFrame) -> DataFrame:
    """V-02: spans (span_id, disposition, concept_id, scaffolding_id), concepts (concept_id, review_status) and scaffolding
    (scaffolding_id, decision, extracted) that nobody has decided on."""
    check, own = "classification_resolved", F.col("span_id")
    return union([
        blockers(spans, F.col("disposition") == "unresolved", check, own, F.lit("unresolved")),
        blockers(spans, (F.col("disposition") == "concept_bearing") & F.col("concept_id").isNull(), check, own, F.lit("names no concept")),
        blockers(spans, (F.col("disposition") == "non_substantive_scaffolding") & F.col("scaffolding_id").isNull(), check, own, F.lit("no disposition record")),
        blockers(concepts, F.col("review_status").isin(*OPEN_REVIEW), check, F.col("concept_id"), F.concat(F.lit("review_status is "), "review_status")),
        blockers(scaffolding, F.col("decision").isin(*OPEN_SCAFFOLDING), check, F.col("scaffolding_id"), F.lit("scaffolding is unresolved")),
        blockers(scaffolding, F.col("decision").isin("move_backstage", "remove_nonconcept") & ~F.coalesce("extracted", F.lit(True)), check, F.col("scaffolding_id"), F.lit("content not extracted")),
    ])


def dependency_integrity(dependencies: DataFrame, concepts: DataFrame) -> DataFrame:
    """V-03: endpoints (prerequisite, dependent) that are missing, absent or rejected, and concepts that depend on themselves.

    Cycles are found by graph.trimmed().
    """
    check, own = "dependency_integrity", F.col("dependency_id")
    known = concepts.select(F.col("concept_id").alias("_c"), "review_status")
    parts = []
    for field in ("prerequisite", "dependent"):
        met = dependencies.join(known, F.col(field) == F.col("_c"), "left")
        reason = F.when(F.col(field).isNull(), F.lit(f"{field} is missing")).when(F.col("_c").isNull(), F.concat(F.lit(f"{field} is absent: "), field)).when(
            F.col("review_status") == "rejected", F.concat(F.lit(f"{field} is rejected: "), field)
        )
        parts.append(blockers(met, reason.isNotNull(), check, own, reason))
    parts.append(blockers(dependencies, F.col("prerequisite") == F.col("dependent"), check, own, F.concat(F.lit("its own prerequisite: "), "dependent")))
    return union(parts)


def obligation_presence(obligations: DataFrame, concepts: DataFrame, assigned: DataFrame) -> DataFrame:
    """V-04: obligations (obligation_id, concept_id, active, functions, status, reason) that demand nothing or belong to nothing, concepts
    without an active one, and active ones that no unit (assigned: unit_id, obligation_id) has."""
    check, own = "obligation_presence", F.col("obligation_id")
    known = concepts.filter("coalesce(review_status, '') != 'rejected'").select("concept_id").distinct()
    met = obligations.join(known.withColumnRenamed("concept_id", "_c"), F.col("concept_id") == F.col("_c"), "left")
    good, active = met.filter("_c IS NOT NULL"), F.coalesce("active", F.lit(False))
    counts = good.groupBy("concept_id").agg(F.count("*").alias("_n"), F.count_if(active).alias("_active"))
    by_concept = known.join(counts, "concept_id", "left")
    units = assigned.select("obligation_id").distinct()
    idle = obligations.filter(active & own.isNotNull()).join(units, "obligation_id", "left_anti")
    return union([
        blockers(met, F.col("concept_id").isNull(), check, own, F.lit("names no concept")),
        blockers(met, F.col("concept_id").isNotNull() & F.col("_c").isNull(), check, own, F.concat(F.lit("names an absent concept: "), "concept_id")),
        blockers(good, active & (F.coalesce("functions", F.lit(0)) == 0), check, own, F.lit("requires no function")),
        blockers(good, active & F.col("status").isin(*OPEN_OBLIGATION), check, own, F.lit("fulfilment is unresolved")),
        blockers(good, ~active & (F.coalesce("reason", F.lit("")) == ""), check, own, F.lit("inactive without a reason")),
        blockers(by_concept, F.col("_n").isNull(), check, F.col("concept_id"), F.lit("has no obligation")),
        blockers(by_concept, F.col("_n").isNotNull() & (F.col("_active") == 0), check, F.col("concept_id"), F.concat(F.lit("all inactive: "), F.col("_n").cast("string"))),
        blockers(_missing(assigned, "obligation_id", obligations, "obligation_id"), F.lit(True), check, F.col("unit_id"), F.concat(F.lit("names an absent obligation: "), "obligation_id")),
        blockers(idle, F.lit(True), check, own, F.lit("assigned to no unit")),
    ])


def protected_links(references: DataFrame, objects: DataFrame) -> DataFrame:
    """V-05: references (kind, locator, object_id) to protected objects that the manifest (object_id) doesn't hold; null resolves to nothing."""
    lost = references.join(objects.select("object_id").distinct(), "object_id", "left_anti")
    return blockers(lost, F.lit(True), "protected_object_links", F.col("locator"), F.concat("kind", F.lit(" names "), F.coalesce("object_id", F.lit("nothing"))))


def baseline_frozen(baselines: DataFrame) -> DataFrame:
    """Part of V-06: baselines (baseline_id, frozen, reviewer) that are open or that nobody signed."""
    check, own = "baseline_frozen", F.col("baseline_id")
    return union([
        blockers(baselines, ~F.coalesce("frozen", F.lit(False)), check, own, F.lit("not frozen")),
        blockers(baselines, F.coalesce("reviewer", F.lit("")) == "", check, own, F.lit("names no reviewer")),
    ])


def unmet_obligations(obligations: DataFrame) -> DataFrame:
    """V-23: obligations (unit_id, obligation_id, concept_id, functions: array, fulfilled) that an output doesn't meet."""
    unmet = ~F.coalesce("fulfilled", F.lit(False)) & (F.size(F.coalesce("functions", F.array().cast("array<string>"))) > 0)
    return obligations.filter(unmet).select("unit_id", "obligation_id", "concept_id", F.lit("BLOCK").alias("severity"), F.concat(F.lit("Missing: "), F.array_join("functions", ", ")).alias("evidence"))


def unit_preflight(units: DataFrame, lost_concepts: DataFrame, unmet: DataFrame, lost_objects: DataFrame) -> DataFrame:
    """V-24: per unit the two ratios (0 or 1), whether objects are intact, and whether it is acceptable or can be repaired.

    units: unit_id; the others have a row (unit_id, ...) for each finding.
    """
    flag = lambda rows, name: rows.select("unit_id").distinct().withColumn(name, F.lit(True))
    met = units.select("unit_id").join(flag(lost_concepts, "_c"), "unit_id", "left").join(flag(unmet, "_o"), "unit_id", "left").join(flag(lost_objects, "_p"), "unit_id", "left")
    ratio = lambda c: F.when(F.col(c).isNull(), 1.0).otherwise(0.0)
    out = met.select("unit_id", ratio("_c").alias("concept_ratio"), ratio("_o").alias("obligation_ratio"), F.col("_p").isNull().alias("objects_intact"))
    good = (F.col("concept_ratio") > 0.5) & (F.col("obligation_ratio") > 0.5)
    return out.withColumn("acceptable", good & F.col("objects_intact")).withColumn("can_repair", good)
