"""Release gates that fail closed: a missing, unreadable or empty record blocks unless the gate says otherwise.

Each gate takes tables keyed by release (the documents' group that is to go out) and returns one row for each release: release, and the
reason it is blocked or null.  Reasons are tried in the stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds and allow lists.
DRAFT_RATE, ASSEMBLY_RATE, SOURCE_RATE, AGREEMENT = 0.95, 0.99, 0.95, 0.9
AUTHORIZED = ("operator", "release-gate")
SUFFICIENT = ("sufficient", "verified", "accepted")


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The first case that holds; a null condition holds (closed)."""
    out = None
    for when, reason in cases:
        when = F.coalesce(when, F.lit(True))
        out = F.when(when, reason) if out is None else out.when(when, reason)
    return out


def correspondence(releases: DataFrame, manifests: DataFrame, objects: DataFrame, drafts: DataFrame, preserved: DataFrame, omissions: DataFrame, assemblies: DataFrame, assembled: DataFrame | None = None) -> DataFrame:
    """V-11: eight conditions.

    manifests: release, manifest_hash, current_hash, agreement; objects: release, hash; drafts: release, draft; preserved: release, hash;
    omissions: release, hash, approved; assemblies: release, assembly, vs_source, vs_drafts (the last by name counts); assembled: release,
    for each assembled file: a release that has files but no record of an assembly is blocked, one without files isn't.
    """
    total = objects.select("release", "hash").distinct()
    kept = total.join(preserved.select("release", "hash").distinct(), ["release", "hash"], "left_semi").groupBy("release").agg(F.count("*").alias("_kept"))
    total = total.groupBy("release").agg(F.count("*").alias("_total"))
    drafted = drafts.select("release").distinct().withColumn("_drafted", F.lit(True))
    open_ = omissions.filter(~F.coalesce("approved", F.lit(False))).select("release").distinct().withColumn("_open", F.lit(True))
    last = assemblies.groupBy("release").agg(F.max(F.struct("assembly", "vs_source", "vs_drafts")).alias("_last"))
    own = manifests.withColumn("_manifest", F.lit(True))
    rows = releases.select("release").distinct()
    files = releases.select("release").limit(0) if assembled is None else assembled.select("release").distinct()
    for t in (own, total, kept, drafted, open_, last, files.withColumn("_files", F.lit(True))):
        rows = rows.join(t, "release", "left")
    rate = F.coalesce("_kept", F.lit(0)) / F.col("_total")
    has = F.col("_last").isNotNull()
    reason = first_reason(
        (F.col("_manifest").isNull(), "missing_source_manifest"),
        (~F.col("manifest_hash").eqNullSafe(F.col("current_hash")), "stale_source_manifest"),
        (F.col("agreement") < AGREEMENT, "low_parser_agreement"),
        (F.col("_drafted").isNull(), "no_draft_manifests"),
        (F.col("_open").isNotNull(), "unapproved_dispositions"),
        (F.coalesce(rate < DRAFT_RATE, F.lit(False)), "low_identity_preservation"),
        (~has & F.col("_files").isNotNull(), "no_assembly_manifest"),
        (has & (F.col("_last.vs_source").isNull() | F.col("_last.vs_drafts").isNull()), "assembly_manifest_incomplete"),
        (has & F.coalesce(F.col("_last.vs_drafts") < ASSEMBLY_RATE, F.lit(False)), "assembly_correspondence"),
        (has & F.coalesce(F.col("_last.vs_source") < SOURCE_RATE, F.lit(False)), "source_correspondence"),
    )
    return rows.select("release", reason.alias("reason"))


def gaps(releases: DataFrame, records: DataFrame) -> DataFrame:
    """V-12: the gap record of a release (release, json: an array of gaps): missing, unreadable, of another shape or not empty, it blocks."""
    kind = F.from_json("json", "ARRAY<STRUCT<title: STRING, section_index: BIGINT>>")
    first = F.substring(F.ltrim("json"), 1, 1)
    rows = releases.select("release").distinct().join(records.select("release", "json", kind.alias("_gaps")), "release", "left")
    reason = first_reason(
        (F.col("json").isNull(), "gap_record_missing"),
        (~first.isin("[", "{"), "gap_record_unreadable"),
        (first == "{", "gap_record_of_another_shape"),
        (F.col("_gaps").isNull(), "gap_record_unreadable"),
        (F.size("_gaps") > 0, "sections_missing"),
    )
    return rows.select("release", F.when(first == "[", F.coalesce(F.size("_gaps"), F.lit(0))).otherwise(0).cast("bigint").alias("n_gaps"), reason.alias("reason"))


def transmissions(releases: DataFrame, log: DataFrame, manifests: DataFrame) -> DataFrame:
    """V-13, F-11: transmissions (release, authorized_by) outside the allow list, or none logged though runs (release, mode) did infer."""
    sent = log.groupBy("release").agg(F.count("*").alias("_sent"), F.count_if(~F.coalesce("authorized_by", F.lit("")).isin(*AUTHORIZED)).alias("_bad"))
    runs = manifests.filter("mode = 'inference'").groupBy("release").agg(F.count("*").alias("_runs"))
    rows = releases.select("release").distinct().join(sent, "release", "left").join(runs, "release", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    reason = first_reason((n("_bad") > 0, "unauthorized_transmission"), ((n("_runs") > 0) & (n("_sent") == 0), "missing_transmission_log"))
    return rows.select("release", n("_runs").alias("inference_runs"), reason.alias("reason"))


def preflight(releases: DataFrame, records: DataFrame) -> DataFrame:
    """V-14: the latest preflight (release, preflight_id, findings, status, exit_code) is there and clean.

    A record whose findings, status and exit code are all null couldn't be read; one such record of a release blocks it.
    """
    empty = F.col("findings").isNull() & F.col("status").isNull() & F.col("exit_code").isNull()
    last = records.groupBy("release").agg(F.max(F.struct("preflight_id", "findings", "status", "exit_code")).alias("_p"), F.bool_or(empty).alias("_empty"))
    rows = releases.select("release").distinct().join(last, "release", "left")
    reason = first_reason(
        (F.coalesce("_empty", F.lit(False)), "preflight_unreadable"),
        (F.col("_p").isNull(), "no_preflight_run"),
        (F.coalesce("_p.findings", F.lit(0)) > 0, "unresolved_preflight_findings"),
        (F.coalesce("_p.status", F.lit("pass")) != "pass", "preflight_not_passed"),
        (F.coalesce("_p.exit_code", F.lit(0)) != 0, "preflight_not_passed"),
    )
    return rows.select("release", F.when(~F.coalesce("_empty", F.lit(False)), F.col("_p.preflight_id")).alias("preflight_id"), reason.alias("reason"))


def presence(releases: DataFrame, markers: DataFrame, files: DataFrame) -> DataFrame:
    """V-15: an assembly whose file exists, a source build whose brief was valid, no unresolved author choice, a blackline.

    markers: release, brief_valid, promised, extracted, assembled_file, blackline_file, unresolved_choice; files: release, path.
    """
    found = files.select("release", F.col("path").alias("_path")).distinct()
    rows = releases.select("release").distinct().join(markers.withColumn("_m", F.lit(True)), "release", "left")
    for column in ("assembled_file", "blackline_file"):
        rows = rows.join(found.withColumnRenamed("release", "_r").withColumn(f"_{column}", F.lit(True)), (F.col("release") == F.col("_r")) & (F.col(column) == F.col("_path")), "left").drop("_r", "_path")
    reason = first_reason(
        (F.col("_m").isNull(), "no_manifest"),
        (~F.coalesce("brief_valid", F.lit(False)), "brief_invalid"),
        ((F.coalesce("promised", F.lit(0)) > 0) & (F.coalesce("extracted", F.lit(0)) == 0), "no_protected_manifests"),
        (F.coalesce("unresolved_choice", F.lit(False)), "unresolved_author_choice"),
        (F.col("assembled_file").isNull(), "no_assembly"),
        (F.col("_assembled_file").isNull(), "assembled_file_missing"),
        (F.col("_blackline_file").isNull(), "no_blackline"),
    )
    return rows.select("release", reason.alias("reason"))


def evidence(releases: DataFrame, items: DataFrame, supports: DataFrame) -> DataFrame:
    """Load-bearing evidence (items: release, evidence_id, state; supports: evidence_id, load_bearing) that is not explicitly sufficient."""
    loaded = supports.filter("load_bearing").select("evidence_id").distinct()
    lost = items.join(loaded, "evidence_id", "left_semi").filter(~F.coalesce("state", F.lit("")).isin(*SUFFICIENT))
    counts = lost.groupBy("release").agg(F.count("*").alias("n"))
    return releases.select("release").distinct().join(counts, "release", "left").select("release", F.coalesce("n", F.lit(0)).alias("insufficient"))


def promised_types(promises: DataFrame, parsed: DataFrame) -> DataFrame:
    """U-11: object types (release, object_type, count) that a brief promises and nothing parsed (release, object_type)."""
    return promises.filter("count > 0").join(parsed.select("release", "object_type").distinct(), ["release", "object_type"], "left_anti").select("release", "object_type")


def approved_omissions(dispositions: DataFrame) -> DataFrame:
    """U-09: of each release and hash the last approved disposition (release, seq, hash, approved, approver)."""
    good = dispositions.filter("approved AND hash IS NOT NULL")
    return good.groupBy("release", "hash").agg(F.max(F.struct("seq", "approver"))["approver"].alias("approver"))


def blueprint_budget(units: DataFrame, ceiling: int = 8192, safety: float = 0.9) -> DataFrame:
    """V-20: units (unit_id, words) whose output estimate, int(words * 1.2 * 4), is over the safe ceiling: unit_id, tokens, over, parts."""
    safe = int(ceiling * safety)
    tokens = F.floor(F.col("words") * 1.2 * 4.0).cast("bigint")
    return units.select("unit_id", tokens.alias("tokens")).filter(F.col("tokens") > safe).select(
        "unit_id", "tokens", (F.col("tokens") - safe).alias("over"), (F.floor(F.col("tokens") / safe) + 1).cast("bigint").alias("parts")
    )


def reader_packet(files: DataFrame) -> DataFrame:
    """K-07: the hash of a release's packet: its files' bytes (release, path, content) in order of their paths."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), "")
    return files.groupBy("release").agg(F.count("*").alias("files"), F.sha2(whole, 256).alias("packet_hash"))
