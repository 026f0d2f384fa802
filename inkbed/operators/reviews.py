"""Briefs, repair sessions, fixture tallies, rankings and lookups of review ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.functions import text as T


def _blank(json: str, path: str) -> Column:
    value = F.get_json_object(json, path)
    return value.isNull() | value.isin("[]", "{}") | T.is_blank(value)


def assess_briefs(rows: DataFrame, key: str, json: str, critical: list[str], wished: list[str], authorization: tuple[str, str]) -> DataFrame:
    """V-25, C-30: per brief the critical paths that are blank (an authorization without an approver is one) and the wished ones (warnings)."""
    allowed, approver = authorization
    count = lambda cases: sum((F.when(c, 1).otherwise(0) for c in cases), F.lit(0)).cast("bigint")
    named = F.coalesce(F.get_json_object(json, allowed) == "true", F.lit(False)) & _blank(json, approver)
    return rows.select(key, count([*(_blank(json, p) for p in critical), named]).alias("critical"), count([_blank(json, p) for p in wished]).alias("warnings"))


def session_outcomes(sessions: DataFrame, cycles: DataFrame, most: int) -> DataFrame:
    """A-24, M-07: outcome of each session (session) from its last cycle (session, cycle, outcome); none is a timeout, as is the last of ``most``;
    of two cycles of one number the greatest outcome counts."""
    last = cycles.groupBy("session").agg(F.count("*").alias("cycles"), F.max(F.struct("cycle", "outcome"))["outcome"].alias("_last"))
    rows = sessions.join(last, "session", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)).cast("bigint"))
    outcome = F.when(F.col("_last").isNull(), "timeout").when(F.col("_last").isin("converged", "oscillating"), F.col("_last")).when(F.col("cycles") >= most, "timeout").otherwise("unresolvable")
    return rows.select("session", "cycles", outcome.alias("outcome"), F.coalesce(F.col("_last") == "converged", F.lit(False)).alias("acceptable"))


def tallies(rows: DataFrame, by: str, ok: str) -> DataFrame:
    """A-25: passed, failed and not_run (null) by type."""
    return rows.groupBy(by).agg(F.count_if(F.col(ok)).alias("passed"), F.count_if(~F.col(ok)).alias("failed"), F.count_if(F.col(ok).isNull()).alias("not_run"))


def revision_history(rows: DataFrame) -> DataFrame:
    """W-18: revisions (draft, revision, cycle, content_hash) in order; one that can't be read (null cycle) counts as the cycle at its place."""
    seen = F.row_number().over(W.partitionBy("draft").orderBy("revision"))
    own = rows.select("draft", "revision", F.coalesce("cycle", seen).cast("bigint").alias("cycle"), F.coalesce("content_hash", F.lit("unreadable")).alias("content_hash"))
    return own.withColumn("place", F.row_number().over(W.partitionBy("draft").orderBy("cycle", "revision")).cast("bigint"))


def ranked(rows: DataFrame, by: str, order: list) -> DataFrame:
    """T-05: the first two of each group in order: primary and fallback."""
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_r <= 2")
    return best.select(by, "parser", F.when(F.col("_r") == 1, "primary").otherwise("fallback").alias("verdict"))


def placed(rows: DataFrame, by: list[str], unknown_last: list[str], order: list[str], unknown: int = 999999) -> DataFrame:
    """T-02, T-06: place of each row of a group, with a number for what isn't known."""
    keys = [F.coalesce(F.col(c), F.lit(unknown)) for c in unknown_last]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*keys, *order)).cast("bigint"))


def left_with_note(missing: DataFrame, manifest: DataFrame, key: str, note: str = "not found in source") -> DataFrame:
    """J-03: what is missing with its content from the manifest (key, content), or a note."""
    found = manifest.select(F.col(key).alias("_k"), "content")
    return missing.join(found, F.col(key) == F.col("_k"), "left").select(*missing.columns, F.coalesce("content", F.lit(note)).alias("content"))


def reuse(rows: DataFrame, cache: DataFrame, key: str, least: float = 0.72) -> DataFrame:
    """J-04: identity of rows (key, title, identifier) from a cache of verified ones (key, status, canonical_title): status and reused.

    Rows without a key are identifier-only or not applicable; what the cache lacks is open.
    """
    known = cache.filter("status = 'verified'").groupBy(F.col(key).alias("_k")).agg(F.min("canonical_title").alias("_t"))
    met = rows.join(known, F.col(key) == F.col("_k"), "left")
    a, b = (F.array_distinct(F.filter(F.split(T.title_key(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != "")) for c in ("title", "_t"))
    similar = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) >= least
    none = F.coalesce(F.col(key), F.lit("")) == ""
    status = F.when(none & (F.coalesce("identifier", F.lit("")) != ""), "identifier-only").when(none, "not-applicable-no-doi").when(F.col("_k").isNull(), "open").when(similar, "verified").otherwise("identity-mismatch")
    return met.select(*rows.columns, status.alias("status"), (~none & F.col("_k").isNotNull()).alias("reused"))


def identity_summary(rows: DataFrame) -> DataFrame:
    """A-20: counts of identity audits (status), and the mismatched keys in order."""
    return rows.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~F.col("status").isin("not-applicable-no-doi", "identifier-only")).alias("doi_rows"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "identity-mismatch").alias("mismatches"),
        F.count_if(F.col("status") == "open").alias("unresolved"),
    )


def latest_by_name(wanted: DataFrame, drafts: DataFrame) -> DataFrame:
    """J-16: for each wanted section (index, stem) the draft of that stem in the newest run (drafts: run, stem, path), else, if every run has
    one draft only, the one of its index in order of runs; of two drafts of one run and stem the last path by name."""
    newest = drafts.groupBy("stem").agg(F.max(F.struct("run", "path"))["path"].alias("_path"))
    single = drafts.groupBy("run").agg(F.count("*").alias("_n"), F.min("path").alias("_only"))
    all_single = single.agg(F.coalesce(F.max("_n") == 1, F.lit(False)).alias("ok"))
    by_place = single.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("run")) - 1).select("_i", "_only")  # one row for each run
    met = wanted.join(newest, "stem", "left").join(by_place, F.col("index") == F.col("_i"), "left").withColumn("_ok", all_single.scalar())
    return met.select("index", "stem", F.coalesce("_path", F.when(F.col("_ok"), F.col("_only"))).alias("path"))


def recall(rows: DataFrame, by: str, retrieved: str, seed_only: str) -> DataFrame:
    """A-15: known items, those that a search retrieved (a match with a seed only doesn't count), and the share."""
    hit = F.col(retrieved) & ~F.col(seed_only)
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(hit).alias("found"), F.avg(hit.cast("double")).alias("recall"))
