"""Queries on release gates, budgets, briefs, sessions and model responses.  A release is a document; records are derived from its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.operators import release, responses, reviews

from .base import canonical_sql, query


def _releases(t):
    return t("documents").select(F.col("doc_id").alias("release"))


@query("release_correspondence", """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 40 = 1 THEN 'missing_source_manifest' WHEN doc_id % 40 = 2 THEN 'stale_source_manifest' WHEN doc_id % 40 = 3 THEN 'low_parser_agreement' WHEN doc_id % 40 = 4 THEN 'no_draft_manifests'
 WHEN doc_id % 40 = 5 THEN 'unapproved_dispositions' WHEN doc_id % 40 = 6 THEN 'low_identity_preservation' WHEN doc_id % 40 = 7 THEN 'assembly_manifest_incomplete' WHEN doc_id % 40 = 8 THEN 'assembly_correspondence' WHEN doc_id % 40 = 9 THEN 'source_correspondence' END AS reason FROM documents)
SELECT doc_id AS release, reason FROM a""")
def release_correspondence(t):
    """V-11: each of the reasons is planted in one of forty releases; releases whose number ends otherwise pass."""
    r = _releases(t)
    m = F.col("release") % 40
    manifests = r.filter(m != 1).select("release", F.lit("h").alias("manifest_hash"), F.when(m == 2, "x").otherwise("h").alias("current_hash"), F.when(m == 3, 0.89).otherwise(0.9).alias("agreement"))
    objects = r.select("release", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("hash"))
    drafts = r.filter(m != 4).select("release", F.lit("d").alias("draft"))
    preserved = objects.filter(~((m == 6) & (F.col("hash") > 18)) & (F.col("hash") != 20))
    omissions = r.select("release", F.lit(20).alias("hash"), F.when(m == 5, F.lit(None).cast("boolean")).otherwise(True).alias("approved"))
    assemblies = r.filter((m >= 7) & (m < 20)).select("release", F.lit("a2").alias("assembly"), F.when(m == 9, 0.94).otherwise(0.95).alias("vs_source"), F.when(m == 7, None).when(m == 8, 0.98).otherwise(0.99).alias("vs_drafts"))
    return release.correspondence(r, manifests, objects, drafts, preserved, omissions, assemblies.unionByName(assemblies.select("release", F.lit("a1").alias("assembly"), F.lit(0.1).alias("vs_source"), F.lit(0.1).alias("vs_drafts"))))


@query("release_gaps", """
SELECT doc_id AS release, CASE WHEN doc_id % 6 = 4 THEN 2 ELSE 0 END::BIGINT AS n_gaps, CASE doc_id % 6 WHEN 1 THEN 'gap_record_missing' WHEN 2 THEN 'gap_record_unreadable' WHEN 3 THEN 'gap_record_of_another_shape' WHEN 4 THEN 'sections_missing' END AS reason FROM documents""")
def release_gaps(t):
    """V-12."""
    r = _releases(t)
    records = r.filter("release % 6 != 1").selectExpr("release", """CASE release % 6 WHEN 2 THEN 'not json' WHEN 3 THEN '{"gaps": []}' WHEN 4 THEN '[{"title": "a", "section_index": 1}, {"title": "b", "section_index": 2}]' ELSE '[]' END AS json""")
    return release.gaps(r, records)


@query("release_transmissions", """
WITH log AS (SELECT conv_id, role AS authorized_by FROM conversations), n AS (SELECT conv_id, count(*) FILTER (WHERE turn % 4 = 1) AS runs, count(*) FILTER (WHERE conv_id % 5 <> 0) AS sent, count(*) FILTER (WHERE conv_id % 5 <> 0 AND conv_id % 7 = 0 AND role = 'user') AS bad FROM conversations GROUP BY conv_id)
SELECT conv_id AS release, runs::BIGINT AS inference_runs, CASE WHEN bad > 0 THEN 'unauthorized_transmission' WHEN runs > 0 AND sent = 0 THEN 'missing_transmission_log' END AS reason FROM n""")
def release_transmissions(t):
    """V-13, F-11, S-26: turns as runs and as the log of what was sent."""
    c = t("conversations")
    log = c.filter("conv_id % 5 != 0").selectExpr("conv_id AS release", "CASE WHEN conv_id % 7 = 0 AND role = 'user' THEN role ELSE 'operator' END AS authorized_by")
    return release.transmissions(c.selectExpr("conv_id AS release"), log, c.selectExpr("conv_id AS release", "CASE WHEN turn % 4 = 1 THEN 'inference' ELSE 'mock' END AS mode"))


@query("release_preflight", """
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE conv_id % 9 <> 0), l AS (SELECT * FROM p WHERE r = 1)
SELECT c.conv_id AS release, 'p' || format('{:05d}', l.turn) AS preflight_id, CASE WHEN l.conv_id IS NULL THEN 'no_preflight_run' WHEN l.turn % 3 = 1 THEN 'unresolved_preflight_findings' WHEN l.conv_id % 4 = 1 OR l.conv_id % 4 = 2 THEN 'preflight_not_passed' END AS reason
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l ON l.conv_id = c.conv_id""")
def release_preflight(t):
    """V-14: turns as preflights."""
    c = t("conversations")
    runs = c.filter("conv_id % 9 != 0").selectExpr("conv_id AS release", "format_string('p%05d', turn) AS preflight_id", "CAST(turn % 3 = 1 AS INT) AS findings", "CASE WHEN conv_id % 4 = 1 THEN 'fail' ELSE 'pass' END AS status", "CASE WHEN conv_id % 4 = 2 THEN 3 END AS exit_code")
    return release.preflight(c.selectExpr("conv_id AS release"), runs)


@query("release_presence", """
SELECT doc_id AS release, CASE doc_id % 10 WHEN 1 THEN 'no_manifest' WHEN 2 THEN 'brief_invalid' WHEN 3 THEN 'no_protected_manifests' WHEN 4 THEN 'unresolved_author_choice' WHEN 5 THEN 'no_assembly' WHEN 6 THEN 'assembled_file_missing' WHEN 7 THEN 'no_blackline' END AS reason FROM documents""")
def release_presence(t):
    """V-15."""
    r = _releases(t)
    markers = r.filter("release % 10 != 1").selectExpr(
        "release", "release % 10 != 2 AS brief_valid", "2 AS promised", "CASE WHEN release % 10 = 3 THEN 0 ELSE 1 END AS extracted", "CASE WHEN release % 10 != 5 THEN 'out.tex' END AS assembled_file", "'diff.tex' AS blackline_file", "release % 10 = 4 AS unresolved_choice"
    )
    files = r.filter("release % 10 != 6").selectExpr("release", "'out.tex' AS path").unionByName(r.filter("release % 10 != 7").selectExpr("release", "'diff.tex' AS path"))
    return release.presence(r, markers, files)


@query("evidence_gaps", """
WITH e AS (SELECT d.doc_id, quality, toxic FROM documents d JOIN labels USING (doc_id)) SELECT doc_id % 50 AS release, count(*) FILTER (WHERE toxic = 1 AND NOT coalesce(quality, 0) = 1)::BIGINT AS insufficient FROM e GROUP BY ALL
UNION ALL SELECT DISTINCT doc_id % 50, 0 FROM documents WHERE doc_id % 50 NOT IN (SELECT doc_id % 50 FROM e)""")
def evidence_gaps(t):
    """F-10: labelled documents as evidence: load-bearing if toxic, sufficient if of quality."""
    l = t("documents").select("doc_id").join(t("labels"), "doc_id")
    items = l.selectExpr("doc_id % 50 AS release", "doc_id AS evidence_id", "CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'pending' END AS state")
    return release.evidence(t("documents").selectExpr("doc_id % 50 AS release"), items, l.selectExpr("doc_id AS evidence_id", "toxic = 1 AS load_bearing"))


@query("promised_types", "SELECT doc_id AS release, k AS object_type FROM documents, (SELECT unnest(['equation', 'table', 'label']) AS k) WHERE (k = 'table' AND doc_id % 4 = 1) OR (k = 'label' AND doc_id % 6 = 2)")
def promised_types(t):
    """U-11."""
    r = _releases(t)
    promises = r.select("release", F.explode(F.expr("map('equation', 1, 'table', release % 4, 'label', 1)")).alias("object_type", "count"))
    parsed = r.selectExpr("release", "explode(array('equation', CASE WHEN release % 4 != 1 THEN 'table' END, CASE WHEN release % 6 != 2 THEN 'label' END)) AS object_type")
    return release.promised_types(promises, parsed)


@query("approved_omissions", """
SELECT l_suppkey AS release, l_partkey AS hash, arg_max(l_linestatus, l_orderkey * 10 + l_linenumber) AS approver FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL""")
def approved_omissions(t):
    """U-09: of returned items of a supplier and part the last one's approver (its line status)."""
    rows = t("lineitem").selectExpr("l_suppkey AS release", "l_orderkey * 10 + l_linenumber AS seq", "l_partkey AS hash", "l_returnflag = 'R' AS approved", "l_linestatus AS approver")
    return release.approved_omissions(rows)


@query("blueprint_budget", """
WITH w AS (SELECT doc_id AS unit_id, len(regexp_extract_all(text, '[^ \t-\r]+')) * 10 AS words FROM documents), e AS (SELECT unit_id, floor(words * 1.2 * 4.0)::BIGINT AS tokens FROM w) SELECT unit_id, tokens, (tokens - 7372)::BIGINT AS over, (tokens // 7372 + 1)::BIGINT AS parts FROM e WHERE tokens > 7372""")
def blueprint_budget(t):
    """V-20, C-35."""
    return release.blueprint_budget(t("documents").select(F.col("doc_id").alias("unit_id"), (F.coalesce(F.regexp_count("text", F.lit("[^ \t-\r]+")), F.lit(0)) * 10).alias("words")))


@query("reader_packet", """
WITH f AS (SELECT doc_id AS release, 'a.tex' AS path, text AS content FROM documents UNION ALL SELECT doc_id, 'b.json', '{"source": "' || source || '"}' FROM documents) SELECT release, count(*)::BIGINT AS files, sha256(string_agg(content, '' ORDER BY path)) AS packet_hash FROM f GROUP BY release""")
def reader_packet(t):
    """K-07: the assembled document and its context, without internal ids."""
    d = t("documents")
    files = d.selectExpr("doc_id AS release", "'a.tex' AS path", "text AS content").unionByName(d.select(F.col("doc_id").alias("release"), F.lit("b.json").alias("path"), F.concat(F.lit('{"source": "'), "source", F.lit('"}')).alias("content")))
    return release.reader_packet(files)


@query("brief_assessment", """
WITH b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'TBD' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'decider' END AS reader, CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'approve' END AS decision, doc_id % 4 = 0 AS no_examples, doc_id % 7 = 0 AS authorized, CASE WHEN doc_id % 14 = 0 THEN '?' ELSE 'x' END AS approved_by FROM documents)
SELECT doc_id, ((reader IS NULL OR trim(reader) = '' OR lower(trim(reader)) = 'tbd')::INT + (decision = 'n/a')::INT + (authorized AND approved_by = '?')::INT)::BIGINT AS critical, no_examples::INT::BIGINT AS warnings FROM b""")
def brief_assessment(t):
    """V-25, C-30, C-31: blanks at dotted paths of briefs in JSON."""
    d = t("documents").select(
        "doc_id",
        F.to_json(
            F.struct(
                F.struct(F.expr("CASE doc_id % 5 WHEN 0 THEN 'TBD' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'decider' END").alias("role")).alias("reader"),
                F.expr("CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'approve' END").alias("decision"),
                F.expr("CASE WHEN doc_id % 4 = 0 THEN array() ELSE array('a') END").alias("exemplars"),
                F.struct(F.expr("doc_id % 7 = 0").alias("authorized"), F.expr("CASE WHEN doc_id % 14 = 0 THEN '?' ELSE 'x' END").alias("approved_by")).alias("remote"),
            )
        ).alias("brief"),
    )
    return reviews.assess_briefs(d, "doc_id", "brief", ["$.reader.role", "$.decision"], ["$.exemplars"], ("$.remote.authorized", "$.remote.approved_by"))


@query("session_outcomes", """
WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'converged' WHEN 1 THEN 'oscillating' ELSE 'failed' END AS outcome FROM conversations WHERE conv_id % 6 <> 0), l AS (SELECT conv_id, count(*) AS n, arg_max(outcome, turn) AS last FROM c GROUP BY conv_id)
SELECT s.conv_id AS session, coalesce(n, 0)::BIGINT AS cycles, CASE WHEN last IS NULL THEN 'timeout' WHEN last IN ('converged', 'oscillating') THEN last WHEN n >= 5 THEN 'timeout' ELSE 'unresolvable' END AS outcome, coalesce(last = 'converged', false) AS acceptable
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN l ON l.conv_id = s.conv_id""")
def session_outcomes(t):
    """A-24, M-07: turns as repair cycles, five at most."""
    c = t("conversations")
    cycles = c.filter("conv_id % 6 != 0").selectExpr("conv_id AS session", "turn AS cycle", "CASE turn % 4 WHEN 0 THEN 'converged' WHEN 1 THEN 'oscillating' ELSE 'failed' END AS outcome")
    return reviews.session_outcomes(c.selectExpr("conv_id AS session").distinct(), cycles, 5)


@query("fixture_tallies", "SELECT lang, count(*) FILTER (WHERE quality = 1)::BIGINT AS passed, count(*) FILTER (WHERE quality = 0)::BIGINT AS failed, count(*) FILTER (WHERE quality IS NULL)::BIGINT AS not_run FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def fixture_tallies(t):
    """A-25: a fixture that did not run has not passed."""
    return reviews.tallies(t("documents").join(t("labels"), "doc_id", "left").select("lang", (F.col("quality") == 1).alias("ok")), "lang", "ok")


@query("revision_history", """
WITH m AS (SELECT conv_id, turn, turn % 5 = 3 AS broken, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations), h AS (SELECT conv_id, turn, CASE WHEN broken THEN seen ELSE turn + 1 END AS cycle, CASE WHEN broken THEN 'unreadable' ELSE 'h' || turn END AS content_hash FROM m)
SELECT conv_id AS draft, turn AS revision, cycle::BIGINT AS cycle, content_hash, row_number() OVER (PARTITION BY conv_id ORDER BY cycle, turn)::BIGINT AS place FROM h""")
def revision_history(t):
    """W-18: revisions in order of their cycle; an unreadable one uses up the cycle at its place."""
    rows = t("conversations").selectExpr("conv_id AS draft", "turn AS revision", "CASE WHEN turn % 5 != 3 THEN turn + 1 END AS cycle", "CASE WHEN turn % 5 != 3 THEN 'h' || turn END AS content_hash")
    return reviews.revision_history(rows)


@query("parser_ranking", """
WITH s AS (SELECT lang AS fixture, source AS parser, avg(n_chars) AS recall, count(*) FILTER (WHERE n_chars > 500) > 0 AS round_trip, max(n_chars) AS minutes FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY round_trip DESC, recall DESC, minutes, parser) AS r FROM s)
SELECT fixture, parser, CASE r WHEN 1 THEN 'primary' WHEN 2 THEN 'fallback' END AS verdict FROM r WHERE r <= 2""")
def parser_ranking(t):
    """T-05: sources as parsers of a language: round trip, then recall, then speed."""
    s = t("documents").groupBy(F.col("lang").alias("fixture"), F.col("source").alias("parser")).agg(F.avg("n_chars").alias("recall"), (F.count_if(F.col("n_chars") > 500) > 0).alias("round_trip"), F.max("n_chars").alias("minutes"))
    return reviews.ranked(s, "fixture", [F.desc("round_trip"), F.desc("recall"), "minutes", "parser"])


@query("document_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, 999999), n_chars, doc_id)::BIGINT AS place FROM documents LEFT JOIN labels USING (doc_id)")
def document_order(t):
    """T-06, T-02: places in order, with 999999 for what isn't known."""
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return reviews.placed(rows, ["source"], ["quality"], ["n_chars", "doc_id"]).select("doc_id", "place")


@query("parsed_responses", """
WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 0 THEN 'abstained' WHEN turn % 6 = 1 THEN 'invalid_json' WHEN turn % 6 = 2 THEN 'expected_array_got_single_record' END AS abstention, conv_id || ':' || turn AS id FROM conversations)
SELECT id AS window_id, abstention, NULL AS concept_id, NULL::DOUBLE AS confidence, NULL AS concept_type FROM r WHERE abstention IS NOT NULL
UNION ALL SELECT id, NULL, 'c' || i, CASE WHEN i = 1 THEN 0.5 ELSE 0.8 END, CASE WHEN i = 1 THEN 'claim' ELSE 'definition' END FROM r, (SELECT unnest([1, 2]) AS i) WHERE abstention IS NULL""")
def parsed_responses(t):
    """M-02 to M-04: responses (made from turns) parsed into concepts with defaults, or an abstention."""
    rows = t("conversations").selectExpr(
        "conv_id || ':' || turn AS window_id",
        "CASE WHEN turn % 6 = 0 THEN 'abstained' END AS abstention",
        """CASE turn % 6 WHEN 1 THEN 'Here is [' WHEN 2 THEN '{"concept_id": "c1"}' ELSE '[{"concept_id": "c1", "confidence": 0.5, "concept_type": "claim"}, {"concept_id": "c2"}]' END AS text""",
    )
    return responses.parse_concepts(rows)


@query("rewrite_checks", """
WITH u AS (SELECT doc_id FROM documents), r AS (SELECT doc_id AS unit_id, CASE doc_id % 8 WHEN 0 THEN 'declined' WHEN 1 THEN 'json_decode_failed' WHEN 2 THEN 'expected_dict_got_other' WHEN 3 THEN 'incomplete_concept_mapping: b' WHEN 4 THEN 'truncated_output' END AS reason FROM u) SELECT unit_id, reason, reason IS NULL AS acceptable FROM r""")
def rewrite_checks(t):
    """M-05, U-04: the model's answers for units that have to map concepts a and b."""
    d = t("documents")
    answers = d.selectExpr(
        "doc_id AS unit_id",
        "CASE WHEN doc_id % 8 = 0 THEN 'declined' END AS abstention",
        """CASE doc_id % 8 WHEN 1 THEN '{broken' WHEN 2 THEN '[1]' WHEN 3 THEN '{"replacement_latex": "a long enough text", "concept_correspondences": [{"source_concept_id": "a"}]}'
        WHEN 4 THEN '{"replacement_latex": "short", "concept_correspondences": [{"source_concept_id": "a"}, {"source_concept_id": "b"}]}'
        ELSE '{"replacement_latex": "a long enough text", "concept_correspondences": [{"source_concept_id": "a"}, {"source_concept_id": "b"}]}' END AS text""",
    )
    return responses.check_rewrites(answers, d.selectExpr("doc_id AS unit_id", "explode(array('a', 'b')) AS concept_id"))


@query("latest_attempt", "SELECT conv_id AS unit, max(turn)::BIGINT AS attempts_to, arg_max(role, turn) AS result FROM conversations WHERE turn <= 2 GROUP BY conv_id")
def latest_attempt(t):
    """M-08: of at most three attempts the last result."""
    return responses.latest_attempt(t("conversations").selectExpr("conv_id AS unit", "turn AS attempt", "role AS result"), 2)


@query("freeze_signatures", f"""
SELECT lang AS baseline, count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1)::BIGINT AS accepted, sha256(string_agg(sha256({canonical_sql("doc_id", "quality")}), '' ORDER BY doc_id)) AS signature FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def freeze_signatures(t):
    """M-13: counts and canonical hash of each inventory."""
    return responses.freeze(t("documents").join(t("labels"), "doc_id", "left").select(F.col("lang").alias("baseline"), "doc_id", "quality"), "baseline", "doc_id", ["doc_id", "quality"], F.col("quality") == 1)
