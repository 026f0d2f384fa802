"""Queries on review records: readiness, links, plans, locality."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.operators import bundles, gates, graph, readiness

from .base import canonical_sql, query
from .bundle import BUNDLE, Bundle


@query("classification_resolved", f"""
WITH {BUNDLE} SELECT 'classification_resolved' AS "check", span_id AS locator, 'unresolved' AS reason FROM sp WHERE disposition = 'unresolved'
UNION ALL SELECT 'classification_resolved', span_id, 'names no concept' FROM sp WHERE disposition = 'concept_bearing' AND concept_id IS NULL
UNION ALL SELECT 'classification_resolved', span_id, 'no disposition record' FROM sp WHERE disposition = 'non_substantive_scaffolding' AND scaffolding_id IS NULL
UNION ALL SELECT 'classification_resolved', concept_id, 'review_status is ' || review_status FROM co WHERE review_status IN ('proposed', 'ambiguous')
UNION ALL SELECT 'classification_resolved', scaffolding_id, 'scaffolding is unresolved' FROM sc WHERE decision = 'unresolved'
UNION ALL SELECT 'classification_resolved', scaffolding_id, 'content not extracted' FROM sc WHERE decision IN ('move_backstage', 'remove_nonconcept') AND NOT extracted""")
def classification_resolved(t):
    """V-02."""
    b = Bundle(t)
    return readiness.classification_resolved(b.spans, b.concepts, b.scaffolding)


_DEPENDENCY = """SELECT 'dependency_integrity' AS "check", dependency_id AS locator, f || ' is missing' AS reason FROM ends WHERE c IS NULL
UNION ALL SELECT 'dependency_integrity', dependency_id, f || ' is absent: ' || c FROM ends WHERE c IS NOT NULL AND c NOT IN (SELECT concept_id FROM co)
UNION ALL SELECT 'dependency_integrity', dependency_id, f || ' is rejected: ' || c FROM ends WHERE c IN (SELECT concept_id FROM co WHERE review_status = 'rejected')
UNION ALL SELECT 'dependency_integrity', dependency_id, 'its own prerequisite: ' || dependent FROM de WHERE prerequisite = dependent"""
_ENDS = "ends AS (SELECT dependency_id, 'prerequisite' AS f, prerequisite AS c FROM de UNION ALL SELECT dependency_id, 'dependent', dependent FROM de)"


@query("dependency_integrity", f"WITH {BUNDLE}, {_ENDS} {_DEPENDENCY}")
def dependency_integrity(t):
    """V-03, but for cycles (accepted_cycles)."""
    b = Bundle(t)
    return readiness.dependency_integrity(b.dependencies, b.concepts)


@query("accepted_cycles", """
WITH e AS (SELECT doc_id, doc_id || ':' || i AS a, doc_id || ':' || (CASE WHEN i = 4 AND doc_id % 3 = 0 THEN 1 ELSE i + 1 END) AS b, CASE WHEN doc_id % 6 = 3 AND i = 4 THEN 'proposed' ELSE 'accepted' END AS status FROM documents, (SELECT unnest(range(5)) AS i))
SELECT doc_id || ':' || i AS node FROM documents, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE doc_id % 3 = 0 AND doc_id % 6 <> 3""")
def accepted_cycles(t):
    """N-06: nodes on cycles of accepted prerequisite edges; each document has a chain of five edges, some closed to a ring."""
    e = t("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).selectExpr(
        "doc_id || ':' || i AS prerequisite", "doc_id || ':' || CASE WHEN i = 4 AND doc_id % 3 = 0 THEN 1 ELSE i + 1 END AS dependent", "CASE WHEN doc_id % 6 = 3 AND i = 4 THEN 'proposed' ELSE 'accepted' END AS review_status", "'prerequisite' AS relation"
    )
    return graph.cyclic_nodes(e.filter("review_status = 'accepted' AND relation IN ('prerequisite', 'sequence')"), "prerequisite", "dependent")


_OBLIGATION = """
known AS (SELECT DISTINCT concept_id FROM co WHERE review_status <> 'rejected'),
good AS (SELECT * FROM ob WHERE concept_id IN (SELECT concept_id FROM known)),
cnt AS (SELECT concept_id, count(*) AS n, count(*) FILTER (WHERE active) AS a FROM good GROUP BY concept_id),
op AS (SELECT 'names no concept' AS reason, obligation_id AS locator FROM ob WHERE concept_id IS NULL
UNION ALL SELECT 'names an absent concept: ' || concept_id, obligation_id FROM ob WHERE concept_id IS NOT NULL AND concept_id NOT IN (SELECT concept_id FROM known)
UNION ALL SELECT 'requires no function', obligation_id FROM good WHERE active AND functions = 0
UNION ALL SELECT 'fulfilment is unresolved', obligation_id FROM good WHERE active AND status = 'unresolved'
UNION ALL SELECT 'inactive without a reason', obligation_id FROM good WHERE NOT active AND reason = ''
UNION ALL SELECT 'has no obligation', concept_id FROM known WHERE concept_id NOT IN (SELECT concept_id FROM cnt)
UNION ALL SELECT 'all inactive: ' || n, concept_id FROM cnt WHERE a = 0
UNION ALL SELECT 'names an absent obligation: ' || obligation_id, unit_id FROM asg WHERE obligation_id NOT IN (SELECT obligation_id FROM ob)
UNION ALL SELECT 'assigned to no unit', obligation_id FROM ob WHERE active AND obligation_id NOT IN (SELECT obligation_id FROM asg))"""


@query("obligation_presence", f"""WITH {BUNDLE}, {_OBLIGATION} SELECT 'obligation_presence' AS "check", locator, reason FROM op""")
def obligation_presence(t):
    """V-04."""
    b = Bundle(t)
    return readiness.obligation_presence(b.obligations, b.concepts, b.assigned)


@query("protected_links", f"""
WITH {BUNDLE} SELECT 'protected_object_links' AS "check", unit_id AS locator, 'rewrite unit names ' || coalesce('P' || concept_id, 'nothing') AS reason FROM pl WHERE 'P' || concept_id NOT IN (SELECT 'P' || concept_id FROM co WHERE (doc_id + k) % 21 <> 0)
UNION ALL SELECT 'protected_object_links', concept_id, 'concept names P' || concept_id FROM co WHERE (doc_id + k) % 21 = 0""")
def protected_links(t):
    """V-05: each concept has a protected object; the manifest lacks some."""
    b = Bundle(t)
    named = b.planned.selectExpr("'rewrite unit' AS kind", "unit_id AS locator", "'P' || concept_id AS object_id").unionByName(b.concepts.selectExpr("'concept' AS kind", "concept_id AS locator", "'P' || concept_id AS object_id"))
    return readiness.protected_links(named, b.concepts.filter("(doc_id + k) % 21 != 0").selectExpr("'P' || concept_id AS object_id"))


@query("readiness", f"""
WITH {BUNDLE}, {_ENDS}, {_OBLIGATION}, dep AS ({_DEPENDENCY}), n AS (SELECT 'dependency_integrity' AS gate, (SELECT count(*) FROM dep) AS n, true AS ran UNION ALL SELECT 'obligation_presence', (SELECT count(*) FROM op), true
UNION ALL SELECT 'baseline_frozen', (SELECT count(*) FILTER (WHERE doc_id % 31 = 0) + count(*) FILTER (WHERE doc_id % 37 = 0) FROM documents), true UNION ALL SELECT 'span_coverage', 0, false)
SELECT gate, n::BIGINT AS n_violations, ran AND n = 0 AS passed FROM n""")
def readiness_(t):
    """V-06: checks rolled up; span_coverage did not run, so it does not pass."""
    b = Bundle(t)
    baselines = t("documents").selectExpr("'B' || doc_id AS baseline_id", "doc_id % 31 != 0 AS frozen", "CASE WHEN doc_id % 37 = 0 THEN '' ELSE 'r' END AS reviewer")
    found = [readiness.dependency_integrity(b.dependencies, b.concepts), readiness.obligation_presence(b.obligations, b.concepts, b.assigned), readiness.baseline_frozen(baselines)]
    ran = baselines.sparkSession.createDataFrame([("dependency_integrity",), ("obligation_presence",), ("baseline_frozen",)], "check string")
    return gates.roll_up(found, ran, ["dependency_integrity", "obligation_presence", "baseline_frozen", "span_coverage"])


_SPAN = canonical_sql("span_id", "start", '"end"', "disposition")


@query("frozen_baseline", f"""
WITH {BUNDLE}, a AS (SELECT doc_id, count(*) AS n, sha256(string_agg(sha256({_SPAN}), '' ORDER BY span_id)) AS digest, sum("end" - start) AS covered FROM sp GROUP BY doc_id)
SELECT 'baseline' AS "check", doc_id::VARCHAR AS locator, 'component count mismatch' AS reason FROM a WHERE doc_id % 8 = 1 UNION ALL SELECT 'baseline', doc_id::VARCHAR, 'component hash mismatch' FROM a WHERE doc_id % 8 = 2
UNION ALL SELECT 'baseline', doc_id::VARCHAR, 'covered bytes mismatch' FROM a WHERE doc_id % 8 = 3""")
def frozen_baseline(t):
    """V-07, V-28: what was recorded of the spans, with some records altered, against what they are."""
    b = Bundle(t)
    digest = bundles.component_digest(b.spans, "doc_id", "span_id", ["span_id", "start", "end", "disposition"])
    now = digest.join(b.spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered")), "doc_id")
    was = now.selectExpr("doc_id", "n + CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END AS n", "CASE WHEN doc_id % 8 = 2 THEN 'x' ELSE digest END AS digest", "covered + CASE WHEN doc_id % 8 = 3 THEN 1 ELSE 0 END AS covered")
    return bundles.frozen_baseline(was, now, "doc_id")


@query("component_digests", f"""
WITH {BUNDLE} SELECT doc_id, count(*)::BIGINT AS n, sha256(string_agg(sha256({_SPAN}), '' ORDER BY span_id)) AS digest FROM sp GROUP BY doc_id""")
def component_digests(t):
    """V-28: hash of each baseline's spans in order."""
    return bundles.component_digest(Bundle(t).spans, "doc_id", "span_id", ["span_id", "start", "end", "disposition"])


@query("bundle_links", f"""
WITH {BUNDLE}, f AS (SELECT DISTINCT concept_id, span_id FROM li), r AS (SELECT DISTINCT concept_id, span_id FROM sp WHERE concept_id IS NOT NULL)
SELECT concept_id, span_id, 'no reverse link' AS side, 'concept_span' AS "check" FROM f WHERE (concept_id, span_id) NOT IN (SELECT concept_id, span_id FROM r)
UNION ALL SELECT concept_id, span_id, 'no forward link', 'concept_span' FROM r WHERE (concept_id, span_id) NOT IN (SELECT concept_id, span_id FROM f)""")
def bundle_links(t):
    """V-08, J-01, J-07: concepts that name spans against spans that name concepts."""
    b = Bundle(t)
    return bundles.reverse_links(b.links, b.spans.filter("concept_id IS NOT NULL"), ["concept_id", "span_id"], "concept_span")


@query("correspondence_links", f"""
WITH {BUNDLE}, ok AS (SELECT concept_id FROM co WHERE review_status = 'accepted'),
cr AS (SELECT 'K' || concept_id AS id, concept_id, CASE WHEN (doc_id + k) % 7 = 0 THEN 'missing' ELSE 'supported' END AS verdict, doc_id + CASE WHEN (doc_id + k) % 29 = 0 THEN 1000000 ELSE 0 END AS rev, (doc_id + k) % 18 = 0 AS bad, (doc_id + k) % 22 = 0 AS other FROM co)
SELECT 'correspondence' AS "check", id AS locator, 'names a missing revision' AS reason FROM cr WHERE rev >= 1000000 UNION ALL SELECT 'correspondence', id, 'another candidate hash' FROM cr WHERE rev < 1000000 AND bad
UNION ALL SELECT 'correspondence', id, 'another baseline' FROM cr WHERE rev < 1000000 AND other UNION ALL SELECT 'correspondence', id, 'links an unknown concept: ' || concept_id FROM cr WHERE concept_id NOT IN (SELECT concept_id FROM ok)
UNION ALL SELECT 'correspondence', concept_id, 'lacks supported correspondence' FROM ok WHERE concept_id NOT IN (SELECT concept_id FROM cr WHERE verdict = 'supported')""")
def correspondence_links(t):
    """V-08: a correspondence for each concept, with some defects, against revisions and accepted concepts."""
    c = Bundle(t).concepts
    rows = c.selectExpr(
        "'K' || concept_id AS correspondence_id", "concept_id", "CASE WHEN (doc_id + k) % 7 = 0 THEN 'missing' ELSE 'supported' END AS verdict", "'R' || (doc_id + CASE WHEN (doc_id + k) % 29 = 0 THEN 1000000 ELSE 0 END) AS revision_id",
        "CASE WHEN (doc_id + k) % 18 = 0 THEN 'bad' ELSE 'h' || doc_id END AS candidate_hash", "CASE WHEN (doc_id + k) % 22 = 0 THEN 'other' ELSE 'B' || doc_id END AS baseline_id",
    )
    revisions = t("documents").selectExpr("'R' || doc_id AS revision_id", "'h' || doc_id AS child_hash", "'B' || doc_id AS baseline_id")
    return bundles.correspondence_links(c, rows, revisions)


@query("record_semantics", f"""
WITH {BUNDLE} SELECT 'record' AS "check", span_id AS locator, 'byte_end must be greater than byte_start' AS reason FROM sp WHERE "end" <= start UNION ALL SELECT 'record', span_id, 'line_end must not be less than line_start' FROM sp WHERE (doc_id + line_no) % 41 = 0
UNION ALL SELECT 'record', dependency_id, 'a concept cannot depend on itself' FROM de WHERE prerequisite = dependent
UNION ALL SELECT 'record', 'F' || doc_id, 'retention must equal supported / frozen' FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT 'record', 'F' || doc_id, 'a pass needs every concept supported' FROM documents WHERE doc_id % 3 = 0""")
def record_semantics(t):
    """V-09."""
    b = Bundle(t)
    spans = b.spans.selectExpr("span_id", "start AS byte_start", "end AS byte_end", "line_no AS line_start", "line_no - CASE WHEN (doc_id + line_no) % 41 = 0 THEN 1 ELSE 0 END AS line_end")
    flights = t("documents").selectExpr("'F' || doc_id AS preflight_id", "CAST(7 AS BIGINT) AS frozen", "CAST(6 AS BIGINT) AS supported", "CASE WHEN doc_id % 9 = 4 THEN NULL ELSE 6 / 7D END AS retention", "CASE WHEN doc_id % 3 = 0 THEN 'pass' ELSE 'fail' END AS status")
    return bundles.record_semantics(spans, b.dependencies, flights)


@query("unsupported_functions", f"""
WITH {BUNDLE}, due AS (SELECT obligation_id, unnest(['state', 'exemplify', 'support']) AS f, doc_id, k FROM ob WHERE (doc_id + k) % 2 = 0), lost AS (SELECT * FROM due WHERE NOT (f = 'state' OR (f = 'exemplify' AND k % 2 = 0) OR (f = 'support' AND doc_id % 3 = 0)))
SELECT 'record' AS "check", obligation_id AS locator, 'lacks evidence for: ' || string_agg(f, ', ' ORDER BY f) AS reason FROM lost GROUP BY obligation_id""")
def unsupported_functions(t):
    """V-09: fulfilled obligations whose functions have no supported evidence."""
    o = Bundle(t).obligations
    rows = o.selectExpr("obligation_id", "CASE WHEN (doc_id + k) % 2 = 0 THEN 'fulfilled' ELSE 'unmet' END AS status", "array('state', 'exemplify', 'support') AS functions")
    proof = o.select("obligation_id", F.explode(F.expr("array(named_struct('f', 'state', 'v', 'supported'), named_struct('f', 'exemplify', 'v', CASE WHEN k % 2 = 0 THEN 'supported' ELSE 'absent' END), named_struct('f', 'support', 'v', CASE WHEN doc_id % 3 = 0 THEN 'supported' END))")).alias("x"))
    return bundles.unsupported_functions(rows, proof.select("obligation_id", F.col("x.f").alias("function"), F.col("x.v").alias("verdict")))


@query("schema_validation", """
SELECT 'schema' AS "check", doc_id::VARCHAR AS locator, 'malformed' AS reason FROM documents WHERE doc_id % 7 = 1 UNION ALL SELECT 'schema', doc_id::VARCHAR, 'record_type is SourceConcept' FROM documents WHERE doc_id % 7 = 2
UNION ALL SELECT 'schema', doc_id::VARCHAR, 'source_file is missing' FROM documents WHERE doc_id % 7 = 3 UNION ALL SELECT 'schema', doc_id::VARCHAR, 'coverage_disposition is lost' FROM documents WHERE doc_id % 7 = 4""")
def schema_validation(t):
    """V-10: a record for each document, with some broken, of another type, without a field, or with a value that isn't allowed."""
    rows = t("documents").selectExpr(
        "doc_id AS key",
        """CASE doc_id % 7 WHEN 1 THEN '{"record_type": "SourceSpan", ' ELSE '{"record_type": "' || CASE WHEN doc_id % 7 = 2 THEN 'SourceConcept' ELSE 'SourceSpan' END || '", "record_id": "r' || doc_id || '", '
        || CASE WHEN doc_id % 7 = 3 THEN '' ELSE '"source_file": "f", ' END || '"byte_start": 0, "byte_end": ' || n_chars || ', "coverage_disposition": "' || CASE WHEN doc_id % 7 = 4 THEN 'lost' ELSE 'unresolved' END || '"}' END AS json""",
    )
    return bundles.validate(rows, "SourceSpan")


@query("unmet_obligations", f"""WITH {BUNDLE} SELECT 'U' || doc_id || ':' || (k // 2) AS unit_id, obligation_id, concept_id, 'BLOCK' AS severity, 'Missing: ' || array_to_string(['f0', 'f1', 'f2', 'f3', 'f4', 'f5'][1:functions::INT], ', ') AS evidence FROM ob WHERE functions > 0 AND (doc_id + k) % 4 <> 0""")
def unmet_obligations(t):
    """V-23."""
    o = Bundle(t).obligations.selectExpr("'U' || doc_id || ':' || (k div 2) AS unit_id", "obligation_id", "concept_id", "slice(array('f0', 'f1', 'f2', 'f3', 'f4', 'f5'), 1, CAST(functions AS INT)) AS functions", "(doc_id + k) % 4 = 0 AS fulfilled")
    return readiness.unmet_obligations(o)


@query("unit_preflight", f"""
WITH {BUNDLE}, u AS (SELECT DISTINCT unit_id FROM pl), c AS (SELECT DISTINCT unit_id FROM pl WHERE concept_id LIKE '%x'), o AS (SELECT DISTINCT 'U' || doc_id || ':' || (k // 2) AS unit_id FROM ob WHERE functions = 3), p AS (SELECT DISTINCT 'U' || doc_id || ':' || (k // 2) AS unit_id FROM co WHERE (doc_id + k) % 21 = 0),
r AS (SELECT unit_id, unit_id NOT IN (SELECT * FROM c) AS co_, unit_id NOT IN (SELECT * FROM o) AS ob_, unit_id NOT IN (SELECT * FROM p) AS po_ FROM u)
SELECT unit_id, co_::INT::DOUBLE AS concept_ratio, ob_::INT::DOUBLE AS obligation_ratio, po_ AS objects_intact, co_ AND ob_ AND po_ AS acceptable, co_ AND ob_ AS can_repair FROM r""")
def unit_preflight(t):
    """V-24."""
    b = Bundle(t)
    unit = "'U' || doc_id || ':' || (k div 2) AS unit_id"
    return readiness.unit_preflight(b.planned.select("unit_id").distinct(), b.planned.filter("concept_id LIKE '%x'"), b.obligations.filter("functions = 3").selectExpr(unit), b.concepts.filter("(doc_id + k) % 21 = 0").selectExpr(unit))


@query("plan_completeness", f"""
WITH {BUNDLE} SELECT 'plan' AS "check", concept_id AS locator, 'appears in multiple units' AS reason FROM pl GROUP BY concept_id HAVING count(*) > 1 UNION ALL SELECT 'plan', concept_id, 'missing in plan' FROM co WHERE concept_id NOT IN (SELECT concept_id FROM pl)
UNION ALL SELECT DISTINCT 'plan', concept_id, 'not in baseline' FROM pl WHERE concept_id NOT IN (SELECT concept_id FROM co)""")
def plan_completeness(t):
    """U-03."""
    b = Bundle(t)
    return bundles.plan_completeness(b.planned, b.concepts)


_MEMBERS = "me AS (SELECT unit_id, pl.concept_id, span_id FROM pl JOIN li USING (concept_id))"


@query("unit_clusters", f"""
WITH {BUNDLE}, {_MEMBERS}, ps AS (SELECT DISTINCT unit_id, me.span_id, start, "end" FROM me JOIN sp USING (span_id)), g AS (SELECT *, start - lag("end") OVER w AS gap FROM ps WINDOW w AS (PARTITION BY unit_id ORDER BY start, "end", span_id)),
c AS (SELECT *, sum(CASE WHEN gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY start, "end", span_id) + 1 AS cluster FROM g), n AS (SELECT unit_id, cluster, count(DISTINCT concept_id) AS n_concepts FROM me JOIN c USING (unit_id, span_id) GROUP BY ALL)
SELECT unit_id, cluster::BIGINT AS cluster, count(*)::BIGINT AS n_spans, min(start)::BIGINT AS first, max("end")::BIGINT AS last, max(CASE WHEN gap > 200 THEN gap END)::BIGINT AS gap_before, any_value(n_concepts)::BIGINT AS n_concepts FROM c JOIN n USING (unit_id, cluster) GROUP BY unit_id, cluster""")
def unit_clusters(t):
    """N-10, W-06: a unit's spans in clusters without gaps of over 200 characters."""
    b = Bundle(t)
    return bundles.unit_clusters(b.planned.join(b.links.drop("doc_id"), "concept_id").select("unit_id", "concept_id", "span_id"), b.spans, 200)


@query("external_prerequisites", f"""
WITH {BUNDLE}, w AS (SELECT DISTINCT unit_id, prerequisite FROM pl JOIN de ON dependent = concept_id WHERE prerequisite IS NOT NULL) SELECT unit_id, prerequisite FROM w WHERE (unit_id, prerequisite) NOT IN (SELECT unit_id, concept_id FROM pl)""")
def external_prerequisites(t):
    """N-10."""
    b = Bundle(t)
    return bundles.external_prerequisites(b.planned, b.dependencies)


@query("passengers", f"""
WITH {BUNDLE}, us AS (SELECT 'U' || doc_id || ':' || (line_no // 6) AS unit_id, span_id FROM sp), s AS (SELECT DISTINCT unit_id, pl.concept_id FROM pl JOIN li USING (concept_id) JOIN us USING (unit_id, span_id))
SELECT DISTINCT unit_id, concept_id FROM pl WHERE (unit_id, concept_id) NOT IN (SELECT unit_id, concept_id FROM s)""")
def passengers(t):
    """N-11: a unit's spans are six lines of its document."""
    b = Bundle(t)
    return bundles.passengers(b.planned, b.links.drop("doc_id"), b.spans.selectExpr("'U' || doc_id || ':' || (line_no div 6) AS unit_id", "span_id"))


@query("plan_validation", f"""
WITH {BUNDLE}, {_MEMBERS}, ps AS (SELECT DISTINCT unit_id, me.span_id, start, "end" FROM me JOIN sp USING (span_id)), g AS (SELECT unit_id, start - lag("end") OVER (PARTITION BY unit_id ORDER BY start, "end", span_id) AS gap FROM ps)
SELECT 'contiguity' AS "check", count(*)::BIGINT AS n FROM (SELECT DISTINCT unit_id FROM g WHERE gap > 200) UNION ALL SELECT 'unknown_span', count(*) FROM me WHERE span_id NOT IN (SELECT span_id FROM sp)
UNION ALL SELECT 'unknown_concept', count(*) FROM pl WHERE concept_id NOT IN (SELECT concept_id FROM co)""")
def plan_validation(t):
    """N-12: violations of a plan by check: units with gaps, spans and concepts that don't exist."""
    b = Bundle(t)
    members = b.planned.join(b.links.drop("doc_id"), "concept_id").select("unit_id", "concept_id", "span_id")
    clusters = bundles.unit_clusters(members, b.spans, 200)
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return count(clusters.filter("cluster > 1").select("unit_id").distinct(), "contiguity").unionByName(
        count(gates.missing_references(members, "span_id", b.spans, "span_id", "x", "unit_id"), "unknown_span")
    ).unionByName(count(gates.missing_references(b.planned, "concept_id", b.concepts, "concept_id", "x", "unit_id"), "unknown_concept"))


@query("concept_locality", f"""
WITH {BUNDLE}, m AS (SELECT li.concept_id, li.span_id, sp.span_id IS NULL AS lost, start, "end" FROM li LEFT JOIN sp ON sp.span_id = li.span_id),
s AS (SELECT concept_id, (arg_max("end", (start, "end")) FILTER (WHERE NOT lost)) - min(start) AS r, min(span_id) FILTER (WHERE lost) AS x FROM m GROUP BY concept_id)
SELECT DISTINCT co.concept_id, CASE WHEN x IS NULL THEN r END::BIGINT AS range, CASE WHEN s.concept_id IS NULL THEN 'no_source_spans' WHEN x IS NOT NULL THEN 'span_id_not_found: ' || x WHEN r > 600 THEN 'span_range_exceeds_threshold' END AS reason
FROM co LEFT JOIN s ON s.concept_id = co.concept_id""")
def concept_locality(t):
    """F-02, F-03, J-02: ranges of over 600 characters are too wide."""
    b = Bundle(t)
    return bundles.concept_locality(b.concepts, b.links, b.spans, 600)


@query("known_sources", f"WITH {BUNDLE} SELECT DISTINCT concept_id FROM li WHERE span_id IN (SELECT span_id FROM sp)")
def known_sources(t):
    """F-04."""
    b = Bundle(t)
    return bundles.known_sources(b.links, b.spans)


@query("confidence_routes", f"WITH {BUNDLE} SELECT concept_id, CASE WHEN confidence >= 0.7 THEN 'accepted' ELSE 'adjudicate' END AS route FROM co")
def confidence_routes(t):
    """F-05."""
    return bundles.by_confidence(Bundle(t).concepts)


@query("scaffolding_spans", f"WITH {BUNDLE} SELECT doc_id, span_id FROM sp WHERE disposition <> 'protected_structural' AND span_id NOT IN (SELECT span_id FROM li)")
def scaffolding_spans(t):
    """F-12."""
    b = Bundle(t)
    return bundles.scaffolding_spans(b.spans, b.links).select("doc_id", "span_id")


@query("exempt_lines", f"WITH {BUNDLE} SELECT doc_id, count(*) FILTER (WHERE line_no BETWEEN 1 AND 2 OR line_no BETWEEN doc_id % 7 AND doc_id % 7 + 1)::BIGINT AS exempt, count(*)::BIGINT AS lines FROM sp GROUP BY doc_id")
def exempt_lines(t):
    """F-07."""
    ranges = F.expr("array(named_struct('lo', 1, 'hi', 2), named_struct('lo', CAST(doc_id % 7 AS INT), 'hi', CAST(doc_id % 7 + 1 AS INT)))")
    return Bundle(t).spans.withColumn("_in", bundles.exempt(F.col("line_no"), ranges)).groupBy("doc_id").agg(F.count_if("_in").alias("exempt"), F.count("*").alias("lines"))


@query("concepts_of_spans", f"WITH {BUNDLE} SELECT span_id, count(DISTINCT concept_id)::BIGINT AS concepts, min(concept_id) AS first FROM li GROUP BY span_id")
def concepts_of_spans(t):
    """J-01: the index from a span to its concepts."""
    return Bundle(t).links.groupBy("span_id").agg(F.count_distinct("concept_id").alias("concepts"), F.min("concept_id").alias("first"))


@query("prerequisite_edges", f"WITH {BUNDLE} SELECT dependent, prerequisite FROM de WHERE prerequisite IS NOT NULL")
def prerequisite_edges(t):
    """N-01: edges from arrays of prerequisites."""
    rows = Bundle(t).dependencies.groupBy("dependent").agg(F.collect_set("prerequisite").alias("prerequisites"))
    return graph.array_edges(rows.withColumn("plan", F.lit(0)), "plan", "dependent", "prerequisites").select("dependent", "prerequisite")
