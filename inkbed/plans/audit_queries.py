"""Queries on the audit: stored answers of services, gates, integrity, lookups, occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.operators import audit, reviews, segment
from inkbed.sources import apis

from .base import LINES, query


def _answers(t, payload):
    return t("documents").select("doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"), F.lit("broad").alias("search_mode"), payload.alias("payload"), F.substring("source", 1, 8).alias("source"))


@query("openalex_rows", """
SELECT 'q' || doc_id AS query, 'broad' AS search_mode, 'T ' || doc_id AS title, 'A; ' || source AS authors, '2020' AS year, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE 'W' || doc_id END AS url, 'big cat big' AS abstract, source AS venue FROM documents WHERE doc_id % 7 <> 0""")
def openalex_rows(t):
    """S-14."""
    author = lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))
    item = F.struct(
        F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("T "), F.col("doc_id").cast("string")).alias("title"), F.lit(2020).alias("publication_year"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("doi"), F.array(author(F.lit("A")), author(F.col("source"))).alias("authorships"),
        F.create_map(F.lit("cat"), F.array(F.lit(1)), F.lit("big"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"), F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"),
    )
    payload = F.when(F.col("doc_id") % 7 == 0, "not json").otherwise(F.to_json(F.struct(F.array(item).alias("results"))))
    return apis.openalex(_answers(t, payload))


@query("crossref_rows", """
SELECT 'q' || doc_id AS query, 'broad' AS search_mode, 'T ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'Ann Lee; Cole' ELSE 'Ann Lee' END AS authors, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2019' END AS year, '10.2/' || doc_id AS doi, 'http://x/' || doc_id AS url, ' p a b /p ' AS abstract, 'V' AS venue FROM documents""")
def crossref_rows(t):
    """S-15."""
    i = F.col("doc_id").cast("string")
    people = F.when(F.col("doc_id") % 3 == 0, '[{"given": "Ann", "family": "Lee"}, {"family": "Cole"}]').otherwise('[{"given": "Ann", "family": "Lee"}]')
    year = F.when(F.col("doc_id") % 4 == 0, "").otherwise('"published": {"date-parts": [[2019, 5]]}, ')
    payload = F.concat(
        F.lit('{"message": {"items": [{"title": ["T '), i, F.lit('"], "author": '), people, F.lit(", "), year, F.lit('"DOI": "10.2/'), i, F.lit('", "URL": "http://x/'), i, F.lit('", "abstract": "<jats:p> p a b /p</jats:p>", "container-title": ["V"]}]}}')
    )
    return apis.crossref(_answers(t, payload)).withColumn("abstract", F.regexp_replace("abstract", " +", " "))


@query("challenge_rows", """
SELECT 'q' || doc_id AS query, 'known-item-challenge' AS search_mode, 'T' AS title, 'Ann Lee; Bo' AS authors, CASE WHEN doc_id % 2 = 0 THEN '2021' ELSE '' END AS year, '' AS doi, CASE WHEN doc_id % 3 = 0 THEN 'https://e.org/p' ELSE 'https://b.org/p/' || doc_id END AS url, '' AS abstract, 'Catalogue' AS venue FROM documents""")
def challenge_rows(t):
    """S-16."""
    i = F.col("doc_id").cast("string")
    payload = F.concat(
        F.lit('{"results": [{"title": "T", "authors": ["<a href=x>Ann Lee</a>", "Bo"], "displaydate": "'), F.when(F.col("doc_id") % 2 == 0, "May 2021").otherwise("soon"),
        F.lit('", "url": "'), F.when(F.col("doc_id") % 3 == 0, F.lit("https://e.org/p")).otherwise(F.concat(F.lit("/p/"), i)), F.lit('"}]}'),
    )
    return apis.public_search(_answers(t, payload), "https://b.org", "Catalogue")


@query("search_events", "SELECT 'q' || doc_id AS query, 'broad' AS search_mode, CASE doc_id % 5 WHEN 0 THEN 'not-run-offline' WHEN 1 THEN 'unreadable' ELSE 'http-200' END AS status, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE doc_id % 5 - 2 END::BIGINT AS result_count FROM documents")
def search_events(t):
    """The ledger of searches: what did not run or can't be read has no results."""
    items = F.expr("array_join(slice(array('{\"a\": 1}', '{\"a\": 2}', '{\"a\": 3}'), 1, CAST(doc_id % 5 - 2 AS INT)), ',')")
    payload = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.lit("{oops")).otherwise(F.concat(F.lit('{"results": ['), F.when(F.col("doc_id") % 5 > 2, items).otherwise(""), F.lit("]}")))
    return apis.events(_answers(t, payload), "results")


@query("package_registry", """
SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN 'not-asked' WHEN p_partkey % 4 = 0 THEN 'npm' WHEN p_partkey % 4 = 1 THEN 'python' WHEN p_partkey % 4 = 2 THEN 'repository' ELSE 'not-applicable' END AS lookup,
CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' WHEN p_partkey % 4 < 2 THEN '1.' || p_partkey ELSE '' END AS registry_version, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' ELSE 'MIT' END AS registry_license,
CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' WHEN p_partkey % 6 = 1 THEN 'archived' ELSE 'metadata-retrieved' END AS registry_status FROM part""")
def package_registry(t):
    """S-18."""
    p = t("part")
    packages = p.selectExpr("'p' || p_partkey AS name", "element_at(array('npm', 'Python', 'other', 'other'), CAST(p_partkey % 4 + 1 AS INT)) AS ecosystem", "CASE WHEN p_partkey % 4 = 2 THEN 'https://github.com/a/b' ELSE '' END AS repository", "CASE WHEN p_partkey % 7 = 0 THEN 'github-search' ELSE 'protocol-seed' END AS source")
    answers = p.filter("p_partkey % 5 != 0").selectExpr(
        "'p' || p_partkey AS name",
        """'{"archived": ' || (p_partkey % 6 = 1) || ', "license": {"spdx_id": "MIT"}, "info": {"license": "MIT"' || CASE WHEN p_partkey % 4 = 1 THEN ', "version": "1.' || p_partkey || '"' ELSE '' END || '}, "dist-tags": {"latest": "1.' || p_partkey || '"}}' AS payload""",
    )
    return apis.registry(packages, answers)


@query("manifest_lines", "SELECT 'pkg' || p_partkey AS name, 'abcdef0' || p_partkey AS commit, 'https://e/' || p_partkey AS repository, 'vendor-manifest' AS source FROM part WHERE p_partkey % 3 <> 0")
def manifest_lines(t):
    """S-19: lines of another form are left out."""
    return apis.manifest_lines(t("part").selectExpr("'  pkg' || p_partkey || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'xyz' ELSE 'abcdef0' || p_partkey END || '  https://e/' || p_partkey || ' ' AS value"))


@query("aux_visuals", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, doc_id % 40 AS page FROM documents WHERE doc_id % 3 <> 0")
def aux_visuals(t):
    """S-20."""
    b = F.chr(F.lit(92))
    line = F.concat(b, F.lit("@writefile{lof}{"), b, F.lit("contentsline {"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'section' WHEN doc_id % 2 = 0 THEN 'figure' ELSE 'table' END"), F.lit("}{"), b, F.lit("numberline {1}{"), b, F.lit("ignorespaces x}}{"), (F.col("doc_id") % 40).cast("string"), F.lit("}{}}"))
    return apis.visuals(t("documents").select("doc_id", line.alias("value")))


@query("evidence_files", "SELECT CASE doc_id % 4 WHEN 0 THEN '/etc/' WHEN 1 THEN 'ev/../' WHEN 2 THEN 'other/' ELSE 'ev/' END || doc_id AS path, CASE WHEN doc_id % 4 = 3 THEN source END AS text, CASE doc_id % 4 WHEN 0 THEN 'refused' WHEN 1 THEN 'refused' WHEN 2 THEN 'outside' ELSE 'read' END AS status FROM documents")
def evidence_files(t):
    """S-25."""
    files = t("documents").selectExpr("CASE doc_id % 4 WHEN 0 THEN '/etc/' WHEN 1 THEN 'ev/../' WHEN 2 THEN 'other/' ELSE 'ev/' END || doc_id AS path", "source AS text")
    return apis.evidence_files(files, F.lit("ev/"))


@query("blueprint_units", """
SELECT doc_id, c AS chapter, u AS unit, 'S' || u AS title, CASE WHEN u = 1 THEN 500 ELSE 300 END::BIGINT AS word_budget FROM documents, (SELECT unnest([0, 1])::BIGINT AS c), (SELECT unnest([0, 1])::BIGINT AS u) WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 0, 0, 'flat', 700 FROM documents WHERE doc_id % 2 = 1""")
def blueprint_units(t):
    """G-19: nested and flat blueprints."""
    unit = '{"title": "S0", "word_budget": 300}, {"title": "S1"}'
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, f'{{"chapters": [{{"title": "a", "subsections": [{unit}]}}, {{"title": "b", "subsections": [{unit}]}}]}}').otherwise('{"subsections": [{"title": "flat", "word_budget": 700}]}').alias("j"))
    return apis.flatten_blueprint(rows, "doc_id", "j")


@query("audit_gates", """
WITH e AS (SELECT doc_id, quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT * FROM e WHERE n_chars % 2 = 0), lb AS (SELECT * FROM e WHERE quality IS NOT NULL), em AS (SELECT * FROM lb WHERE toxic = 0)
SELECT 'manual-independent-screening' AS gate, count(*)::BIGINT AS n, count(*) FILTER (WHERE doc_id % 9 <> 0 AND NOT (doc_id % 3 = 0 AND doc_id % 2 = 1))::BIGINT AS good, false AS passed FROM s
UNION ALL SELECT 'full-text-load-bearing-evidence', count(*), count(*) FILTER (WHERE quality = 1), false FROM em UNION ALL SELECT 'critical-appraisal', count(*), count(*) FILTER (WHERE doc_id % 5 <> 0), false FROM em
UNION ALL SELECT 'bibliographic-identity', count(*), count(*), true FROM lb WHERE doc_id % 4 = 0
UNION ALL SELECT 'known-item-broad-recall', count(*), count(*) FILTER (WHERE doc_id % 10 <> 0), true FROM e UNION ALL SELECT 'known-item-challenge-recall', count(*), count(*) FILTER (WHERE doc_id % 10 <> 0), false FROM e
UNION ALL SELECT 'package-provenance', count(*), count(*) FILTER (WHERE p_size % 11 <> 0), bool_and(p_size % 11 <> 0) FROM part UNION ALL SELECT 'package-held-out-benchmark', 0, 0, false""")
def audit_gates(t):
    """V-16, A-15: gates of which each names what it counted; without rows a gate does not pass."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    screening = d.filter("n_chars % 2 = 0").selectExpr(
        "true AS selected", "'include' AS reviewer_1", "CASE WHEN doc_id % 9 = 0 THEN 'maybe' ELSE 'exclude' END AS reviewer_2", "CASE WHEN doc_id % 3 = 0 THEN 'exclude' ELSE 'include' END AS adjudication", "CASE WHEN doc_id % 2 = 0 THEN 'E1' ELSE 'E9' END AS exclusion_code"
    )
    codes = d.sparkSession.createDataFrame([("E1",), ("E2",)], "code string")
    evidence = d.selectExpr(
        "quality IS NOT NULL AS load_bearing", "toxic = 0 AS empirical", "CASE WHEN quality = 1 THEN 'Full Text read' ELSE 'abstract' END AS inspection", "'verified' AS verification", "'completed-low-concern' AS appraisal", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'p1' END AS anchor", "'small' AS limitations",
        "CASE WHEN doc_id % 4 = 0 THEN '10.1/x' END AS doi", "'verified' AS identity",
    )
    hit = F.col("doc_id") % 10 != 0
    gates = [
        audit.screening_done(screening, codes),
        audit.evidence_gates(evidence),
        audit.at_least(d, 0.8, hit, "known-item-broad-recall"),
        audit.at_least(d, 1.0, hit, "known-item-challenge-recall"),
        audit.all_hold(t("part").selectExpr("CASE WHEN p_size % 11 = 0 THEN 'unknown' ELSE 'remote-only' END AS p"), F.col("p").isin(*audit.PINNED), "package-provenance"),
        audit.all_hold(t("part").filter("p_partkey < 0"), F.lit(True), "package-held-out-benchmark"),
    ]
    return audit.union(gates)


@query("known_item_recall", "SELECT lang, count(*)::BIGINT AS total, count(*) FILTER (WHERE n_chars % 3 <> 0 AND doc_id % 4 <> 0)::BIGINT AS found, avg((n_chars % 3 <> 0 AND doc_id % 4 <> 0)::INT::DOUBLE) AS recall FROM documents GROUP BY lang")
def known_item_recall(t):
    """A-15: a match with a seed only is no retrieval."""
    return reviews.recall(t("documents").selectExpr("lang", "n_chars % 3 != 0 AS retrieved", "doc_id % 4 = 0 AS seed"), "lang", "retrieved", "seed")


@query("input_errors", """
WITH e AS (SELECT CASE WHEN doc_id % 50 = 7 THEN '' ELSE 'e' || (doc_id // CASE WHEN doc_id % 40 < 2 THEN 2 ELSE 1 END) END AS id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'f' END AS finding, CASE doc_id % 8 WHEN 1 THEN 'x10' WHEN 2 THEN '10.1234/a' ELSE '' END AS doi, doc_id FROM documents),
k AS (SELECT 'e' || doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'Q9' ELSE 'Q1' END AS question FROM documents WHERE doc_id % 17 <> 0)
SELECT 'input' AS "check", id AS locator, 'missing finding' AS reason FROM e WHERE finding = '' UNION ALL SELECT 'input', '?', 'empty id' FROM e WHERE id = '' UNION ALL SELECT 'input', id, 'duplicate id' FROM e WHERE id <> '' GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'input', id, 'invalid DOI: ' || doi FROM e WHERE doi = 'x10' UNION ALL SELECT 'input', id, 'unknown question: ' || question FROM k WHERE question = 'Q9' UNION ALL SELECT 'input', id, 'no question' FROM e WHERE id NOT IN (SELECT id FROM k)""")
def input_errors(t):
    """V-17."""
    d = t("documents")
    evidence = d.selectExpr("CASE WHEN doc_id % 50 = 7 THEN '' ELSE 'e' || (doc_id div CASE WHEN doc_id % 40 < 2 THEN 2 ELSE 1 END) END AS id", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'f' END AS finding", "CASE doc_id % 8 WHEN 1 THEN 'x10' WHEN 2 THEN '10.1234/a' ELSE '' END AS doi")
    links = d.filter("doc_id % 17 != 0").selectExpr("'e' || doc_id AS id", "CASE WHEN doc_id % 13 = 0 THEN 'Q9' ELSE 'Q1' END AS question")
    return audit.input_errors(evidence, d.sparkSession.createDataFrame([("Q1",)], "question string"), links, ["finding"])


@query("raw_integrity", "SELECT doc_id AS event, 'r' || doc_id AS raw, CASE WHEN doc_id % 6 = 1 THEN 'missing' WHEN doc_id % 6 IN (2, 3) THEN 'hash-mismatch' ELSE 'pass' END AS status FROM documents WHERE doc_id % 6 <> 0")
def raw_integrity(t):
    """V-18, V-27: recorded hashes against those of the stored answers."""
    d = t("documents")
    events = d.select(F.col("doc_id").alias("event"), F.expr("CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'r' || doc_id END").alias("raw"), F.when(F.col("doc_id") % 6 == 2, "").when(F.col("doc_id") % 6 == 3, "x").otherwise(F.sha2("text", 256)).alias("expected"))
    return audit.integrity(events, d.filter("doc_id % 6 != 1").select(F.expr("'r' || doc_id").alias("raw"), F.sha2("text", 256).alias("actual")))


@query("fresh_objects", f"""WITH {LINES} SELECT doc_id, start, (doc_id + line_no) % 7 <> 0 OR "end" - start < 2 AS in_place, (doc_id + line_no) % 5 <> 0 AS hash_fresh FROM l WHERE line <> ''""")
def fresh_objects(t):
    """V-19: lines as objects, some moved, some with an old hash."""
    lines = segment.line_spans(t("documents")).filter("line != ''")
    moved = F.expr("CASE WHEN (doc_id + line_no) % 7 = 0 AND end - start >= 2 THEN line || '#moved' ELSE line END")
    rows = lines.select("doc_id", "line_no", "start", moved.alias("raw"))
    objects = rows.withColumn("hash", F.when(F.expr("(doc_id + line_no) % 5 = 0"), "old").otherwise(F.sha2("raw", 256)))
    return audit.fresh(objects, t("documents").select("doc_id", "text"), "doc_id")


@query("missing_ids", "SELECT doc_id, left(text, 3) || '~' AS id FROM documents WHERE doc_id % 2 = 1")
def missing_ids(t):
    """X-11."""
    d = t("documents").select("doc_id", "text")
    return audit.ids_in_text(d, d.select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.concat(F.substring("text", 1, 3), F.lit("~"))).otherwise(F.substring("text", 2, 3)).alias("id")), "doc_id")


@query("term_paragraph_counts", f"""
WITH {LINES}, w AS (SELECT doc_id, line_no AS paragraph, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM l) SELECT doc_id, paragraph, term, count(*)::BIGINT AS n FROM w WHERE term IN ('the', 'der', 'que', 'license') GROUP BY ALL""")
def term_paragraph_counts(t):
    """J-21."""
    lines = segment.line_spans(t("documents")).select("doc_id", F.col("line_no").alias("paragraph"), F.col("line").alias("text"))
    return audit.term_counts(lines, lines.sparkSession.createDataFrame([("the",), ("der",), ("Que",), ("license",)], "term string"), "doc_id")


@query("section_objects", f"""
WITH {LINES}, s AS (SELECT doc_id, line_no // 5 AS section, min(line_no) AS first, max(line_no) AS last, CASE WHEN (line_no // 5) % 2 = 1 THEN 'b.tex' END AS file FROM l GROUP BY doc_id, line_no // 5), o AS (SELECT doc_id, line_no AS line, '/x/' || CASE WHEN line_no % 2 = 0 THEN 'a.tex' ELSE 'b.tex' END AS file FROM l WHERE line_no % 3 = 0)
SELECT s.doc_id, section, count(*)::BIGINT AS objects FROM o JOIN s ON s.doc_id = o.doc_id AND o.line BETWEEN s.first AND s.last AND (s.file IS NULL OR ends_with(o.file, s.file)) GROUP BY ALL""")
def section_objects(t):
    """F-06, J-20: every third line holds an object, five lines are a section, odd sections are of another file."""
    lines = segment.line_spans(t("documents"))
    sections = lines.groupBy("doc_id", F.expr("line_no div 5").alias("section")).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")).withColumn("file", F.expr("CASE WHEN section % 2 = 1 THEN 'b.tex' END"))
    objects = lines.filter("line_no % 3 = 0").select("doc_id", F.col("line_no").alias("line"), F.expr("'/x/' || CASE WHEN line_no % 2 = 0 THEN 'a.tex' ELSE 'b.tex' END").alias("file"))
    return audit.section_objects(objects, sections, "doc_id").groupBy("doc_id", "section").agg(F.count("*").alias("objects"))


@query("occurrence_mapping", """
WITH p AS (SELECT doc_id, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 2) = 'er') AS p FROM documents) SELECT doc_id, 'o' || k AS id, p[k] - 1 AS start, p[k] + 1 AS "end" FROM p, (SELECT unnest([1, 2, 3]) AS k) UNION ALL SELECT doc_id, 'o4', NULL, NULL FROM documents""")
def occurrence_mapping(t):
    """J-15, X-07: three equal objects take three occurrences in turn; one can't be found."""
    d = t("documents").select("doc_id", "text")
    objects = d.select("doc_id", F.explode(F.expr("array(named_struct('id', 'o1', 'raw', 'er'), named_struct('id', 'o2', 'raw', 'er'), named_struct('id', 'o3', 'raw', 'er'), named_struct('id', 'o4', 'raw', '@@@'))")).alias("o"))
    return audit.map_occurrences(d, objects.select("doc_id", "o.id", "o.raw", F.lit(None).cast("int").alias("line")), "doc_id")


@query("missing_with_note", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN source END, 'not found in source') AS content FROM documents WHERE doc_id % 3 = 0")
def missing_with_note(t):
    """J-03."""
    d = t("documents")
    return reviews.left_with_note(d.filter("doc_id % 3 = 0").select("doc_id"), d.filter("doc_id % 4 != 0").select("doc_id", F.col("source").alias("content")), "doc_id")


_REUSE = """r AS (SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN '' ELSE '10.1/' || doc_id // 2 END AS doi, CASE WHEN doc_id % 6 = 1 THEN 'arXiv:1' ELSE '' END AS identifier, doc_id // 2 AS h FROM documents),
s AS (SELECT doc_id, CASE WHEN doi = '' AND identifier <> '' THEN 'identifier-only' WHEN doi = '' THEN 'not-applicable-no-doi' WHEN h % 5 = 0 OR h % 7 = 0 THEN 'open' WHEN h % 2 = 0 THEN 'verified' ELSE 'identity-mismatch' END AS status, doi <> '' AND h % 5 <> 0 AND h % 7 <> 0 AS reused FROM r)"""


def _reused(t):
    rows = t("documents").selectExpr("doc_id", "CASE WHEN doc_id % 6 < 2 THEN '' ELSE '10.1/' || (doc_id div 2) END AS doi", "CASE WHEN doc_id % 6 = 1 THEN 'arXiv:1' ELSE '' END AS identifier", "'Red cats and dogs ' || (doc_id div 2) AS title")
    cache = t("documents").filter("(doc_id div 2) % 5 != 0").selectExpr("'10.1/' || (doc_id div 2) AS doi", "CASE WHEN (doc_id div 2) % 7 = 0 THEN 'unresolved' ELSE 'verified' END AS status", "CASE WHEN (doc_id div 2) % 2 = 0 THEN 'The red Cats, dogs ' || (doc_id div 2) ELSE 'Blue' END AS canonical_title").distinct()
    return reviews.reuse(rows, cache, "doi")


@query("doi_reuse", f"WITH {_REUSE} SELECT * FROM s")
def doi_reuse(t):
    """J-04: titles are compared with those of verified answers."""
    return _reused(t).select("doc_id", "status", "reused")


@query("doi_audit", f"""
WITH {_REUSE} SELECT count(*)::BIGINT AS total_rows, count(*) FILTER (WHERE status NOT IN ('not-applicable-no-doi', 'identifier-only'))::BIGINT AS doi_rows, count(*) FILTER (WHERE status = 'verified')::BIGINT AS verified, count(*) FILTER (WHERE status = 'identity-mismatch')::BIGINT AS mismatches, count(*) FILTER (WHERE status = 'open')::BIGINT AS unresolved FROM s""")
def doi_audit(t):
    """A-20."""
    return reviews.identity_summary(_reused(t))


@query("latest_draft", """
WITH d AS (SELECT 's' || (event_id % 40) AS stem, event_id // 40 AS run, 'e' || event_id AS path FROM events WHERE event_id % 40 <> 5), n AS (SELECT stem, arg_max(path, run) AS path FROM d GROUP BY stem) SELECT i::BIGINT AS index, 's' || i AS stem, path FROM (SELECT unnest(range(40)) AS i) LEFT JOIN n ON n.stem = 's' || i""")
def latest_draft(t):
    """J-16: the newest run's draft of each section; there is no fallback where runs have several drafts."""
    e = t("events").filter("event_id % 40 != 5").selectExpr("'s' || (event_id % 40) AS stem", "event_id div 40 AS run", "'e' || event_id AS path")
    return reviews.latest_by_name(e.sparkSession.range(40).selectExpr("id AS index", "'s' || id AS stem"), e)


@query("latest_draft_by_place", "SELECT i::BIGINT AS index, 's' || i AS stem, 'r' || i || '.tex' AS path FROM (SELECT unnest(range(5)) AS i)")
def latest_draft_by_place(t):
    """J-16: one draft in each run: sections take them in order of runs."""
    spark = t("nation").sparkSession
    drafts = t("nation").filter("n_nationkey < 5").selectExpr("'run' || n_nationkey AS run", "'other' || n_nationkey AS stem", "'r' || n_nationkey || '.tex' AS path")
    return reviews.latest_by_name(spark.range(5).selectExpr("id AS index", "'s' || id AS stem"), drafts)
