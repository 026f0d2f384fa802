"""Queries on located findings, sections, bibliographies, references of units, and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import audit, gates, intervals, matching, planning, readiness, segment
from inkbed.sources import latex, records

from .base import LINES, MANUSCRIPTS, manuscripts, query
from .bundle import BUNDLE, Bundle

_PLANTED = "CASE WHEN doc_id % 9 = 0 THEN 'See WP3, WP7 and WP3 in /home/me/x.tex. ' ELSE '' END || text"


@query("register_located", """
SELECT doc_id, x.raw AS raw, x.start AS start FROM documents, (SELECT unnest([{'raw': 'WP3', 'start': 4}, {'raw': 'WP3', 'start': 17}, {'raw': '/home/me/x.tex.', 'start': 24}]) AS x) WHERE doc_id % 9 = 0""")
def register_located(t):
    """C-41: private labels and paths with their places."""
    rows = t("documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 9 == 0, F.lit("See WP3, WP7 and WP3 in /home/me/x.tex. ")).otherwise(""), F.regexp_replace("text", "WP[0-6]|/(?:srv|home|var)/", "")).alias("s"))
    return segment.matches(rows, "doc_id", "s", "\\bWP[0-6]\\b|(?:/srv/|/home/|/var/lib|/var/log)[a-zA-Z0-9_/.-]+").select("doc_id", "raw", F.col("start").cast("bigint").alias("start"))


@query("first_person_located", """
WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'all of it' WHEN 1 THEN 'so We say' WHEN 2 THEN 'to ourselves, me' ELSE 'only  i' END AS s FROM documents)
SELECT doc_id, 'We' AS marker, 3::BIGINT AS start FROM x WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'ourselves', 3 FROM x WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 'me', 14 FROM x WHERE doc_id % 4 = 2""")
def first_person_located(t):
    """C-42: the first place of each first-person word once mathematics is gone."""
    s = F.expr("CASE doc_id % 4 WHEN 0 THEN 'all of it' WHEN 1 THEN 'so We say, we' WHEN 2 THEN 'to ourselves, me' ELSE 'only $I+me$ i' END")
    rows = t("documents").select("doc_id", T.strip_math(s).alias("s"))
    found = segment.matches(rows, "doc_id", "s", "\\b(?:I|[Ww]e|[Oo]ur(?:s|selves)?|[Mm]y(?:self)?|[Mm]ine|[Mm]e|[Uu]s)\\b").withColumn("_m", F.lower("raw"))
    return found.groupBy("doc_id", "_m").agg(F.min_by("raw", "start").alias("marker"), F.min("start").cast("bigint").alias("start")).drop("_m")


@query("assertion_sentences", """
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents) SELECT doc_id, count(*)::BIGINT AS sentences, count(*) FILTER (WHERE regexp_matches(lower(s), '(^|[^a-z])(is|the)([^a-z]|$)'))::BIGINT AS assertions,
count(*) FILTER (WHERE regexp_matches(lower(s), '(^|[^a-z])(is|the)([^a-z]|$)') AND NOT regexp_matches(s, 'https?://|10[.][0-9]{4}|@'))::BIGINT AS uncited FROM s GROUP BY doc_id""")
def assertion_sentences(t):
    """C-33, C-44: sentences that state something, and those without address, DOI or mail."""
    rows = t("documents").select("doc_id", F.explode(F.split("text", "(?<=[.!?])[ \t\n]+")).alias("s"))
    states = F.lower("s").rlike("(^|[^a-z])(is|the)([^a-z]|$)")
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(states).alias("assertions"), F.count_if(states & ~F.col("s").rlike("https?://|10[.][0-9]{4}|@")).alias("uncited"))


@query("section_structure", f"""
WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), h AS (SELECT l.doc_id, line_no + 1 AS pos, CASE WHEN line_no % 6 = 2 THEN 's' WHEN line_no % 6 IN (0, 4) THEN 'u' END AS k, n FROM l JOIN n USING (doc_id) WHERE line_no % 6 IN (0, 2, 4)),
s AS (SELECT doc_id, pos, n, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1, n) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM h WHERE k = 's'),
u AS (SELECT h.doc_id, h.pos, s.pos AS sat, least(coalesce(lead(h.pos) OVER (PARTITION BY h.doc_id, s.pos ORDER BY h.pos) - 1, s.last), s.last) AS last FROM h JOIN s ON s.doc_id = h.doc_id AND h.pos BETWEEN s.pos AND s.last WHERE k = 'u')
SELECT doc_id, 'S' || pos AS title, CASE r WHEN 1 THEN 1 ELSE pos END::BIGINT AS first_line, last::BIGINT AS last_line, NULL AS parent FROM s UNION ALL SELECT doc_id, 'U' || pos, pos, last, 'S' || sat FROM u
UNION ALL SELECT doc_id, '(entire file)', 1, n, NULL FROM n WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def section_structure(t):
    """C-38, W-12, J-20: lines of which some are headings."""
    lines = segment.line_spans(t("documents")).select("doc_id", (F.col("line_no") + 1).alias("line_no"), F.expr("CASE WHEN line_no % 6 = 2 THEN concat(chr(92), 'section{S', line_no + 1, '}') WHEN line_no % 6 IN (0, 4) THEN concat(chr(92), 'subsection{U', line_no + 1, '}') ELSE 'x' END").alias("line"))
    return segment.section_structure(lines, "doc_id")


@query("bibtex_entries", """
SELECT 'article' AS kind, 'k' || doc_id AS key, 'The {T} ' || doc_id AS title, source AS author, '20' || (10 + doc_id % 10) AS year, CASE WHEN doc_id % 2 = 0 THEN '10.1234/x' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 2 = 1 THEN '2101.0000' || (doc_id % 10) ELSE '' END AS eprint FROM documents""")
def bibtex_entries(t):
    """S-07, S-11: entries with braces, quotes and bare values; numbers lifted from notes."""
    i = F.col("doc_id").cast("string")
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doi 10.1234/x"), i, F.lit(". Cited"))).otherwise(F.concat(F.lit("arXiv: 2101.0000"), (F.col("doc_id") % 10).cast("string")))
    text = F.concat(F.lit("@article{k"), i, F.lit(",\n title = {The {T}\n  "), i, F.lit('}, author="'), "source", F.lit('", year = 20'), (F.col("doc_id") % 10 + 10).cast("string"), F.lit(",\n note={"), note, F.lit("}\n}\n"))
    return records.bibtex(t("documents").select(text.alias("value"))).drop("url")


@query("first_seen", "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_seen(t):
    """S-17: the first result of each repository."""
    return matching.keep_first(t("documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query("aligned_rows", "SELECT doc_id, i::BIGINT AS i, CASE WHEN doc_id % 2 = 0 THEN 'a{x' || chr(92) || chr(92) || '}' || chr(92) || 'label{r' || i || '}' ELSE 'a' || chr(92) || chr(92) || 'b' END AS row FROM documents, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 2 = 0 OR i = 0")
def aligned_rows(t):
    """G-08, G-10: rows of aligned displays, split outside braces, where two or more have labels."""
    b = "\\"
    two = "\\begin{align}a{x\\\\}\\label{r0}\\\\a{x\\\\}\\label{r1}\\end{align}"
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, two).otherwise(f"{b}begin{{align*}}a{b}{b}b{b}end{{align*}}").alias("tex"))
    found = latex.protected_objects(rows).filter("object_type = 'equation'")
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("r")).select("doc_id", F.posexplode("r").alias("i", "x")).select("doc_id", F.col("i").cast("bigint").alias("i"), F.col("x.raw").alias("row"))


@query("unit_references", f"""
WITH {BUNDLE}, us AS (SELECT 'U' || doc_id || ':' || (line_no // 6) AS unit_id, CASE WHEN (doc_id + line_no) % 43 = 0 THEN 'none' ELSE span_id END AS span_id FROM sp), u AS (SELECT DISTINCT unit_id FROM pl), ud AS (SELECT 'U' || doc_id AS unit_id, dependency_id || CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE '' END AS dep FROM de)
SELECT 'unit_span' AS "check", unit_id AS locator, 'span_id=' || span_id AS reason FROM us WHERE span_id NOT IN (SELECT span_id FROM sp) UNION ALL SELECT 'unit_concept', unit_id, 'concept_id=' || concept_id FROM pl WHERE concept_id NOT IN (SELECT concept_id FROM co)
UNION ALL SELECT 'unit_obligation', unit_id, 'obligation_id=' || obligation_id FROM asg WHERE obligation_id NOT IN (SELECT obligation_id FROM ob) UNION ALL SELECT 'unit_dependency', unit_id, 'dep=' || dep FROM ud WHERE dep NOT IN (SELECT dependency_id FROM de)
UNION ALL SELECT 'unit_parent', unit_id, 'parent=' || replace(unit_id, 'U', 'V') FROM u WHERE ends_with(unit_id, ':1') UNION ALL SELECT 'unit_child', unit_id, 'child=' || unit_id || ':9' FROM u WHERE ends_with(unit_id, ':0')""")
def unit_references(t):
    """J-08: a unit's spans, concepts, obligations, dependencies, parent and child."""
    b = Bundle(t)
    units = b.planned.select("unit_id").distinct()
    spans = b.spans.selectExpr("'U' || doc_id || ':' || (line_no div 6) AS unit_id", "CASE WHEN (doc_id + line_no) % 43 = 0 THEN 'none' ELSE span_id END AS span_id")
    needs = b.dependencies.selectExpr("'U' || doc_id AS unit_id", "dependency_id || CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE '' END AS dep")
    parents = units.filter("unit_id LIKE '%:1'").selectExpr("unit_id", "replace(unit_id, 'U', 'V') AS parent")
    children = units.filter("unit_id LIKE '%:0'").selectExpr("unit_id", "unit_id || ':9' AS child")
    lost = gates.missing_references
    return readiness.union([
        lost(spans, "span_id", b.spans, "span_id", "unit_span", "unit_id"), lost(b.planned, "concept_id", b.concepts, "concept_id", "unit_concept", "unit_id"), lost(b.assigned, "obligation_id", b.obligations, "obligation_id", "unit_obligation", "unit_id"),
        lost(needs, "dep", b.dependencies, "dependency_id", "unit_dependency", "unit_id"), lost(parents, "parent", units, "unit_id", "unit_parent", "unit_id"), lost(children, "child", units, "unit_id", "unit_child", "unit_id"),
    ])


@query("rewrite_mutations", """
WITH b AS (SELECT doc_id AS unit, (doc_id + i) % 50 AS concept FROM documents, (SELECT unnest([0, 1, 2]) AS i)), a AS (SELECT doc_id AS unit, (doc_id + i) % 55 AS concept, i = 2 AND doc_id % 3 = 0 AS mention FROM documents, (SELECT unnest([0, 2, 9]) AS i)), base AS (SELECT DISTINCT concept FROM b)
SELECT DISTINCT unit, concept, 'deletion' AS problem FROM b WHERE (unit, concept) NOT IN (SELECT unit, concept FROM a) UNION ALL SELECT DISTINCT unit, concept, 'addition' FROM a WHERE (unit, concept) NOT IN (SELECT unit, concept FROM b) AND concept NOT IN (SELECT concept FROM base)
UNION ALL SELECT unit, concept, 'mention_only' FROM a WHERE mention UNION ALL SELECT doc_id, NULL, 'truncation' FROM documents WHERE doc_id % 11 = 0""")
def rewrite_mutations(t):
    """U-04."""
    d = t("documents")
    before = d.select(F.col("doc_id").alias("unit"), F.explode(F.array(*[(F.col("doc_id") + i) % 50 for i in (0, 1, 2)])).alias("concept")).distinct()
    after = d.select(F.col("doc_id").alias("unit"), F.explode(F.array(*[F.struct(((F.col("doc_id") + i) % 55).alias("c"), F.when((F.col("doc_id") % 3 == 0) & F.lit(i == 2), "mention_only").otherwise("retain").alias("m")) for i in (0, 2, 9)])).alias("x"))
    outputs = d.select(F.col("doc_id").alias("unit"), F.when(F.col("doc_id") % 22 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, "  short  ").otherwise("a long enough text").alias("text"))
    return planning.rewrite_mutations(d.select(F.col("doc_id").alias("unit")), before, after.select("unit", F.col("x.c").alias("concept"), F.col("x.m").alias("mapping")), before.select("concept").distinct(), outputs)


@query("revision_failures", """
WITH d AS (SELECT doc_id, doc_id % 5 AS k, lang AS source FROM documents)
SELECT doc_id, 'empty revision' AS failure, '' AS what FROM d WHERE k = 0 UNION ALL SELECT doc_id, 'dropped citation', chr(92) || 'cite{' || source || '}' FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'dropped number', '1200' FROM d WHERE k = 2
UNION ALL SELECT doc_id, 'removed protected object', 'E=mc' FROM d WHERE k = 3 UNION ALL SELECT doc_id, 'introduced first person', 'Our' FROM d WHERE k = 4""")
def revision_failures(t):
    """U-07: what revisions drop and bring; the digit 7 is exempt."""
    cite = F.concat(F.lit("\\cite{"), "lang", F.lit("}"))
    k = F.col("doc_id") % 5
    old = F.concat(F.lit("As E=mc in "), cite, F.lit(" of 1,200 and 7 cases we say."))
    new = F.when(k == 0, F.lit("  ")).when(k == 1, F.lit("As E=mc of 1,200 cases we say.")).when(k == 2, F.concat(F.lit("As E=mc in "), cite, F.lit(" of 1,2 and 00 cases we say."))).when(k == 3, F.concat(F.lit("In "), cite, F.lit(" of 1200 cases we say."))).otherwise(F.concat(F.lit("Our E=mc in "), cite, F.lit(" of {1,200} cases, we say.")))
    out = planning.revision_failures(t("documents").select("doc_id", old.alias("old"), new.alias("new")), "doc_id", "old", "new", ["E=mc", "absent"], ("7",))
    return out.filter("NOT (doc_id % 5 IN (1, 2) AND what IN ('12', '00'))")


@query("manifest_objects", "SELECT doc_id, k AS object_type, 'h' || i || doc_id AS hash, CASE WHEN i < 5 THEN i * 10 END AS line FROM documents, (SELECT unnest(['equation', 'label', 'citation', 'displaymath', 'table']) AS k, unnest([1, 2, 3, 4, 5]) AS i) WHERE doc_id % 6 <> i")
def manifest_objects(t):
    """S-04: the five lists of a manifest in JSON, stacked."""
    lists = [("equations", 1), ("labels", 2), ("citations", 3), ("displaymath", 4), ("tables", 5)]
    item = lambda i: F.array(F.struct(F.concat(F.lit(f"h{i}"), F.col("doc_id").cast("string")).alias("hash"), F.lit("x").alias("content"), F.lit(i * 10 if i < 5 else None).cast("bigint").alias("line")))
    rows = t("documents").select("doc_id", F.to_json(F.struct(*[F.when(F.col("doc_id") % 6 != i, item(i)).alias(n) for n, i in lists])).alias("j"))
    return records.manifest_objects(rows, "doc_id", "j").select("doc_id", "object_type", "hash", "line")


@query("json_pages", "SELECT doc_id, 'P' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN '2021' ELSE '' END AS year FROM documents WHERE doc_id % 3 = 0")
def json_pages(t):
    """S-10: records of JSON pages whose text holds a term, with the year of their date."""
    i = F.col("doc_id").cast("string")
    page = F.concat(F.lit('{"results": [{"title": "P'), i, F.lit('", "displaydate": "'), F.when(F.col("doc_id") % 2 == 0, "May 2021").otherwise("soon"), F.lit('", "abstract": "'), F.when(F.col("doc_id") % 3 == 0, "On Writing").otherwise("none"), F.lit('"}]}'))
    return records.json_page(t("documents").select("doc_id", page.alias("payload")), "doc_id", "payload", ("writing",))


@query("html_anchors", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS i FROM pages)
SELECT url, arg_min(trim(title), (page_id, i)) AS title, min(page_id) AS page_id FROM a GROUP BY url""")
def html_anchors(t):
    """S-09: address and title of each link, the first one of an address wins."""
    return records.html_anchors(t("pages"), "page_id", '<a href="([^"]*)">([^<]*)</a>')


@query("package_census", """
WITH f AS (SELECT source AS package, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.' || lang END AS ext, doc_id % 5 = 0 AS test FROM documents), c AS (SELECT package, ext, count(*) AS n FROM f WHERE ext <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY n DESC, ext) AS r FROM c) SELECT f.package, count(*)::BIGINT AS files, count(*) FILTER (WHERE test)::BIGINT AS tests, (SELECT string_agg(ext || ':' || n, ', ' ORDER BY r) FROM r WHERE r.package = f.package AND r <= 5) AS languages FROM f GROUP BY f.package""")
def package_census(t):
    """S-24: files, test files and the five commonest suffixes of each package (a top-k report)."""
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, "tests/").otherwise("lib/"), F.lit("a"), F.col("doc_id").cast("string"), F.expr("CASE doc_id % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.' || lang END"))
    return records.file_census(t("documents").select(F.col("source").alias("package"), path.alias("path")), "package")


@query("term_groups", "WITH c AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS x FROM documents) SELECT doc_id, (contains(x, 'the')::INT + contains(x, 'tion')::INT)::BIGINT AS ai, contains(x, 'ung')::INT::BIGINT AS writing, (contains(x, 'the')::INT + contains(x, 'tion')::INT + contains(x, 'ung')::INT)::BIGINT AS total FROM c")
def term_groups(t):
    """C-11: terms of each group that a text holds, and of all."""
    x = F.col("text")
    return t("documents").select("doc_id", T.term_hits(x, ("the", "tion")).alias("ai"), T.term_hits(x, ("ung",)).alias("writing"), (T.term_hits(x, ("the", "tion")) + T.term_hits(x, ("ung",))).alias("total"))


@query("cycle_caps", "WITH c AS (SELECT conv_id, turn, role AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, CASE WHEN r > 4 THEN 'cycle cap' WHEN EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.s = c.s AND d.r < c.r) THEN 'repeated signature' END AS stop FROM c")
def cycle_caps(t):
    """W-16: a repair stops at a signature that was there before, and after four cycles."""
    rows = gates.repeats(t("conversations").select("conv_id", "turn", F.col("role").alias("s")), ["conv_id"], "turn", "s")
    return gates.capped(rows, ["conv_id"], "turn", 4).select("conv_id", "turn", "stop")


@query("manuscript_object_links", f"""
WITH {MANUSCRIPTS}, o AS (SELECT doc_id, tex, chr(92) || 'label{{d' || doc_id || '}}' AS raw FROM ms), p AS (SELECT doc_id, strpos(tex, raw) - 1 AS s, strpos(tex, raw) - 1 + length(raw) AS e, length(tex) AS n FROM o),
sp AS (SELECT doc_id, i, i * (n // 3) AS a, CASE i WHEN 2 THEN n ELSE (i + 1) * (n // 3) END AS b FROM p, (SELECT unnest([0, 1, 2]) AS i)) SELECT p.doc_id, CASE WHEN bool_or(a <= s AND e <= b) THEN 'linked' ELSE 'straddling' END AS status FROM p JOIN sp ON sp.doc_id = p.doc_id AND s < b AND a < e GROUP BY p.doc_id""")
def manuscript_object_links(t):
    """J-09, F-01: the manuscripts' labels in spans of a third of the text: inside one, or over the edge of two."""
    m = manuscripts(t("documents")).select("doc_id", "tex")
    third = m.select("doc_id", F.length("tex").alias("n")).select("doc_id", F.explode(F.array(*[F.struct((F.lit(i) * F.floor(F.col("n") / 3)).alias("start"), (F.col("n") if i == 2 else F.lit(i + 1) * F.floor(F.col("n") / 3)).cast("bigint").alias("end")) for i in range(3)])).alias("x")).select("doc_id", "x.start", "x.end")
    spans = third.select("doc_id", F.concat_ws(":", "doc_id", "start").alias("span_id"), "start", "end")
    labels = latex.protected_objects(m).filter("object_type = 'label'").select("doc_id", F.concat_ws("@", "doc_id", "start").alias("object_id"), "start", "end")
    return intervals.object_links(labels, spans, "doc_id").select("doc_id", "status")


@query("unit_words", f"""
WITH {BUNDLE}, m AS (SELECT DISTINCT unit_id, span_id FROM pl JOIN li USING (concept_id)) SELECT unit_id, floor(sum(len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\x0B]+'))) * 1.5)::BIGINT AS words FROM m JOIN sp USING (span_id) GROUP BY unit_id""")
def unit_words(t):
    """A-19: words of a unit's distinct spans, by half as many more."""
    b = Bundle(t)
    spans = b.planned.join(b.links.drop("doc_id"), "concept_id").select("unit_id", "span_id").distinct().join(b.spans.select("span_id", "line"), "span_id")
    return spans.groupBy("unit_id").agg(F.floor(F.sum(T.word_count(F.col("line"))) * 1.5).cast("bigint").alias("words"))


@query("objects_by_type", f"WITH {MANUSCRIPTS} SELECT 'citation' AS object_type, 2 * count(*) AS n FROM ms UNION ALL SELECT 'label', count(*) FROM ms")
def objects_by_type(t):
    """A-02: counts by type."""
    return latex.protected_objects(manuscripts(t("documents"))).groupBy("object_type").agg(F.count("*").alias("n"))


@query("document_rules", """
WITH d AS (SELECT doc_id, doc_id % 8 AS k FROM documents), n AS (SELECT unnest(['headings', 'require', 'forbid', 'pattern', 'template', 'words', 'cited']) AS name, unnest(range(7)) AS i) SELECT doc_id, name, k <> i AS ok FROM d, n""")
def document_rules(t):
    """V-21: seven kinds of rules on texts of which each breaks one or none."""
    b, k = "\\", F.col("doc_id") % 8
    part = lambda i, good, bad: F.when(k == i, F.lit(bad)).otherwise(F.lit(good))
    text = F.concat(
        part(0, f"{b}chapter{{One}}\n{b}section{{Two}}\n", f"{b}chapter{{One}}\n"), part(1, "The  Claim\nholds. ", "It holds. "), part(2, "plain ", "Search\nevents: "), part(3, "done ", "WP3 "), part(4, "so so ", "so so so "),
        F.when(k == 5, F.lit("")).otherwise(F.repeat(F.lit("word "), F.lit(20))), part(6, f"{b}cite{{a, b}}", f"{b}cite{{a, c}}"), F.lit(f"{b}appendix WP4 search events {b}cite{{z}}"),
    )
    rules = [
        ("headings", "headings", ["One", "Two"]), ("require", "require", ["the claim holds"]), ("forbid", "forbid", ["search events:"]), ("pattern", "forbid_pattern", "\\bWP[0-9]"),
        ("template", "at_most", ("\\bso\\b", 2)), ("words", "words", (20, 60)), ("cited", "cited", ["a", "b"]),
    ]
    return audit.text_rules(t("documents").select("doc_id", text.alias("x")), "doc_id", "x", rules)
