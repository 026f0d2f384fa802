"""Queries on texts: audit funnel, spans, windows, scans, counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import gates, intervals, matching, metrics, segment

from .base import BIB, LINES, MANUSCRIPTS, manuscripts, query

TERMS = ("tion", "the", "ung", "que", "license")
_HITS = " + ".join(f"contains(norm, '{t}')::INT" for t in TERMS)


@query("doc_audit_funnel", f"""
WITH c AS (SELECT doc_id, source, {BIB} AS norm FROM documents),
i AS (SELECT sha256(norm) AS identity, arg_min(norm, doc_id) AS norm, min(doc_id) AS first_seen, count(*) AS members FROM c GROUP BY 1),
h AS (SELECT *, {_HITS} AS hits, members > 1 AS known FROM i),
r AS (SELECT *, CASE WHEN hits = 0 AND NOT known THEN 'auto_exclude' ELSE 'screen' END AS route FROM h),
q AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || identity), identity) AS rn FROM r WHERE route = 'screen')
SELECT (SELECT count(*) FROM c)::BIGINT AS candidates, (SELECT count(*) FROM i)::BIGINT AS identities, (SELECT count(*) FROM r WHERE route = 'auto_exclude')::BIGINT AS auto_excluded,
       (SELECT count(*) FROM q)::BIGINT AS to_screen, (SELECT count(*) FROM q WHERE rn <= 200)::BIGINT AS queued, (SELECT sum(hits) FROM q WHERE rn <= 200)::BIGINT AS queued_hits,
       (SELECT count(*) FROM r WHERE known)::BIGINT AS known_items
""")
def doc_audit_funnel(t):
    """Normalise, identify, merge, score, route, sample by a stable hash, and count each step."""
    docs = t("documents").select("doc_id", "source", T.bibliographic(F.col("text")).alias("norm"))
    merged = matching.dedup_merge(docs, F.sha2("norm", 256), "doc_id", ["norm"])
    hits = sum((F.when(F.contains("norm", F.lit(x)), 1).otherwise(0) for x in TERMS), F.lit(0))
    scored = merged.select("identity", "members", hits.alias("hits"), (F.col("members") > 1).alias("known"))
    routed = scored.withColumn("route", F.when((F.col("hits") == 0) & ~F.col("known"), "auto_exclude").otherwise("screen"))
    queue = routed.filter("route = 'screen'").withColumn("_h", F.sha2(F.concat_ws(":", F.lit("42"), "identity"), 256)).orderBy("_h", "identity").limit(200)
    counts = routed.agg(
        F.sum("members").alias("candidates"), F.count("*").alias("identities"), F.count_if(F.col("route") == "auto_exclude").alias("auto_excluded"),
        F.count_if(F.col("route") == "screen").alias("to_screen"), F.count_if("known").alias("known_items"),
    )
    queued = queue.agg(F.struct(F.count("*").alias("queued"), F.sum("hits").cast("bigint").alias("queued_hits")).alias("q"))
    return counts.withColumn("q", queued.scalar()).select(*counts.columns, "q.*")


@query("line_spans", f"WITH {LINES} SELECT doc_id, line_no, start, \"end\", length(line)::BIGINT AS n_chars FROM l")
def line_spans(t):
    return segment.line_spans(t("documents")).select("doc_id", "line_no", "start", "end", F.length("line").cast("bigint").alias("n_chars"))


@query("span_identity", f"""
WITH {LINES}, h AS (SELECT doc_id, sha256(text) AS source_hash FROM documents)
SELECT l.doc_id, line_no, 'span-' || substr(sha256(source_hash || chr(0) || l.doc_id::VARCHAR || '.tex' || chr(0) || start::VARCHAR || chr(0) || "end"::VARCHAR), 1, 16) AS span_id
FROM l JOIN h USING (doc_id)""")
def span_identity(t):
    docs = t("documents").withColumn("source_hash", F.sha2("text", 256))
    spans = segment.line_spans(docs).join(docs.select("doc_id", "source_hash"), "doc_id")
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".tex"))
    return spans.select("doc_id", "line_no", segment.span_id(F.col("source_hash"), file, F.col("start"), F.col("end")).alias("span_id"))


_DENT = "CASE WHEN line_no % 7 = 3 THEN start + 5 WHEN line_no % 11 = 4 THEN start - 3 ELSE start END"


@query("span_coverage_violations", f"""
WITH {LINES}, s AS (SELECT doc_id, {_DENT} AS start, "end" FROM l),
c AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM s),
v AS (SELECT doc_id, CASE WHEN "end" <= start THEN 'empty' WHEN start > cur THEN 'gap' WHEN start < cur THEN 'overlap' END AS problem, start AS at, abs(start - cur) AS amount FROM c)
SELECT doc_id, problem, at::BIGINT AS at, amount::BIGINT AS amount FROM v WHERE problem IS NOT NULL
UNION ALL SELECT doc_id, 'trailing', m, 2 FROM (SELECT doc_id, max("end") AS m FROM s GROUP BY doc_id)""".replace(" AS at", ' AS "at"').replace("SELECT doc_id, problem, at::", 'SELECT doc_id, problem, "at"::'))
def span_coverage_violations(t):
    """Lines with planted dents against a declared size that is two too large."""
    spans = segment.line_spans(t("documents")).select("doc_id", "line_no", F.expr(_DENT).alias("start"), "end")
    sizes = t("documents").select("doc_id", (F.length("text") + 2).cast("bigint").alias("size"))
    return intervals.coverage_violations(spans, "doc_id", sizes)


_KIND = "CASE WHEN trim(line) = '' THEN 'whitespace' WHEN NOT regexp_matches(line, '[.!?]$') AND len(string_split(line, ' ')) <= 8 THEN 'heading' ELSE 'prose' END"


@query("coverage_by_kind", f"""
WITH {LINES}, k AS (SELECT lang, {_KIND} AS kind, size FROM l JOIN documents USING (doc_id))
SELECT lang, kind, sum(size)::BIGINT AS chars, count(*)::BIGINT AS spans FROM k GROUP BY GROUPING SETS ((lang, kind), (kind), ())""")
def coverage_by_kind(t):
    docs = t("documents")
    spans = segment.line_spans(docs).withColumn("kind", segment.span_kind(F.col("line"))).withColumn("size", F.col("end") - F.col("start"))
    rows = spans.join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupingSets([["lang", "kind"], ["kind"], []], "lang", "kind").agg(F.sum("size").alias("chars"), F.count("*").alias("spans"))


_WINDOWS = """
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS rn FROM l),
w AS (SELECT *, unnest(range(greatest(0, ceil((rn - 14) / 12.0))::BIGINT, (rn // 12)::BIGINT + 1)) AS win FROM n)"""


@query("extraction_windows", f"WITH {LINES}, {_WINDOWS} SELECT doc_id, win AS window_no, count(*)::BIGINT AS spans, min(line_no) AS first_line, max(line_no) AS last_line, sum(size)::BIGINT AS chars FROM w GROUP BY ALL")
def extraction_windows(t):
    w = segment.windows(segment.line_spans(t("documents")), "doc_id", "line_no")
    return w.groupBy("doc_id", F.col("window").alias("window_no")).agg(
        F.count("*").alias("spans"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.col("end") - F.col("start")).alias("chars")
    )


@query("window_neighbours", f"""
WITH {LINES}, {_WINDOWS}, e AS (SELECT doc_id, win, min(rn) AS lo, max(rn) AS hi FROM w GROUP BY ALL)
SELECT e.doc_id, win AS window_no, line_no FROM e JOIN n ON n.doc_id = e.doc_id AND ((rn BETWEEN lo - 2 AND lo - 1) OR (rn BETWEEN hi + 1 AND hi + 2))""")
def window_neighbours(t):
    spans = segment.line_spans(t("documents"))
    near = segment.neighbours(segment.windows(spans, "doc_id", "line_no"), spans, "doc_id", "line_no")
    return near.select("doc_id", F.col("window").alias("window_no"), "line_no")


@query("normalized_titles", f"""
WITH n AS (SELECT doc_id, {BIB} AS norm FROM documents)
SELECT doc_id, sha256(norm) AS norm_hash, array_to_string(list_filter(string_split(norm, ' '), lambda x: x NOT IN ('a','an','and','for','in','of','on','the','to','with')), ' ') AS title_key FROM n""")
def normalized_titles(t):
    return t("documents").select("doc_id", F.sha2(T.bibliographic(F.col("text")), 256).alias("norm_hash"), T.title_key(F.col("text")).alias("title_key"))


@query("slugs", "SELECT p_partkey, coalesce(nullif(substr(replace(trim(regexp_replace(replace(lower(coalesce(p_name || ' & ' || p_type, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 80), ''), 'item') AS slug FROM part")
def slugs(t):
    return t("part").select("p_partkey", T.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"))


_RAW = "CASE page_id % 4 WHEN 0 THEN 'https://doi.org/10.1234/' || page_id || '.' WHEN 1 THEN 'DOI: 10.55555/a' || chr(92) || '_' || page_id WHEN 2 THEN url ELSE '10.12/' || page_id END"


@query("clean_identifiers", f"""
WITH a AS (SELECT page_id, regexp_replace(lower(trim({_RAW})), '^(https?://(dx[.])?doi[.]org/|doi:[ ]*)', '') AS b FROM pages),
c AS (SELECT page_id, regexp_replace(replace(b, chr(92) || '_', '_'), '[.,;)]+$', '') AS d FROM a)
SELECT page_id, CASE WHEN regexp_matches(d, '^10[.][0-9]{{4,9}}/[^ \\t\\n\\r]+$') THEN d ELSE '' END AS doi FROM c""")
def clean_identifiers(t):
    m, bs = F.col("page_id") % 4, F.chr(F.lit(92))
    p = F.col("page_id").cast("string")
    raw = F.when(m == 0, F.concat(F.lit("https://doi.org/10.1234/"), p, F.lit("."))).when(m == 1, F.concat(F.lit("DOI: 10.55555/a"), bs, F.lit("_"), p)).when(m == 2, F.col("url")).otherwise(F.concat(F.lit("10.12/"), p))
    return t("pages").select("page_id", T.clean_doi(raw).alias("doi"))


@query("term_hits", f"WITH c AS (SELECT doc_id, {BIB} AS norm FROM documents) SELECT doc_id, ({_HITS})::BIGINT AS hits FROM c")
def term_hits(t):
    return t("documents").select("doc_id", T.term_hits(F.col("text"), TERMS).alias("hits"))


@query("token_counts", """
SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS words, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes,
       floor(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) * 1.2 * 4.0)::BIGINT AS token_estimate FROM documents""")
def token_counts(t):
    words = T.word_count(F.col("text"))
    return t("documents").select("doc_id", words.alias("words"), F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), T.token_estimate(words).alias("token_estimate"))


@query("bigram_vocab", f"""
WITH c AS (SELECT doc_id, list_filter(string_split({BIB}, ' '), lambda x: length(x) >= 4) AS w FROM documents),
p AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS z FROM c WHERE len(w) >= 2)
SELECT z[1] || ' ' || z[2] AS bigram, count(*)::BIGINT AS n FROM p GROUP BY 1 HAVING count(*) >= 4""")
def bigram_vocab(t):
    words = F.filter(F.split(T.bibliographic(F.col("text")), " "), lambda x: F.length(x) >= 4)
    rows = t("documents").select(words.alias("w")).select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).alias("bigram"))
    return rows.filter("bigram IS NOT NULL").groupBy("bigram").agg(F.count("*").alias("n")).filter("n >= 4")


@query("register_findings", """
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'See WP3 and WP7 in /home/me/x.tex. ' ELSE '' END || text AS s FROM documents)
SELECT doc_id, 'label' AS kind, len(regexp_extract_all(s, '\\bWP[0-6]\\b'))::BIGINT AS n FROM x WHERE regexp_matches(s, '\\bWP[0-6]\\b')
UNION ALL SELECT doc_id, 'path', len(regexp_extract_all(s, '/home/[A-Za-z0-9_./-]+'))::BIGINT FROM x WHERE regexp_matches(s, '/home/[A-Za-z0-9_./-]+')""")
def register_findings(t):
    """C-41 on texts with planted private labels and paths."""
    s = F.concat(F.when(F.col("doc_id") % 9 == 0, F.lit("See WP3 and WP7 in /home/me/x.tex. ")).otherwise(F.lit("")), F.col("text"))
    rows = t("documents").select("doc_id", s.alias("s"))
    counts = rows.select("doc_id", F.explode(F.array(
        F.struct(F.lit("label").alias("kind"), F.regexp_count("s", F.lit("\\bWP[0-6]\\b")).cast("bigint").alias("n")),
        F.struct(F.lit("path").alias("kind"), F.regexp_count("s", F.lit("/home/[A-Za-z0-9_./-]+")).cast("bigint").alias("n")),
    )).alias("f"))
    return counts.select("doc_id", "f.kind", "f.n").filter("n > 0")


@query("first_person_findings", """
SELECT conv_id, turn, strpos(lower(text), m) AS first_at, m AS marker FROM conversations CROSS JOIN (SELECT unnest(['we ', 'i ', 'our ']) AS m) WHERE strpos(lower(text), m) > 0""")
def first_person_findings(t):
    """C-42: the first place of each marker."""
    found = F.array(*[F.struct(F.lit(m).alias("marker"), F.instr(F.lower("text"), m).cast("bigint").alias("first_at")) for m in ("we ", "i ", "our ")])
    return t("conversations").select("conv_id", "turn", F.inline(found)).filter("first_at > 0")


@query("numeric_literals", """
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9][0-9,.{}\\\\]*[0-9]|[0-9])')) AS raw FROM documents)
SELECT doc_id, regexp_replace(raw, '[{},\\\\]', '', 'g') AS literal, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def numeric_literals(t):
    return t("documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("literal")).groupBy("doc_id", "literal").agg(F.count("*").alias("n"))


@query("citation_keys", f"""
WITH {MANUSCRIPTS}, c AS (SELECT doc_id, unnest(regexp_extract_all(revised, '\\\\cite[A-Za-z]*\\{{([^}}]*)\\}}', 1)) AS ks FROM ms)
SELECT DISTINCT doc_id, trim(unnest(string_split(ks, ','))) AS citation FROM c""")
def citation_keys(t):
    return manuscripts(t("documents")).select("doc_id", F.explode(T.citation_keys(F.col("revised"))).alias("citation"))


@query("label_keys", f"WITH {MANUSCRIPTS} SELECT doc_id, unnest(regexp_extract_all(revised, '\\\\label\\{{([^}}]*)\\}}', 1)) AS label FROM ms")
def label_keys(t):
    return manuscripts(t("documents")).select("doc_id", F.explode(T.label_keys(F.col("revised"))).alias("label"))


@query("section_ranges", f"""
WITH {LINES}, h AS (SELECT *, (line_no % 6 = 2) AS is_h FROM l),
s AS (SELECT *, greatest(sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, min(line_no) AS first_line, max(line_no) AS last_line FROM s GROUP BY ALL""")
def section_ranges(t):
    out = segment.section_ranges(segment.line_spans(t("documents")), "doc_id", F.col("line_no") % 6 == 2)
    return out.select("doc_id", F.col("section").cast("bigint").alias("section"), "first_line", "last_line")


@query("html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"'))::BIGINT AS links FROM pages")
def html_titles(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="([^"]*)"')).cast("bigint").alias("links"))


@query("html_links", """
WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages)
SELECT url, min(page_id) AS first_page, count(*)::BIGINT AS n FROM x GROUP BY url""")
def html_links(t):
    """S-09: each address once, with its first page."""
    rows = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("url"))
    return rows.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query("json_props", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(*) FILTER (WHERE props->>'k' IS NULL)::BIGINT AS missing FROM events GROUP BY event_type")
def json_props(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_if(k.isNull()).alias("missing"))


_TOKENS = f"""
{LINES},
tk AS (SELECT doc_id, line_no AS paragraph, unnest(regexp_extract_all(lower(line), '[a-z]{{3,}}')) AS term, generate_subscripts(regexp_extract_all(lower(line), '[a-z]{{3,}}'), 1) AS pos FROM l),
tok AS (SELECT doc_id, paragraph, term, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, pos) - 1 AS ofs FROM tk),
intro AS (SELECT doc_id, term, min(ofs) AS ofs, arg_min(paragraph, ofs) AS paragraph, count(*) AS uses FROM tok GROUP BY ALL)"""


def _words(t):
    lines = segment.line_spans(t("documents"))
    return lines.select("doc_id", F.col("line_no").alias("paragraph"), F.regexp_extract_all(F.lower("line"), F.lit("([a-z]{3,})"), F.lit(1)).alias("words"))


@query("first_use", f"WITH {_TOKENS} SELECT doc_id, count(*)::BIGINT AS terms, sum(ofs)::BIGINT AS ofs_sum, sum(paragraph)::BIGINT AS paragraph_sum, max(uses)::BIGINT AS max_uses FROM intro GROUP BY doc_id")
def first_use(t):
    first = metrics.introductions(metrics.placed_paragraphs(_words(t), "doc_id"), "doc_id")
    return first.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("offset").alias("ofs_sum"), F.sum("paragraph").alias("paragraph_sum"), F.max("uses").alias("max_uses"))


@query("pacing_metrics", f"""
WITH {_TOKENS},
ends AS (SELECT doc_id, paragraph, max(ofs) AS ofs FROM tok GROUP BY ALL),
per AS (SELECT doc_id, paragraph, count(*) AS n FROM intro GROUP BY ALL),
ev AS (SELECT doc_id, ofs, 1 AS i, 0 AS k FROM intro UNION ALL SELECT doc_id, ofs, 0, 1 FROM ends),
ld AS (SELECT *, sum(i) OVER (PARTITION BY doc_id ORDER BY ofs RANGE BETWEEN 1500 PRECEDING AND CURRENT ROW) AS load FROM ev),
lo AS (SELECT doc_id, avg(load) AS a, quantile_cont(load, 0.95) AS p FROM ld WHERE k = 1 GROUP BY doc_id),
su AS (SELECT doc_id, count(*) AS terms, sum(uses) AS words, count(*) FILTER (WHERE uses = 1) AS single, avg(uses) AS mu FROM intro GROUP BY doc_id),
bu AS (SELECT doc_id, count(*) AS ps, count(*) FILTER (WHERE n >= 3) AS bs, coalesce(max(n), 0) AS mb FROM ends LEFT JOIN per USING (doc_id, paragraph) GROUP BY doc_id)
SELECT doc_id, words::BIGINT AS words, terms::BIGINT AS terms, round(words / terms, 6) AS words_per_term, round(1000.0 * terms / words, 6)::DOUBLE AS intro_per_1000, round(single / terms, 6) AS singleton_share,
       round(mu, 6) AS mean_uses, round(bs / ps, 6) AS burst_share, mb::BIGINT AS max_burst, round(a, 6) AS load_mean, round(p, 6) AS load_p95 FROM su JOIN bu USING (doc_id) JOIN lo USING (doc_id)""")
def pacing_metrics(t):
    p = metrics.pacing(_words(t), "doc_id")
    return p.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in p.dtypes])


@query("exemplar_position", "WITH a AS (SELECT quantile_cont(n_chars, 0.5) AS m FROM documents) SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS median, min(n_chars) AS least, max(n_chars) AS greatest, round(quantile_cont(n_chars, 0.5) / any_value(m), 6) AS relative FROM documents, a GROUP BY lang")
def exemplar_position(t):
    p = metrics.exemplar_position(t("documents"), "lang", "n_chars")
    return p.select("lang", F.round("median", 6).alias("median"), "least", "greatest", F.round("relative", 6).alias("relative"))


@query("stable_hash_sample", """
WITH d AS (SELECT doc_id, doc_id % 97 = 0 AS known, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
k AS (SELECT count(*) AS c FROM d WHERE known)
SELECT doc_id FROM d WHERE known UNION ALL
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rn FROM d WHERE NOT known), k WHERE rn <= greatest(0, 200 - c)""")
def stable_hash_sample(t):
    """T-03: known items first, then by hash up to 200 (a sampling operator: the limit is its function)."""
    return gates.stable_sample(t("documents").select("doc_id"), "doc_id", F.col("doc_id") % 97 == 0, 200, "7")


@query("similarity_known_items", f"""
WITH a AS (SELECT item_id, list_distinct(list_filter(string_split({BIB}, ' '), lambda x: x <> '')) AS w FROM benchmark),
b AS (SELECT doc_id, list_distinct(list_filter(string_split({BIB}, ' '), lambda x: x <> '')) AS w FROM documents),
ax AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM a), bx AS (SELECT doc_id, len(w) AS m, unnest(w) AS t FROM b),
j AS (SELECT item_id, doc_id, count(*) / (any_value(n) + any_value(m) - count(*)) AS s FROM ax JOIN bx USING (t) GROUP BY ALL)
SELECT item_id, doc_id, round(s, 6) AS similarity FROM j WHERE s >= 0.3""")
def similarity_known_items(t):
    tokens = F.array_distinct(F.filter(F.split(T.bibliographic(F.col("text")), " "), lambda x: x != ""))
    found = matching.token_jaccard(t("benchmark").select("item_id", tokens.alias("tokens")), t("documents").select("doc_id", tokens.alias("tokens")), "item_id", "doc_id", 0.3)
    return found.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query("artifact_manifest", "SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def artifact_manifest(t):
    return t("documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
