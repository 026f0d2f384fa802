"""Queries on plans, registries, reviews and revisions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import planning, segment

from .base import LINES, MANUSCRIPTS, manuscripts, query


@query("finding_ids", "SELECT conv_id, turn, format('S-{:04d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS finding_id FROM conversations")
def finding_ids(t):
    return planning.numbered(t("conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "S-%04d", "finding_id")


@query("rewrite_context", """
WITH u AS (SELECT conv_id, turn AS unit FROM conversations WHERE turn % 2 = 1)
SELECT u.conv_id, unit, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn < unit), '')) AS before, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn = unit), '')) AS own,
sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn > unit), '')) AS after FROM u JOIN conversations c ON c.conv_id = u.conv_id AND turn BETWEEN unit - 2 AND unit + 2 GROUP BY ALL""")
def rewrite_context(t):
    c = t("conversations").withColumnRenamed("turn", "pos")
    out = planning.context(c.filter("pos % 2 = 1"), c, "conv_id")
    return out.select("conv_id", "unit", *[F.sha2(x, 256).alias(x) for x in ("before", "own", "after")])


@query("ambiguity_cases", """
WITH a AS (SELECT lang, doc_id AS item, 'low_quality' AS reason, 0 AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 0
UNION ALL SELECT lang, doc_id, 'toxic', 1 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT lang, doc_id, 'unlabelled', 2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT lang, item, reason, format('A-{:04d}', row_number() OVER (PARTITION BY lang ORDER BY s, item)) AS case_id FROM a""")
def ambiguity_cases(t):
    d, l = t("documents"), t("labels")
    both = d.join(l, "doc_id")
    return planning.ambiguity_cases([("low_quality", both.filter("quality = 0")), ("toxic", both.filter("toxic = 1")), ("unlabelled", d.join(l, "doc_id", "left_anti"))], "doc_id", "lang")


@query("default_obligations", """
WITH k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['state', 'exemplify'] WHEN 1 THEN ['state', 'support'] ELSE ['mention'] END AS o FROM documents) SELECT doc_id, unnest(o) AS obligation FROM k""")
def default_obligations(t):
    kind = F.element_at(F.array(F.lit("definition"), F.lit("claim"), F.lit("remark")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t("documents").select("doc_id", F.explode(planning.obligations(kind)).alias("obligation"))


@query("registry_merge", """
WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, NULL AS brand, 0 AS p FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'x' || p_partkey, p_brand, 1 FROM part WHERE p_partkey % 5 <> 0)
SELECT k AS p_partkey, arg_min(name, p) FILTER (WHERE name <> '') AS p_name, arg_min(brand, p) FILTER (WHERE brand <> '') AS p_brand, min(p)::BIGINT AS priority FROM s GROUP BY k""")
def registry_merge(t):
    p = t("part")
    a = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    b = p.filter("p_partkey % 5 != 0").select("p_partkey", F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("p_name"), "p_brand")
    return planning.merge_registry([a, b], "p_partkey", ["p_name", "p_brand"])


@query("adoption_best_match", """
SELECT o_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS r FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey WHERE r = 1""")
def adoption_best_match(t):
    best = planning.best_match(t("lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_linenumber"])
    return t("orders").join(best, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_extendedprice")


@query("split_tree_leaves")
def split_tree_leaves(t):
    """G-16, G-17: lines of documents over 1,500 characters, halved up to three times."""
    lines = segment.line_spans(t("documents")).withColumn("size", F.col("end") - F.col("start"))
    leaves = planning.split_leaves(lines, "doc_id", "line_no", "size", 1500)
    return leaves.groupBy("doc_id", "leaf").agg(F.count("*").alias("lines"), F.sum("size").alias("chars"))


def _includes(t):
    d = t("documents").select("doc_id")
    files = d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    inc = d.filter("doc_id > 3").select(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("string")).alias("path"), (F.col("doc_id") % 4).alias("place"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("target"))
    return files, inc


@query("include_expansion", """
WITH RECURSIVE r(path, depth, ordinal) AS (SELECT 1::BIGINT, 0::BIGINT, '' UNION ALL SELECT doc_id, depth + 1, ordinal || format('/{:06d}', doc_id % 4) FROM documents JOIN r ON doc_id // 4 = path AND doc_id > 3)
SELECT 'f' || path AS path, depth, ordinal FROM r""")
def include_expansion(t):
    """S-21 to S-23: file n includes 4 n to 4 n + 3, as far as these exist; all that file 1 leads to."""
    return planning.expand_includes(*_includes(t), "f1")


@query("expanded_text", """
WITH RECURSIVE r(n, o) AS (SELECT 1::BIGINT, '' UNION ALL SELECT doc_id, o || format('/{:06d}', (doc_id % 4) * 2 + 1) FROM documents JOIN r ON doc_id // 4 = n AND doc_id > 3),
p AS (SELECT o || format('/{:06d}', k * 2) AS o, CASE k WHEN 0 THEN 'b' || n || ' ' WHEN 4 THEN ' e' || n ELSE '+' END AS piece FROM r, (SELECT unnest(range(5)) AS k)),
m AS (SELECT o || format('/{:06d}', k * 2 + 1) AS o, chr(10) AS piece FROM r, (SELECT unnest(range(4)) AS k) WHERE n * 4 + k NOT IN (SELECT doc_id FROM documents))
SELECT 'f1' AS path, sha256(string_agg(piece, '' ORDER BY o)) AS text FROM (SELECT * FROM p UNION ALL SELECT * FROM m)""")
def expanded_text(t):
    """S-21, S-22: file n includes 4 n to 4 n + 3; those that don't exist become line breaks."""
    name = lambda k: F.concat(F.lit("\\input{f"), (F.col("doc_id") * 4 + k).cast("string"), F.lit("}"))
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("b"), n, F.lit(" "), name(0), F.lit("+"), name(1), F.lit("+"), name(2), F.lit("+"), name(3), F.lit(" e"), n)
    files = t("documents").select(F.concat(F.lit("f"), n).alias("path"), text.alias("text"))
    return planning.expand_text(files, "f1").select("path", F.sha2("text", 256).alias("text"))


@query("file_census", """
WITH e AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*/([^/?]*)', 1) AS top FROM pages),
c AS (SELECT host, top, count(*) AS n FROM e GROUP BY host, top), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, top) AS r FROM c) SELECT host, top, n::BIGINT AS n FROM r WHERE r <= 5""")
def file_census(t):
    """S-24: counts, and the five commonest of each group (a top-k report)."""
    e = t("pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]*/([^/?]*)", 1).alias("top"))
    counts = e.groupBy("host", "top").agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "top"))).filter("_r <= 5").drop("_r")


@query("revision_checks", f"""
WITH {MANUSCRIPTS}, c AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(tex, '[0-9]+'))) AS a, list_sort(list_distinct(regexp_extract_all(revised, '[0-9]+'))) AS b FROM ms)
SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS dropped_numbers, len(list_filter(b, lambda x: NOT list_contains(a, x)))::BIGINT AS new_numbers FROM c""")
def revision_checks(t):
    """U-07: numbers that a revision drops or brings."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)))
    m = manuscripts(t("documents")).select("doc_id", found("tex").alias("a"), found("revised").alias("b"))
    return m.select("doc_id", F.size(F.array_except("a", "b")).cast("bigint").alias("dropped_numbers"), F.size(F.array_except("b", "a")).cast("bigint").alias("new_numbers"))


@query("mutation_safety", """
WITH b AS (SELECT doc_id AS unit, (doc_id + i) % 50 AS concept FROM documents, (SELECT unnest([0, 1, 2]) AS i)), a AS (SELECT doc_id AS unit, (doc_id + i) % 55 AS concept FROM documents, (SELECT unnest([0, 2, 9]) AS i)),
base AS (SELECT DISTINCT concept FROM b)
SELECT DISTINCT unit, concept, 'deletion' AS problem FROM b WHERE (unit, concept) NOT IN (SELECT unit, concept FROM a)
UNION ALL SELECT DISTINCT unit, concept, 'addition' FROM a WHERE (unit, concept) NOT IN (SELECT unit, concept FROM b) AND concept NOT IN (SELECT concept FROM base)""")
def mutation_safety(t):
    d = t("documents")
    pairs = lambda steps, m: d.select(F.col("doc_id").alias("unit"), F.explode(F.array(*[(F.col("doc_id") + i) % m for i in steps])).alias("concept")).distinct()
    before, after = pairs((0, 1, 2), 50), pairs((0, 2, 9), 55)
    return planning.mutation_safety(d.select(F.col("doc_id").alias("unit")), before, after, before.select("concept").distinct())


@query("assertions", f"""
WITH {LINES}, s AS (SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '[.!?]$')) SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE NOT regexp_matches(line, 'https?://|10[.][0-9]{{4}}|@'))::BIGINT AS uncited FROM s GROUP BY doc_id""")
def assertions(t):
    """C-44: lines that end as sentences, and those without address, DOI or mail."""
    lines = segment.line_spans(t("documents")).filter(F.col("line").rlike("[.!?]$"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("line").rlike("https?://|10[.][0-9]{4}|@")).alias("uncited"))


@query("bibliography_links", f"""
WITH {MANUSCRIPTS}, c AS (SELECT DISTINCT trim(unnest(regexp_extract_all(revised, '\\\\cite[A-Za-z]*\\{{([^}}]*)\\}}', 1))) AS k FROM ms), b AS (SELECT DISTINCT source AS k FROM documents UNION SELECT 'never')
SELECT coalesce(c.k, b.k) AS citation, CASE WHEN b.k IS NULL THEN 'undefined' WHEN c.k IS NULL THEN 'uncited' ELSE 'linked' END AS status FROM c FULL JOIN b ON c.k = b.k""")
def bibliography_links(t):
    """U-06: citations against the bibliography, both ways."""
    d = t("documents")
    cited = manuscripts(d).select(F.explode(T.citation_keys(F.col("revised"))).alias("citation")).distinct().withColumn("_c", F.lit(True))
    known = d.select(F.col("source").alias("citation")).distinct().unionByName(d.sparkSession.createDataFrame([("never",)], "citation string")).withColumn("_k", F.lit(True))
    status = F.when(F.col("_k").isNull(), "undefined").when(F.col("_c").isNull(), "uncited").otherwise("linked")
    return cited.join(known, "citation", "full").select("citation", status.alias("status"))
