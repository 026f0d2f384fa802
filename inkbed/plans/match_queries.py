"""Queries on versions, identities, reviews, budgets, patches and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import gates, intervals, matching, metrics, patching, segment
from inkbed.session import written
from inkbed.sources import latex

from .base import LINES, MANUSCRIPTS, manuscripts, query

_BS = "\\\\"


_OBJECT = "\\\\(?:cite|label)\\{[^}]*\\}"


def _objects(rows, column):
    """Citations and labels of a manuscript column with normal forms and places."""
    found = segment.matches(rows.select(F.col("doc_id").alias("key"), column), "key", column, _OBJECT)
    kind = F.when(F.col("raw").startswith("\\cite"), "citation").otherwise("label")
    normal = F.regexp_replace(F.regexp_extract("raw", "\\{([^}]*)\\}", 1), "[ \\t]+", "")
    return found.select("key", kind.alias("object_type"), normal.alias("normal"), "raw", "start")


_OBJ = f"""
{MANUSCRIPTS},
o AS (SELECT key, t, v, raw, row_number() OVER (PARTITION BY key, v, raw ORDER BY i) AS nth FROM (SELECT key, t, v, unnest(r) AS raw, unnest(range(len(r))) AS i FROM (
  SELECT doc_id AS key, t, v, regexp_extract_all(t, '{_BS}(?:cite|label)\\{{[^}}]*\\}}') AS r FROM (SELECT doc_id, tex AS t, 0 AS v FROM ms UNION ALL SELECT doc_id, revised, 1 FROM ms)))),
ab AS (SELECT key, v, CASE WHEN raw LIKE '%cite{{%' THEN 'citation' ELSE 'label' END AS ty, regexp_replace(regexp_extract(raw, '\\{{([^}}]*)\\}}', 1), '[ \\t]+', '', 'g') AS normal, raw,
  list_filter(range(1, length(t) + 1), lambda p: substr(t, p, length(raw)) = raw)[nth] - 1 AS start FROM o),
a AS (SELECT * FROM ab WHERE v = 0), b AS (SELECT * FROM ab WHERE v = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY key, ty, normal ORDER BY start) AS k FROM a),
y AS (SELECT *, row_number() OVER (PARTITION BY key, ty, normal ORDER BY start) AS k FROM b),
f AS (SELECT coalesce(x.key, y.key) AS key, coalesce(x.ty, y.ty) AS ty, x.raw AS ra, y.raw AS rb, x.start AS sa, y.start AS sb, coalesce(x.normal, y.normal) AS normal, coalesce(x.k, y.k) AS k
      FROM x FULL JOIN y ON x.key = y.key AND x.ty = y.ty AND x.normal = y.normal AND x.k = y.k),
old AS (SELECT key, ty, sa FROM f WHERE sb IS NULL), new AS (SELECT key, ty, sb FROM f WHERE sa IS NULL),
near AS (SELECT key, ty, sa, sb, row_number() OVER (PARTITION BY key, ty, sa ORDER BY abs(sa - sb), sb) AS r FROM old JOIN new USING (key, ty) WHERE abs(sa - sb) < 1000),
g AS (SELECT key, ty, sa, sb, true AS near FROM near WHERE r = 1 UNION ALL SELECT key, ty, sa, NULL, false FROM old WHERE (key, ty, sa) NOT IN (SELECT key, ty, sa FROM near)
  UNION ALL SELECT key, ty, NULL, sb, false FROM new WHERE (key, ty, sb) NOT IN (SELECT key, ty, sb FROM near WHERE r = 1)),
c AS (
  SELECT key, ty, sa, sb, CASE WHEN ra = rb THEN 'unchanged' ELSE 'explained_change' END AS status FROM f WHERE sa IS NOT NULL AND sb IS NOT NULL
  UNION ALL SELECT key, ty, sa, sb, 'substantive_change' FROM g WHERE near
  UNION ALL SELECT key, ty, sa, NULL, 'removed' FROM g WHERE NOT near AND sa IS NOT NULL
  UNION ALL SELECT key, ty, NULL, sb, 'added' FROM g WHERE NOT near AND sb IS NOT NULL
)"""


def _versions(t):
    m = manuscripts(t("documents"))
    return _objects(m, "tex"), _objects(m, "revised")


@query("exact_match_kth", f"WITH {_OBJ} SELECT key AS doc_id, ty AS object_type, normal, k::BIGINT AS k, sa::BIGINT AS a_start, sb::BIGINT AS b_start FROM f")
def exact_match_kth(t):
    a, b = _versions(t)
    out = matching.kth_match(a, b, ["key", "object_type", "normal"])
    return out.select(F.col("key").alias("doc_id"), "object_type", "normal", F.col("k").cast("bigint").alias("k"), "a_start", "b_start")


@query("correspondence_status", f"WITH {_OBJ} SELECT key AS doc_id, ty AS object_type, sa::BIGINT AS a_start, sb::BIGINT AS b_start, status FROM c")
def correspondence_status(t):
    return matching.correspondence(*_versions(t)).withColumnRenamed("key", "doc_id")


@query("resolved_correspondence", f"""
WITH {_OBJ} SELECT key AS doc_id, ty AS object_type, CASE WHEN status = 'substantive_change' THEN 'unresolved' ELSE status END AS status, CASE WHEN status = 'substantive_change' THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence, count(*)::BIGINT AS n FROM c GROUP BY ALL""")
def resolved_correspondence(t):
    """X-09: matches by place alone have a confidence of 0.7; under the least one asked for they are unresolved."""
    out = matching.resolved(matching.correspondence(*_versions(t)), 0.75)
    return out.groupBy(F.col("key").alias("doc_id"), "object_type", "status", "confidence").agg(F.count("*").alias("n"))


@query("retention_rate", f"""
WITH {_OBJ} SELECT ty AS object_type, count(sa)::BIGINT AS frozen, count(*) FILTER (WHERE status IN ('unchanged', 'explained_change'))::BIGINT AS preserved,
round(count(*) FILTER (WHERE status IN ('unchanged', 'explained_change')) / count(sa), 6) AS retention FROM c GROUP BY ty""")
def retention_rate(t):
    c = matching.correspondence(*_versions(t))
    kept = F.count_if(F.col("status").isin("unchanged", "explained_change"))
    out = c.groupBy("object_type").agg(F.count("a_start").alias("frozen"), kept.alias("preserved"))
    return out.withColumn("retention", F.round(metrics.ratio(F.col("preserved"), F.col("frozen"), 1.0), 6))


@query("preserved_missing_added", f"""
WITH {_OBJ}, p AS (SELECT DISTINCT key, ty, normal FROM a), q AS (SELECT DISTINCT key, ty, normal FROM b)
SELECT coalesce(p.key, q.key) AS doc_id, coalesce(p.ty, q.ty) AS object_type, coalesce(p.normal, q.normal) AS normal,
CASE WHEN p.key IS NULL THEN 'added' WHEN q.key IS NULL THEN 'missing' ELSE 'preserved' END AS status FROM p FULL JOIN q ON p.key = q.key AND p.ty = q.ty AND p.normal = q.normal""")
def preserved_missing_added(t):
    a, b = _versions(t)
    return gates.set_difference(a, b, ["key", "object_type", "normal"]).withColumnRenamed("key", "doc_id")


@query("mutation_replay", f"WITH {_OBJ} SELECT key AS doc_id, bool_or(status NOT IN ('unchanged', 'explained_change')) AS caught FROM c GROUP BY key")
def mutation_replay(t):
    """V-26: a mutation is caught if any object is changed, added or removed."""
    return matching.correspondence(*_versions(t)).groupBy(F.col("key").alias("doc_id")).agg(F.bool_or(~F.col("status").isin("unchanged", "explained_change")).alias("caught"))


@query("object_span_links", f"""
WITH {LINES}, o AS (SELECT doc_id, i, (i * 37) % 400 AS s FROM (SELECT doc_id, unnest(range(6)) AS i FROM documents)),
ob AS (SELECT doc_id, i AS object_id, s AS start, s + 25 AS "end" FROM o),
j AS (SELECT ob.doc_id, object_id, count(*) FILTER (WHERE l.start <= ob.start AND ob."end" <= l."end") AS held, min(l.start) FILTER (WHERE l.start <= ob.start AND ob."end" <= l."end") AS at
      FROM ob JOIN l ON ob.doc_id = l.doc_id AND ob.start < l."end" AND l.start < ob."end" GROUP BY ALL)
SELECT ob.doc_id, ob.object_id, CASE WHEN held = 1 THEN 'linked' WHEN held IS NOT NULL THEN 'straddling' ELSE 'unlocated' END AS status, CASE WHEN held = 1 THEN at END::BIGINT AS span_start
FROM ob LEFT JOIN j ON ob.doc_id = j.doc_id AND ob.object_id = j.object_id""".replace(" AS at\n", ' AS "at"\n').replace("THEN at END", 'THEN "at" END'))
def object_span_links(t):
    docs = t("documents")
    objects = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("object_id"))
    objects = objects.withColumn("start", F.col("object_id") * 37 % 400).withColumn("end", F.col("start") + 25)
    return intervals.object_links(objects, segment.line_spans(docs), "doc_id")


_ORDER_RANGES = "SELECT l_orderkey, l_linenumber, l_partkey, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + 5 + l_linenumber AS e FROM lineitem"


@query("overlapping_ranges", f"""
WITH r AS ({_ORDER_RANGES}), r2 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s) AS i FROM r)
SELECT a.l_orderkey, a.i::BIGINT AS a_id, b.i::BIGINT AS b_id, greatest(a.s, b.s)::BIGINT AS begin, least(a.e, b.e)::BIGINT AS finish FROM r2 a JOIN r2 b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND a.s < b.e AND b.s < a.e""")
def overlapping_ranges(t):
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "start")).cast("bigint")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("start"), (day + 5 + F.col("l_linenumber")).alias("end")).withColumn("a_id", number).transform(written)
    met = intervals.overlaps(rows, rows.withColumnRenamed("a_id", "b_id"), "l_orderkey", 30, "a_id", "b_id")
    return met.filter("a_id < b_id")


@query("gap_sessions", """
WITH e AS (SELECT user_id, ts, event_id, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY ALL""")
def gap_sessions(t):
    e = t("events").select("user_id", "event_id", "ts")
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    s = intervals.sessions(e, "user_id", ["ts", "event_id"], F.timestamp_diff("SECOND", before, F.col("ts")), 1800)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("unit_contiguity", f"""
WITH {LINES}, s AS (SELECT doc_id, start, "end" FROM l WHERE line_no % 3 <> 1),
g AS (SELECT doc_id, start, start - lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end") AS gap FROM s) SELECT doc_id, start, gap::BIGINT AS gap FROM g WHERE gap > 300""")
def unit_contiguity(t):
    return intervals.gaps(segment.line_spans(t("documents")).filter("line_no % 3 != 1"), "doc_id", 300)


@query("dedup_merge_candidates", """
WITH k AS (SELECT sha256(text) AS identity, * FROM documents)
SELECT identity, arg_min(nullif(lang, ''), doc_id) AS lang, arg_min(nullif(source, ''), doc_id) AS source, min(doc_id) AS first_seen, count(*)::BIGINT AS members FROM k GROUP BY identity""")
def dedup_merge_candidates(t):
    return matching.dedup_merge(t("documents"), F.sha2("text", 256), "doc_id", ["lang", "source"])


@query("reconcile_duplicates", """
WITH n AS (SELECT lower(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))) AS norm, conv_id * 1000 + turn AS seq, role, text FROM conversations),
g AS (SELECT norm, count(DISTINCT role) AS roles, count(*) AS c, min(seq) AS first_seq FROM n GROUP BY norm)
SELECT sha256(norm) AS norm_hash, first_seq, CASE WHEN roles <= 1 THEN c ELSE 1 END::BIGINT AS occurrence_count, roles::BIGINT AS roles FROM g""")
def reconcile_duplicates(t):
    """A-06: propositions of one role are merged, the first in order speaks for all."""
    norm = F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n]+", " ")))
    rows = t("conversations").select(norm.alias("norm"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role")
    g = rows.groupBy("norm").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("_c"), F.min("seq").alias("first_seq"))
    return g.select(F.sha2("norm", 256).alias("norm_hash"), "first_seq", F.when(F.col("roles") <= 1, F.col("_c")).otherwise(1).cast("bigint").alias("occurrence_count"), "roles")


@query("review_overlay", """
SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'unreviewed' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS decision,
coalesce(nullif(CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END, ''), lang) AS note, toxic = 1 IS TRUE AS changed FROM documents LEFT JOIN labels USING (doc_id)""".replace("toxic = 1 IS TRUE", "coalesce(toxic = 1, false)"))
def review_overlay(t):
    """J-17: filled review fields win over the base."""
    r = t("labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("note"), F.col("toxic"))
    rows = t("documents").join(r, "doc_id", "left")
    decision = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("quality") == 1, "accept").otherwise("reject")
    return rows.select("doc_id", "source", decision.alias("decision"), F.coalesce(F.nullif("note", F.lit("")), "lang").alias("note"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("changed"))


@query("critic_calibration", """
WITH r AS (SELECT lang, n_chars > 300 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn FROM r GROUP BY lang),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM m)
SELECT lang, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(f1, 6) AS f1, f1 >= 0.8 AND tp + fp + fn + tn >= 20 AS calibrated FROM f""")
def critic_calibration(t):
    rows = t("documents").join(t("labels"), "doc_id")
    c = metrics.calibration(rows, F.col("n_chars") > 300, F.col("quality") == 1, ["lang"])
    return c.select("lang", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "accuracy", "f1")], "calibrated")


@query("reader_scores", """
WITH s AS (SELECT source, doc_id % 2 AS v, unnest([quality, toxic + 1, quality * 3]) AS score, unnest(['clarity', 'tone', 'depth']) AS dim FROM documents JOIN labels USING (doc_id))
SELECT dim, coalesce(round(avg(CASE WHEN score > 0 AND v = 0 THEN score END), 6), 0) AS original, coalesce(round(avg(CASE WHEN score > 0 AND v = 1 THEN score END), 6), 0) AS revised,
       round(coalesce(avg(CASE WHEN score > 0 AND v = 1 THEN score END), 0) - coalesce(avg(CASE WHEN score > 0 AND v = 0 THEN score END), 0), 6) AS improvement, count(*) FILTER (WHERE score > 0)::BIGINT AS n FROM s GROUP BY dim""")
def reader_scores(t):
    """A-09 to A-11: means of scores over 0 by dimension and version, and what the revision gained."""
    rows = t("documents").join(t("labels"), "doc_id").select(
        (F.col("doc_id") % 2).alias("v"), F.inline(F.array(*[F.struct(F.lit(n).alias("dim"), x.cast("int").alias("score")) for n, x in (("clarity", F.col("quality")), ("tone", F.col("toxic") + 1), ("depth", F.col("quality") * 3))]))
    )
    mean = lambda v: F.coalesce(F.avg(F.when((F.col("score") > 0) & (F.col("v") == v), F.col("score"))), F.lit(0.0))
    return rows.groupBy("dim").agg(F.round(mean(0), 6).alias("original"), F.round(mean(1), 6).alias("revised"), F.round(mean(1) - mean(0), 6).alias("improvement"), F.count_if(F.col("score") > 0).alias("n"))


@query("running_budget", """
WITH r AS (SELECT conv_id, turn, length(text) AS tokens, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM conversations)
SELECT conv_id, turn, spent::BIGINT AS spent, spent > 1200 AS over, spent > 1200 AND spent - tokens <= 1200 AS crosses FROM r""")
def running_budget(t):
    rows = t("conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("tokens"))
    return metrics.running_budget(rows, ["conv_id"], ["turn"], F.col("tokens"), 1200).drop("tokens")


@query("budget_gate", "SELECT role, sum(length(text))::BIGINT AS tokens, sum(length(text)) <= 100000 AS within FROM conversations GROUP BY role")
def budget_gate(t):
    return t("conversations").groupBy("role").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("tokens")).withColumn("within", F.col("tokens") <= 100000)


@query("ledger_status", "SELECT event_type, user_id % 3 AS status, count(*)::BIGINT AS n FROM events GROUP BY ROLLUP (event_type, status)")
def ledger_status(t):
    return metrics.status_ledger(t("events").withColumn("status", F.col("user_id") % 3), "event_type", "status")


@query("latest_record", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_record(t):
    return gates.latest(t("events"), ["user_id", "event_type"], F.col("event_id"), ["event_id", "value"])


@query("oscillation", """
WITH s AS (SELECT conv_id, turn, length(text) % 5 AS sig FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sig ORDER BY turn) AS nth, lag(sig) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
SELECT conv_id, turn, sig::BIGINT AS sig, nth::BIGINT AS nth, nth > 1 AS seen_before, coalesce(b = sig, false) AS no_op FROM n""")
def oscillation(t):
    """W-15 to W-17 on a signature of each turn."""
    rows = t("conversations").select("conv_id", "turn", (F.length("text") % 5).cast("bigint").alias("sig"))
    return gates.repeats(rows, ["conv_id"], "turn", "sig")


@query("visual_gaps", """
WITH d AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT // 3600 AS page FROM events),
g AS (SELECT user_id, page, page - lag(page) OVER (PARTITION BY user_id ORDER BY page) AS gap FROM d)
SELECT user_id, count(*)::BIGINT AS pages, coalesce(max(gap), 0)::BIGINT AS largest_gap FROM g GROUP BY user_id""")
def visual_gaps(t):
    """A-18, W-20: the largest distance between distinct pages (hours)."""
    pages = t("events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("page")).distinct()
    gap = F.col("page") - F.lag("page").over(W.partitionBy("user_id").orderBy("page"))
    return pages.withColumn("gap", gap).groupBy("user_id").agg(F.count("*").alias("pages"), F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"))


_RI = (("orders", "o_custkey", "customer", "c_custkey", "o_orderkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "l_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id", "doc_id"))


def _found(t):
    found = [gates.missing_references(t(a), c, t(b).filter(F.col(d) % 50 != 7), d, f"{a}.{c}", k) for a, c, b, d, k in _RI]
    return found


_RI_SQL = " UNION ALL ".join(f"SELECT '{a}.{c}' AS \"check\", {k}::VARCHAR AS locator, '{c}=' || coalesce({c}::VARCHAR, 'null') AS reason FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {d} % 50 <> 7 AND {b}.{d} = {a}.{c})" for a, c, b, d, k in _RI)


@query("referential_integrity", _RI_SQL)
def referential_integrity(t):
    """J-06 to J-08 with planted holes in the targets."""
    out = _found(t)[0]
    for x in _found(t)[1:]:
        out = out.unionByName(x)
    return out


@query("gate_rollup", f"""
WITH v AS ({_RI_SQL}), q AS (SELECT unnest([{", ".join(f"'{a}.{c}'" for a, c, *_ in _RI)}, 'never.ran']) AS gate)
SELECT gate, count("check")::BIGINT AS n_violations, gate <> 'never.ran' AND count("check") = 0 AS passed FROM q LEFT JOIN v ON gate = "check" GROUP BY gate""")
def gate_rollup(t):
    names = [f"{a}.{c}" for a, c, *_ in _RI]
    ran = t("region").limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("check"))
    return gates.roll_up(_found(t), ran, [*names, "never.ran"])


@query("bidirectional_links", """
WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'preserved' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def bidirectional_links(t):
    return gates.set_difference(t("documents").filter("doc_id % 3 = 0"), t("labels"), ["doc_id"])


@query("duplicate_keys", """
SELECT 'documents.text' AS "check", sha256(text) AS locator, 'count=' || count(*) AS reason FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'part.p_name', p_name || '|' || p_brand, 'count=' || count(*) FROM part GROUP BY p_name, p_brand HAVING count(*) > 1""")
def duplicate_keys(t):
    a = gates.duplicate_keys(t("documents").select(F.sha2("text", 256).alias("h")), ["h"], "documents.text")
    return a.unionByName(gates.duplicate_keys(t("part"), ["p_name", "p_brand"], "part.p_name"))


@query("manifest_diff", """
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 4 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 5)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'unrecorded' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def manifest_diff(t):
    """U-05: a recorded manifest against the files that are there."""
    d = t("documents")
    a = d.filter("doc_id % 10 != 3").select("doc_id", F.sha2("text", 256).alias("_x"))
    b = d.filter("doc_id % 10 != 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("_y"))
    status = F.when(F.col("_x").isNull(), "unrecorded").when(F.col("_y").isNull(), "missing").when(F.col("_x") != F.col("_y"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").select("doc_id", status.alias("status"))


@query("rights_clearance", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') AND source IN ('src0', 'src1', 'src2', 'src3') THEN 'cleared' WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'needs_facts' ELSE 'not_allowed' END AS clearance FROM documents""")
def rights_clearance(t):
    """F-08, F-10: an allow list of scopes, and a fact that must be there."""
    scope = gates.allowed(F.col("source"), ("src0", "src1", "src2", "src3"))
    return t("documents").select("doc_id", F.when(scope & F.col("text").rlike("(?i)license"), "cleared").when(scope, "needs_facts").otherwise("not_allowed").alias("clearance"))


@query("document_checks", f"""
WITH {MANUSCRIPTS}, c AS (SELECT doc_id, unnest(['has_section', 'has_label', 'has_extra', 'no_todo']) AS name,
unnest([contains(revised, chr(92) || 'section'), contains(revised, chr(92) || 'label'), contains(revised, 'label{{extra}}'), NOT contains(revised, 'TODO')]) AS ok FROM ms)
SELECT name, count(*)::BIGINT AS n, count(*) FILTER (WHERE ok)::BIGINT AS passed FROM c GROUP BY name""")
def document_checks(t):
    """V-21: boolean checks of a text, one row for each."""
    m = manuscripts(t("documents"))
    checks = m.select("doc_id", F.contains("revised", F.lit("\\section")).alias("has_section"), F.contains("revised", F.lit("\\label")).alias("has_label"), F.contains("revised", F.lit("label{extra}")).alias("has_extra"), (~F.contains("revised", F.lit("TODO"))).alias("no_todo"))
    return checks.unpivot("doc_id", ["has_section", "has_label", "has_extra", "no_todo"], "name", "ok").groupBy("name").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


@query("patch_assemble", """
SELECT doc_id, sha256(CASE WHEN length(text) >= 40 THEN substr(text, 1, 5) || '<A>' || substr(text, 11, 10) || '' || substr(text, 31) ELSE text END) AS text_hash, CASE WHEN length(text) >= 40 THEN 1 ELSE 3 END::BIGINT AS failed FROM documents""")
def patch_assemble(t):
    """X-01, X-02: two good patches and one that isn't verbatim; all are out of bounds on short texts."""
    d = t("documents").select("doc_id", "text")
    row = lambda s, e, o, r: F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(e).cast("bigint").alias("end"), o.alias("original"), F.lit(r).alias("replacement"))
    far = F.when(F.length("text") >= 40, F.lit(0)).otherwise(F.lit(10_000_000))
    patches = d.select("doc_id", far.cast("bigint").alias("_f"), F.inline(F.array(row(5, 10, F.substring("text", 6, 5), "<A>"), row(20, 30, F.substring("text", 21, 10), ""), row(32, 36, F.lit("\u0001none"), "x"))))
    patches = patches.withColumn("start", F.col("start") + F.col("_f")).withColumn("end", F.col("end") + F.col("_f")).drop("_f")
    return patching.assemble(d, patches, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_hash"), "failed")


@query("untouched_chars", """
WITH r AS (SELECT doc_id, length(text) AS n, unnest([(doc_id * 7) % 50, (doc_id * 13) % 60]) AS s FROM documents), c AS (SELECT doc_id, n, s AS a, s + 20 AS b FROM r),
m AS (SELECT *, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS f FROM c)
SELECT doc_id, (any_value(n) - sum(f))::BIGINT AS untouched FROM m GROUP BY doc_id""")
def untouched_chars(t):
    d = t("documents")
    r = d.select("doc_id", F.explode(F.array(F.col("doc_id") * 7 % 50, F.col("doc_id") * 13 % 60)).alias("start")).withColumn("end", F.col("start") + 20)
    return intervals.merged_length(r, "doc_id").join(d, "doc_id").select("doc_id", (F.length("text") - F.col("covered")).cast("bigint").alias("untouched"))


@query("unique_replace", """
WITH n AS (SELECT doc_id, text, (length(text) - length(replace(text, 'tion.', ''))) // 5 AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'replaced' END AS status, sha256(CASE WHEN n = 1 THEN replace(text, 'tion.', 'TION!') ELSE text END) AS text_hash FROM n""")
def unique_replace(t):
    status, text = patching.unique_replace(F.col("text"), F.lit("tion."), F.lit("TION!"))
    return t("documents").select("doc_id", status.alias("status"), F.sha2(text, 256).alias("text_hash"))


@query("assemble_with_gaps", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN text END AS d FROM conversations)
SELECT conv_id, sha256(string_agg(coalesce(d, '% MISSING: ' || turn), chr(10) ORDER BY turn)) AS text_hash, count(*) FILTER (WHERE d IS NULL)::BIGINT AS missing FROM s GROUP BY conv_id""")
def assemble_with_gaps(t):
    c = t("conversations")
    out = patching.assemble_sections(c.select("conv_id", "turn"), c.filter("turn % 3 != 1").select("conv_id", "turn", F.col("text").alias("draft")), "conv_id", "turn")
    return out.select("conv_id", F.sha2("text", 256).alias("text_hash"), "missing")


@query("nearest_match")
def nearest_match(t):
    """J-13: clicks and views of one user, greedily one to one, nearer than ten minutes."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    e = t("events").select(F.col("user_id"), F.col("event_id").alias("id"), at.alias("at"), "event_type")
    return matching.nearest_greedy(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), ["user_id"], 600_000)


@query("added_sentences")
def added_sentences(t):
    """X-06: sentences of a turn that the turn two before lacks."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.lag("text", 2).over(w).alias("old"), F.col("text").alias("new"))
    return matching.added_sentences(rows.filter("old IS NOT NULL"))


@query("latex_partition", f"""
WITH {MANUSCRIPTS} SELECT doc_id, length(revised)::BIGINT AS chars, 0::BIGINT AS start, length(revised)::BIGINT AS "end", 0::BIGINT AS problems, 1::BIGINT AS headings, sha256(revised) AS joined FROM ms""")
def latex_partition(t):
    """G-01 to G-07, as the invariants of a tiling: no gap or overlap, and the regions spell the file."""
    parts = latex.partition(manuscripts(t("documents")), "doc_id", "revised")
    before = F.coalesce(F.lag("end").over(W.partitionBy("doc_id").orderBy("start")), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "region"))), lambda x: x["region"]), "")
    return parts.withColumn("_bad", (F.col("start") != before).cast("int")).groupBy("doc_id").agg(
        F.sum(F.length("region")).alias("chars"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_bad").alias("problems"),
        F.count_if(F.col("kind") == "heading").alias("headings"), F.sha2(joined, 256).alias("joined"),
    )


_PARTS = (
    ("heading", "\\section{D}"), ("whitespace", "\n\n"), ("prose", "{}"), ("whitespace", "\n\n"), ("float", "\\begin{verbatim}50% $x \\section{no}\\end{verbatim}"),
    ("whitespace", "\n"), ("comment", "% a $ note \\begin{equation}\n"), ("float", "\\begin{tabular}{c}\\begin{tabular}{c}y\\end{tabular}\\end{tabular}"), ("math", "$$z$$"), ("prose", " costs 5\\% or $5 and"), ("whitespace", "\n\n"),
    ("math", "\\begin{alignat*}{2}a&b\\end{alignat*}"), ("command", "\\begin{align}"), ("prose", " never ended"), ("whitespace", "\n\n"), ("heading", "\\subparagraph{E}"), ("bibliography", "\\begin{thebibliography}{9}x\\end{thebibliography}"),
)
_SQL_PARTS = ", ".join("{{'kind': '{}', 'part': {}}}".format(k, "src" if x == "{}" else "'" + x.replace("\n", "' || chr(10) || '") + "'") for k, x in _PARTS)


def _composed(t):
    parts = [F.concat(F.lit("s "), "source") if x == "{}" else F.lit(x) for _, x in _PARTS]
    return t("documents").select("doc_id", F.concat(*parts).alias("tex"))


@query("scanner_regions", f"""
WITH p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, [{_SQL_PARTS}] AS ps FROM (SELECT doc_id, 's ' || source AS src FROM documents)))
SELECT doc_id, p.kind AS kind, (sum(length(p.part)) OVER w - length(p.part))::BIGINT AS start, (sum(length(p.part)) OVER w)::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def scanner_regions(t):
    """G-01 to G-05: kinds and places of the regions of files that are composed of known parts."""
    return latex.partition(_composed(t)).select("doc_id", "kind", "start", "end")


@query("scanner_abstentions", "SELECT doc_id, c AS construct FROM documents, (SELECT unnest(['$', chr(92) || 'begin{align}']) AS c)")
def scanner_abstentions(t):
    """G-03: what the same files open and never close."""
    return latex.abstentions(_composed(t)).select("doc_id", "construct")


@query("object_manifest", f"""
WITH {MANUSCRIPTS}, o AS (SELECT doc_id, 'cite' AS k, chr(92) || 'cite{{' || s || '}}' AS raw, s AS normal FROM (SELECT doc_id, source AS s FROM documents) UNION ALL SELECT doc_id, 'label', chr(92) || 'label{{d' || doc_id || '}}', chr(92) || 'label{{d' || doc_id || '}}' FROM documents)
SELECT doc_id, CASE k WHEN 'cite' THEN 'citation' ELSE 'label' END AS object_type, normal, left(sha256(raw), 16) AS hash, CASE k WHEN 'cite' THEN 2 ELSE 1 END::BIGINT AS occurrences, count(*)::BIGINT AS n FROM o, (SELECT unnest([1, 2]) AS j) WHERE j = 1 OR k = 'cite' GROUP BY ALL""")
def object_manifest(t):
    """G-14, G-18: the manuscripts' protected objects."""
    found = latex.object_manifest(manuscripts(t("documents")).select("doc_id", "tex"))
    return found.groupBy("doc_id", "object_type", "normal", "hash", "occurrences").agg(F.count("*").alias("n"))


@query("parser_agreement", f"WITH {MANUSCRIPTS} SELECT 1.0::DOUBLE AS agreement")
def parser_agreement(t):
    """G-13: the scanner against regular expressions on citations and labels."""
    m = manuscripts(t("documents"))
    scanned = latex.protected_objects(m, "doc_id", "revised")
    return latex.agreement(scanned, _objects(m, "revised"))


@query("merged_objects", f"""
WITH {_OBJ} SELECT key AS doc_id, ty AS object_type, substr(sha256(trim(regexp_replace(raw, '[ \\t\\n\\r]+', ' ', 'g'))), 1, 16) AS hash, 'regex+scanner' AS parser_source, max(start)::BIGINT AS start FROM b GROUP BY ALL""")
def merged_objects(t):
    m = manuscripts(t("documents"))
    by_regex = _objects(m, "revised").withColumnRenamed("key", "doc_id").select("doc_id", "object_type", "raw", "start")
    by_scan = latex.protected_objects(m, "doc_id", "revised").select("doc_id", "object_type", "raw", "start")
    return latex.merge_parsers(by_scan, by_regex, "scanner", "regex").select("doc_id", "object_type", "hash", "parser_source", "start")
