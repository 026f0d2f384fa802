"""Queries on dependency graphs and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.operators import graph, segment
from inkbed.sources import records
from inkbed.streaming import events as E

from .base import query

_GRAPHS = 7


def _graph(t):
    """A forest: document n needs n div 2; nodes are dealt to graphs of their own."""
    d = t("documents").select("doc_id")
    nodes = d.select(F.lit(0).cast("bigint").alias("graph"), F.col("doc_id").alias("node"))
    edges = d.filter("doc_id > 0").select(F.lit(0).cast("bigint").alias("graph"), F.col("doc_id").alias("dependent"), F.floor(F.col("doc_id") / 2).alias("prerequisite"))
    return nodes, edges


@query("dependency_levels", """
WITH RECURSIVE lv(node, level) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT doc_id, level + 1 FROM documents JOIN lv ON doc_id // 2 = node AND doc_id > 0)
SELECT node, max(level)::BIGINT AS level FROM lv GROUP BY node""")
def dependency_levels(t):
    return graph.levels(*_graph(t)).select("node", "level")


_POS = "SELECT doc_id AS node, (doc_id * 7919) % 100003 AS position FROM documents"


@query("order_violations", f"""
WITH p AS ({_POS}) SELECT d.node AS dependent, q.node AS prerequisite, (q.position - d.position)::BIGINT AS distance FROM p d JOIN p q ON d.node > 0 AND q.node = d.node // 2 WHERE q.position >= d.position""")
def order_violations(t):
    nodes, edges = _graph(t)
    placed = nodes.withColumn("position", F.col("node") * 7919 % 100003)
    return graph.order_violations(edges, placed).select("dependent", "prerequisite", "distance")


@query("forward_refs", f"""
WITH p AS ({_POS}) SELECT count(*)::BIGINT AS refs, sum(q.position - d.position)::BIGINT AS total, max(q.position - d.position)::BIGINT AS farthest FROM p d JOIN p q ON d.node > 0 AND q.node = d.node // 2 WHERE q.position > d.position""")
def forward_refs(t):
    nodes, edges = _graph(t)
    placed = nodes.withColumn("position", F.col("node") * 7919 % 100003)
    return graph.order_violations(edges, placed, strict=True).agg(F.count("*").alias("refs"), F.sum("distance").alias("total"), F.max("distance").alias("farthest"))


@query("topological_order", "SELECT doc_id % 7 AS graph, doc_id AS node, (row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1)::BIGINT AS position FROM documents")
def topological_order(t):
    """N-03 on seven graphs of chains in ascending order, whose smallest-first order is known."""
    d = t("documents").select((F.col("doc_id") % _GRAPHS).alias("graph"), F.col("doc_id").alias("node"))
    return graph.topological_order(d, d.select("graph", F.col("node").alias("dependent"), (F.col("node") - _GRAPHS).alias("prerequisite")))


@query("cycles", """
SELECT doc_id % 7 AS graph, 0::BIGINT AS cycle, min(doc_id) || '->' || min(doc_id) + 7 || '->' || min(doc_id) + 14 || '->' || min(doc_id) AS path, 3::BIGINT AS length FROM documents GROUP BY 1""")
def cycles(t):
    """N-05: chains in which the three smallest nodes of each graph form a ring."""
    d = t("documents").select((F.col("doc_id") % _GRAPHS).alias("graph"), F.col("doc_id").alias("node"))
    ring = d.groupBy("graph").agg(F.min("node").alias("m")).select("graph", F.inline(F.array(*[F.struct((F.col("m") + a).alias("dependent"), (F.col("m") + b).alias("prerequisite")) for a, b in ((0, 7), (7, 14), (14, 0))])))
    least = d.groupBy("graph").agg(F.min("node").alias("m"))
    chain = d.join(least, "graph").filter("node > m + 14").select("graph", F.col("node").alias("dependent"), (F.col("node") - _GRAPHS).alias("prerequisite"))
    return graph.cycles(ring.unionByName(chain))


@query("span_components")
def span_components(t):
    """N-02: orders that share a part; all of lineitem.

    Closing all pairs in SQL would take the square of its orders, so there is none; tests compare it with brute force.
    """
    return graph.sharing(t("lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("item")))


@query("unit_binpack")
def unit_binpack(t):
    """N-09, A-19: lines of each document packed in order into units of an estimated 200 words."""
    lines = segment.line_spans(t("documents"))
    rows = lines.select(F.col("doc_id").cast("string").alias("grp"), F.col("line_no").alias("pos"), F.col("line_no").alias("item"), F.regexp_count("line", F.lit("[^ \\n]+")).cast("bigint").alias("words"))
    return graph.pack_units(rows, 200)


@query("html_list_items")
def html_list_items(t):
    return records.html_lists(t("pages"))


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(t):
    w = E.tumbling(_events(t))
    return w.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sliding", """
WITH s AS (SELECT unnest([0, 900, 1800, 2700]) AS back, floor(epoch(ts))::BIGINT // 900 * 900 AS q FROM events) SELECT q - back AS window_start, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def event_sliding(t):
    return E.sliding(_events(t)).select(F.unix_seconds("window.start").alias("window_start"), "n")


@query("event_session", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id, epoch_us(min(ts))::BIGINT AS started, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def event_session(t):
    return E.user_sessions(_events(t)).select("user_id", F.unix_micros("session_window.start").alias("started"), "n")
