"""Dependency graphs: edges, levels, order checks, exact topological order, cycles, components, greedy packing.

Edges are (graph, dependent, prerequisite).  A graph may be of any size: what depends on the order of choices (the smallest ready node
first, a depth-first walk) runs for one component at a time in a worker; everything else is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkbed.session import ensure_checkpoints, written

from .ordered import running
from .scc import strong_components

#: The most links that a worker takes at once.
MOST_LINKS = 1_000_000

#: Rows of a slice that a worker packs.
SLICE_ROWS = 200_000


def array_edges(concepts: DataFrame, graph: str, node: str, prerequisites: str) -> DataFrame:
    """N-01: one edge for each prerequisite."""
    return concepts.select(F.col(graph).alias("graph"), F.col(node).alias("dependent"), F.explode(prerequisites).alias("prerequisite"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest distance of each node from one without prerequisites; nodes on cycles, and all that need them, are left out.

    Prerequisites that can't be reached from such a node don't count.  Rounds of joins until one adds nothing; nodes and
    edges must be cheap to read again.
    """
    ensure_checkpoints(nodes.sparkSession)
    edges = edges.select("graph", "dependent", "prerequisite").distinct().checkpoint()  # read in each round
    roots = nodes.select("graph", "node").distinct().join(edges.select("graph", F.col("dependent").alias("node")).distinct(), ["graph", "node"], "left_anti").checkpoint()
    found, left = _peeled(roots, edges)
    if left.isEmpty():
        return found
    reached = current = roots
    while not current.isEmpty():
        following = edges.join(current.withColumnRenamed("node", "prerequisite"), ["graph", "prerequisite"]).select("graph", F.col("dependent").alias("node")).distinct()
        current = following.join(reached, ["graph", "node"], "left_anti").checkpoint()
        reached = reached.unionByName(current).checkpoint()
    counted = edges.join(reached.withColumnRenamed("node", "prerequisite"), ["graph", "prerequisite"], "left_semi").checkpoint()
    return _peeled(roots, counted)[0]


def _peeled(roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, edges that are left): a node gets the round in which the last of its edges goes; on cycles none does."""
    current = roots.withColumn("level", F.lit(0).cast("bigint"))
    found, depth = current, 0
    while True:
        depth += 1
        waiting = edges.join(current.select("graph", F.col("node").alias("prerequisite")), ["graph", "prerequisite"], "left_anti").checkpoint()
        nodes = lambda rows: rows.select("graph", F.col("dependent").alias("node")).distinct()
        current = nodes(edges).join(nodes(waiting), ["graph", "node"], "left_anti").withColumn("level", F.lit(depth).cast("bigint")).checkpoint()
        edges = waiting
        if current.isEmpty():
            return found, edges
        found = found.unionByName(current)
        if depth % 16 == 0:  # a short plan, however deep the graph is
            found = found.checkpoint()


def order_violations(edges: DataFrame, positions: DataFrame, strict: bool = False) -> DataFrame:
    """N-07, N-08: edges whose prerequisite is placed at or after (strict: after) its dependent, with the distance."""
    dep = positions.select("graph", F.col("node").alias("dependent"), F.col("position").alias("_d"))
    pre = positions.select("graph", F.col("node").alias("prerequisite"), F.col("position").alias("_p"))
    met = edges.join(dep, ["graph", "dependent"]).join(pre, ["graph", "prerequisite"])
    wrong = F.col("_p") > F.col("_d") if strict else F.col("_p") >= F.col("_d")
    return met.filter(wrong).select("graph", "dependent", "prerequisite", (F.col("_p") - F.col("_d")).alias("distance"))


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N-03: position of each node, the smallest ready one first; a graph with a cycle has none; edges to unknown nodes don't count.

    Weak components are ordered alone, each by a heap.  A heap over all of them is a merge of their orders, which always takes the least
    head; a node that stands behind a greater one of its component follows that one at once.  So the whole order is that of the
    running maximum in the component, and positions are ranks in one distributed sort.  No task has more than a component.
    """
    import pandas as pd

    def order(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        import heapq

        needs = dict.fromkeys(n["node"].tolist(), 0)
        gives: dict = {x: [] for x in needs}
        for d, p in zip(e["dependent"].tolist(), e["prerequisite"].tolist(), strict=True):
            needs[d] += 1
            gives[p].append(d)
        ready = [x for x, k in needs.items() if not k]
        heapq.heapify(ready)
        out, peak = [], None
        while ready:
            x = heapq.heappop(ready)
            peak = x if peak is None else max(peak, x)
            out.append((key[0], x, peak, len(out)))
            for d in gives[x]:
                needs[d] -= 1
                if not needs[d]:
                    heapq.heappush(ready, d)
        if len(out) < len(needs):
            out = [(key[0], None, None, None)]
        return pd.DataFrame(out, columns=["graph", "node", "peak", "at"]).astype({"node": "Int64", "peak": "Int64", "at": "Int64"})

    known = nodes.select("graph", "node").filter("graph IS NOT NULL AND node IS NOT NULL").distinct().transform(written)
    ends = lambda c: known.select("graph", F.col("node").alias(c))
    met = edges.select("graph", "dependent", "prerequisite").distinct().join(ends("dependent"), ["graph", "dependent"], "left_semi").join(ends("prerequisite"), ["graph", "prerequisite"], "left_semi").transform(written)
    pair = lambda c: F.struct(F.col("graph"), F.col(c).alias("node"))
    labels = label_components(met.select(pair("dependent").alias("a"), pair("prerequisite").alias("b")))
    linked = labels.select("node.graph", "node.node", F.col("component.node").alias("component")).transform(written)
    own = met.join(linked.select("graph", F.col("node").alias("dependent"), "component"), ["graph", "dependent"]).transform(written)
    placed = linked.groupBy("graph", "component").cogroup(own.groupBy("graph", "component")).applyInPandas(order, "graph bigint, node bigint, peak bigint, at bigint").transform(written)
    alone = known.join(linked, ["graph", "node"], "left_anti").select("graph", "node", F.col("node").alias("peak"), F.lit(0).cast("bigint").alias("at"))
    cyclic = placed.filter("node IS NULL").select("graph").distinct()
    rows = placed.filter("node IS NOT NULL").unionByName(alone).join(cyclic, "graph", "left_anti")
    return running(rows, ["graph"], ["peak", "at"], {"position": F.lit(1)}).select("graph", "node", (F.col("position") - 1).alias("position"))


def cycles(edges: DataFrame) -> DataFrame:
    """N-04, N-05: one cycle for each back edge of a depth-first walk from the least node with sorted children, each set of nodes once.

    Every cycle lies in one strongly connected component, so components are walked alone, one after the other in sorted rows; no task holds more
    than a component.  (A walk over the whole graph may enter a component by another node and then names its cycles from there.)
    """
    import pandas as pd

    def walk(graph: int, gives: dict) -> list[tuple]:
        for x in gives.values():
            x.sort()
        root = min(gives)
        done, seen, out = set(), set(), []
        path, at, stack = [root], {root: 0}, [iter(gives[root])]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                last = path.pop()
                del at[last]
                done.add(last)
            elif child in at:
                loop = path[at[child] :]
                if frozenset(loop) not in seen:
                    seen.add(frozenset(loop))
                    out.append((graph, root, len(out), "->".join(map(str, [*loop, child])), len(loop)))
            elif child not in done:
                path.append(child)
                at[child] = len(path) - 1
                stack.append(iter(gives[child]))
        return out

    def walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = lambda rows: pd.DataFrame(rows, columns=["graph", "least", "k", "path", "length"])
        at, gives, out = None, {}, []
        for f in frames:
            for g, x, d, p in zip(*(f[c].tolist() for c in ("graph", "_x", "dependent", "prerequisite")), strict=True):
                if (g, x) != at:
                    if gives:
                        out += walk(at[0], gives)
                    at, gives = (g, x), {}
                gives.setdefault(d, []).append(p)
            yield listed(out)
            out = []
        if gives:
            yield listed(walk(at[0], gives))

    rows = edges.select("graph", "dependent", "prerequisite").filter("graph IS NOT NULL AND dependent IS NOT NULL AND prerequisite IS NOT NULL").distinct().transform(written)
    name = lambda c: F.concat_ws(":", F.col("graph").cast("string"), F.col(c).cast("string"))
    tied = strong_components(rows.select(name("dependent").alias("a"), name("prerequisite").alias("b")), "a", "b")
    own = rows.withColumns({"_d": name("dependent"), "_p": name("prerequisite")})
    part = lambda c, as_: tied.select(F.col("node").alias(c), F.col("component").alias(as_))
    inside = own.join(part("_d", "_x"), "_d").join(part("_p", "_y"), "_p").filter("_x = _y").select("graph", "_x", "dependent", "prerequisite")
    loops = rows.filter("dependent = prerequisite").join(inside.select("graph", "dependent").distinct(), ["graph", "dependent"], "left_anti")
    found = inside.unionByName(loops.select("graph", name("dependent").alias("_x"), "dependent", "prerequisite")).repartition("graph", "_x").sortWithinPartitions("graph", "_x")
    found = found.mapInPandas(walks, "graph bigint, least bigint, k bigint, path string, length bigint")
    return running(found, ["graph"], ["least", "k"], {"cycle": F.lit(1)}).select("graph", (F.col("cycle") - 1).alias("cycle"), "path", "length")


def cyclic_nodes(edges: DataFrame, source: str, target: str) -> DataFrame:
    """N-06: node: what is on a cycle: a member of a strongly connected component of two nodes or more, or with an edge to itself."""
    loops = edges.filter(F.col(source) == F.col(target)).select(F.col(source).alias("node"))
    return strong_components(edges, source, target).select("node").unionByName(loops).distinct()


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one of its component among the links (a, b): roots hook to the least neighbour, then all jump."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not (label[label] == label).all():
            label = label[label]


def label_components(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """N-02: node and component (least node) of undirected links (a, b); fields of structs aren't null, links with a null don't count.

    Workers take ranges of the links, ``most`` at a time, and name the least node of each component in them.  Nodes that several workers name
    link what they are named by; those links are the next level, until one worker takes all of them.  Where a level leaves more than half of
    the links, their ends are far from each other in the order of nodes, and the next level comes by hooks (``_hooked``).
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").transform(written)
    return _labelled(links, links.count(), most)


def sharing(pairs: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """N-02: node and component (least node) of nodes that share items; pairs: node, item (whole numbers), those with a null don't count.

    Nodes and items are one graph, from which nodes go first: workers read neighbouring nodes with all their items, ``most`` pairs at a time, name the
    least node (lead) and item (root) of each component in them, and link its items to the root.  Only items are left to be labelled.  If few of their
    links are left, ranges of nodes were nearly components; if many, ids are scattered, ranges of items are no better, and hooks come first.
    """
    import pyarrow as pa

    def named(node: np.ndarray, item: np.ndarray, begun: tuple[int, int] | None, ended: bool) -> pa.RecordBatch:
        if begun:
            node, item = np.append(begun[0], node), np.append(begun[1], item)
        new = np.append(True, node[1:] != node[:-1])
        nodes, place = node[new], np.cumsum(new) - 1
        items, code = np.unique(item, return_inverse=True)
        label = _stars(code, place + len(items), len(items) + len(nodes))
        of = label[len(items) :]
        least = np.empty(len(items), dtype=np.int64)
        least[of[::-1]] = nodes[::-1]  # the last one that is put counts
        upto = len(nodes) if ended else len(nodes) - 1  # the last node may go on
        far = np.flatnonzero(label[: len(items)] != np.arange(len(items)))
        lead = pa.array(np.append(least[of[:upto]], np.zeros(len(far), dtype=np.int64)), mask=np.arange(upto + len(far)) >= upto)
        return pa.RecordBatch.from_arrays([pa.array(np.append(nodes[:upto], items[far])), lead, pa.array(np.append(items[of[:upto]], items[label[far]]))], names=["node", "lead", "root"])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, begun = [], 0, None
        joined = lambda: [np.concatenate([x.column(i).to_numpy() for x in kept]) for i in (0, 1)]
        for batch in batches:
            if rows >= most:
                node, item = joined()
                yield named(node, item, begun, False)
                kept, rows, begun = [], 0, (node[-1], item[-1])
            if batch.num_rows:
                kept.append(batch)
                rows += batch.num_rows
        if rows:
            yield named(*joined(), begun, True)

    pairs = pairs.select(F.col("node").cast("bigint"), F.col("item").cast("bigint")).filter("node IS NOT NULL AND item IS NOT NULL")
    n = pairs.count()
    dealt = pairs.repartitionByRange(_parts(n, most), "node").sortWithinPartitions("node")
    found = dealt.mapInArrow(shrink, "node bigint, lead bigint, root bigint").transform(written)
    links = found.filter("lead IS NULL").select(F.col("node").alias("a"), F.col("root").alias("b"))
    m = links.count()
    labels = _labelled(links, m, most, 4 * m <= n).select(F.col("node").alias("root"), "component")
    leads = found.filter("lead = node").select("lead", "root").join(labels, "root", "left").select("lead", F.coalesce("component", "root").alias("_part")).transform(written)
    least = leads.groupBy("_part").agg(F.min("lead").alias("component"))
    return found.filter("lead IS NOT NULL").select("node", "lead").join(leads.join(least, "_part").select("lead", "component"), "lead").select("node", "component")


def _parts(n: int, most: int) -> int:
    """Partitions of n rows that mostly stay under ``most``."""
    return 5 * n // (4 * most) + 1


def _labelled(links: DataFrame, n: int, most: int, near: bool = True) -> DataFrame:
    """The same for n links that can be read again; near: ranges may be worth a try."""
    if n > most and not near:
        return _hooked(links, most)
    if n <= most:
        return _named(links.repartition(1), most).toDF("node", "component").transform(written)
    stars = _named(links.repartitionByRange(_parts(n, most), "a"), most).toDF("node", "root")
    hubs = stars.withColumn("hub", F.min("root").over(W.partitionBy("node"))).transform(written)
    above = hubs.filter("root != hub").select(F.col("hub").alias("a"), F.col("root").alias("b")).distinct().transform(written)
    m = above.count()
    first = hubs.select("node", "hub").distinct()
    upper = _labelled(above, m, most, 2 * m <= n).select(F.col("node").alias("hub"), "component")
    return first.join(upper, "hub", "left").select("node", F.coalesce("component", "hub").alias("component")).transform(written)


def _named(links: DataFrame, most: int) -> DataFrame:
    """The nodes (u) of links that a worker reads together, ``most`` at a time, and the least node of their component in these links (r); structs by fields."""
    import pandas as pd

    kind = links.schema["a"].dataType
    fields = [f.name for f in kind.fields] if isinstance(kind, StructType) else None
    flat = lambda c: [F.col(f"{c}.{f}").alias(f"{c}{i}") for i, f in enumerate(fields)] if fields else [F.col(c).alias(f"{c}0")]
    size = len(fields or "a")
    kinds = [f.dataType.simpleString() for f in kind.fields] if fields else [kind.simpleString()]

    def named(frame: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([frame[[f"{c}{i}" for i in range(size)]].set_axis(range(size), axis=1) for c in "ab"], ignore_index=True)
        codes, known = pd.factorize(both[0], sort=True)
        for i in range(1, size):
            more, values = pd.factorize(both[i], sort=True)
            codes, known = pd.factorize(codes * len(values) + more, sort=True)
        at = np.empty(len(known), dtype=np.int64)
        at[codes] = np.arange(len(codes))
        label = _stars(codes[: len(frame)], codes[len(frame) :], len(known))
        own, root = both.iloc[at].reset_index(drop=True), both.iloc[at[label]].reset_index(drop=True)
        return pd.concat([own, root], axis=1).set_axis([f"{c}{i}" for c in "ur" for i in range(size)], axis=1)

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = [], 0
        for f in frames:
            kept.append(f)
            rows += len(f)
            if rows >= most:
                yield named(pd.concat(kept, ignore_index=True))
                kept, rows = [], 0
        if rows:
            yield named(pd.concat(kept, ignore_index=True))

    schema = ", ".join(f"{c}{i} {k}" for c in "ur" for i, k in enumerate(kinds))
    whole = lambda c: F.struct(*(F.col(f"{c}{i}").alias(f) for i, f in enumerate(fields))) if fields else F.col(f"{c}0")
    return links.select(*flat("a"), *flat("b")).mapInPandas(shrink, schema).select(whole("u").alias("u"), whole("r").alias("r"))


def _hooked(links: DataFrame, most: int) -> DataFrame:
    """The same for links between different nodes, wherever they are: each node that has a lesser neighbour hooks the least of them, and jumps until all
    hooks reach nodes without one; what then links those, shrunk by workers, is the next level.  Every link loses an end, or goes."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    up = links.groupBy("a").agg(F.min("b").alias("up")).transform(written)
    moved = True
    while moved:
        after = up.join(up.select(F.col("a").alias("up"), F.col("up").alias("_next")), "up", "left").select("a", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")).transform(written)
        moved, up = not after.filter("_moved").isEmpty(), after.select("a", "up")
    met = links.join(up.select("a", F.col("up").alias("_a")), "a").filter("_a != b")  # else b is the root itself, which may have very many links
    met = met.join(up.select(F.col("a").alias("b"), F.col("up").alias("_b")), "b", "left")
    met = met.select(F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a != b")
    left = _named(met, most).toDF("a", "b").filter("a != b").transform(written)
    tops = up.select(F.col("up").alias("node")).distinct().join(_labelled(left, left.count(), most), "node", "full").select("node", F.coalesce("component", "node").alias("component")).transform(written)
    hung = up.join(tops.select(F.col("node").alias("up"), "component"), "up").select(F.col("a").alias("node"), "component")
    return tops.unionByName(hung).transform(written)


def _breaks(words: np.ndarray, reach: int) -> list[tuple[int, int, int, bool]]:
    """What a slice of a group's items does to a unit that is open before it, by the words in that unit: (least, left, units, stays).

    The row of the greatest ``least`` that isn't over those words counts: ``units`` begin in the slice and the last one has ``left`` words at its end; where
    the unit ``stays``, it has ``left`` words more.  An item begins a unit if the open one has words and would have more than ``reach`` with it.
    """
    upto = np.cumsum(words)
    before, n = upto - words, len(words)
    past = lambda v: np.searchsorted(upto, v, side="right")
    following = np.maximum(past(before + reach), past(before) + 1).tolist()
    left, units = (upto[-1] - before).tolist(), [1] * n
    for j in range(n - 1, -1, -1):
        if following[j] < n:
            left[j], units[j] = left[following[j]], units[following[j]] + 1
    found: list[tuple[int, int, int, bool]] = []
    last = min(int(past(reach - 1)), n - 1)  # the farthest item that is the first to begin a unit, for an open one with a word
    for i, least in enumerate(np.maximum(reach - upto[: last + 1] + 1, 1).tolist()):
        row = (least, left[i], units[i], False)
        if found and (found[-1][0] == least or found[-1][1:] == row[1:]):
            row = (least, *found[-1][1:])
            found.pop()
        found.append(row)
    if found[-1][0] > 1 or upto[-1] < reach:
        found = [r for r in found if r[0] > reach - upto[-1]]
        found.append((1, int(upto[-1]), 0, True))
    i = max(int(past(reach)), int(past(0)) + 1)  # without a word the open unit takes the next item, however long
    return [*found, (0, left[i], units[i], False) if i < n else (0, int(upto[-1]), 0, True)]


def pack_units(rows: DataFrame, most: float, size: int = SLICE_ROWS) -> DataFrame:
    """N-09, A-19: units in order; a unit closes when the next item would take its estimate (words * 1.5) over ``most``.

    rows: grp, pos, item, words (whole numbers, none negative; null is 0); adds unit.  Rows are dealt to slices of some ``size`` by ranges of their order.
    What a slice does to a unit that is open before it depends only on the words in that unit, of which few lead to different ends (units soon begin at
    the same items, wherever the first one began).  So workers list that for the slices of groups that have several, the lists of a group are read in
    order, a row for each slice and end, and then each slice is packed alone.  The work is linear, in a fixed number of shuffles, for a group of any size.
    """
    import pandas as pd
    import pyarrow as pa

    reach = (2 * (int(most) + 1) - 1) // 3  # the most words whose estimate isn't over
    order = ["grp", "pos", "item", "_w"]
    known = rows.select("grp", "pos", "item", "words", F.coalesce("words", F.lit(0)).cast("bigint").alias("_w")).transform(written)
    dealt = known.repartitionByRange(max(1, -(-known.count() // size)), *order).withColumn("_slice", F.spark_partition_id()).transform(written)
    spread = dealt.groupBy("grp").agg(F.min("_slice").alias("_first"), F.max("_slice").alias("_final")).filter("_first < _final").withColumnRenamed("grp", "_grp").transform(written)

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = lambda at, parts: [(*at, *r) for r in _breaks(np.concatenate(parts), reach)]
        at, parts = None, []
        for f in frames:
            out = []
            for key, part in f.groupby(["_first", "_slice"], sort=False):
                if key != at:
                    if parts:
                        out += listed(at, parts)
                    at, parts = key, []
                parts.append(part["_w"].to_numpy())
            yield pd.DataFrame(out, columns=["_first", "_slice", "least", "left", "units", "stays"])
        if parts:
            yield pd.DataFrame(listed(at, parts), columns=["_first", "_slice", "least", "left", "units", "stays"])

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_words, unit, best = (None, None), 0, 0, None
        for f in frames:
            out = []
            for first, part, least, left, units, stays in zip(*(f[c].tolist() for c in f.columns), strict=True):
                if (first, part) != at:
                    if first != at[0]:
                        open_words, unit = 0, 0
                    else:
                        open_words, unit = best[0] + (open_words if best[2] else 0), unit + best[1]
                        out.append((part, open_words, unit))
                    at = (first, part)
                if least <= open_words:
                    best = (left, units, stays)
            yield pd.DataFrame(out, columns=["_in", "_open", "_unit"])

    held = dealt.join(spread, F.col("grp").eqNullSafe(F.col("_grp"))).select("_first", "_slice", "pos", "item", "_w")
    ends = held.repartition("_slice").sortWithinPartitions("_slice", "_first", "pos", "item", "_w").select("_first", "_slice", "_w")
    ends = ends.mapInPandas(lists, "_first int, _slice int, least bigint, left bigint, units bigint, stays boolean")
    entries = ends.repartition("_first").sortWithinPartitions("_first", "_slice", "least").mapInPandas(entered, "_in int, _open bigint, _unit bigint").transform(written)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, unit = None, 0, 0
        for batch in batches:
            column = lambda c: batch.column(c)  # noqa: B023, E731
            begins, opened, numbered, out = column("_open").is_valid().to_pylist(), column("_open"), column("_unit"), []
            for i, (part, new, w) in enumerate(zip(column("_slice").to_pylist(), column("_new").to_pylist(), column("_w").to_pylist(), strict=True)):
                if part != at:
                    at = part
                    words, unit = (opened[i].as_py(), numbered[i].as_py()) if begins[i] else (0, 0)
                elif new:
                    words, unit = 0, 0
                if words and words + w > reach:
                    words, unit = w, unit + 1
                else:
                    words += w
                out.append(unit)
            yield pa.RecordBatch.from_arrays([column("grp"), pa.array(out, pa.int64()), column("pos"), column("item"), column("words")], names=["grp", "unit", "pos", "item", "words"])

    before = F.lag("grp").over(W.partitionBy("_slice").orderBy(*order))
    placed = dealt.join(entries, F.col("_slice") == F.col("_in"), "left").withColumn("_new", ~F.col("grp").eqNullSafe(before))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField(c, LongType() if c == "unit" else kinds[c]) for c in ("grp", "unit", "pos", "item", "words")])
    return placed.select("grp", "pos", "item", "words", "_w", "_slice", "_new", "_open", "_unit").mapInArrow(pack, schema)
