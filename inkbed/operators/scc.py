"""Strongly connected components of a directed graph of any size.

Each level deals the nodes to blocks by ranges of their order, of some ``most`` edges.  A worker shrinks a block: its own components become
one node each, and a node that no edge to another block touches goes where that adds no edge (what leads to it leads on to what it leads
to), which keeps what reaches what.  The graph that is left goes to the next level, in fewer blocks, until one block holds it all; then
the blocks are opened again, where nodes of one component further up are one.  Each edge is shuffled a fixed number of times a level.

Where a level takes less than a quarter of the edges away (nodes without any order that the edges follow), the rest is cut up by colours: a
node's colour is the least of the nodes that reach it, in a random order that changes by the round, and no component has two colours.
Colours travel along edges and jump (the colour of one's colour reaches one, too).  Of a colour with more than ``most`` edges the nodes
that reach its first node are a component, and the rest goes on; what a colour's own backward colours tell apart is cut, too, so that the
expected number of rounds is logarithmic.  Colours of fewer edges are finished by workers, each alone.  Nothing but numbers of edges and
whether something is left reaches the driver; no table of nodes, edges or colours is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbed.session import written

#: The most edges that one worker takes: of a colour, and on average of a block.
MOST_EDGES = 50_000

#: A block with more edges inside, times ``most``, isn't shrunk at this level.
WIDEST = 20

#: A node with more neighbours stays, so that taking nodes out takes linear time.
BUSIEST = 64


def _met(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles.  Tables of nodes, edges or colours grow with the graph, and a broadcast goes through the driver, one more in each round."""
    return rows.join(other.hint("merge"), on, how)


def _colours(edges: DataFrame, source: str, target: str, seed: int) -> DataFrame:
    """u and colour (struct of hash and node): the first of the nodes that reach u by edges, u included."""
    nodes = edges.select(F.col(source).alias("u")).unionByName(edges.select(F.col(target).alias("u"))).distinct()
    colours = nodes.select("u", F.struct(F.xxhash64(F.lit(seed), "u").alias("h"), F.col("u").alias("n")).alias("colour")).transform(written)
    while True:
        near = _met(edges, colours.withColumnRenamed("u", source), source).groupBy(F.col(target).alias("u")).agg(F.min("colour").alias("_near"))
        own = _met(colours, near, "u", "left").select("u", F.col("colour").alias("_old"), F.least("colour", "_near").alias("colour"))
        jump = colours.select(F.col("u").alias("_n"), F.col("colour").alias("_next"))
        after = _met(own, jump, F.col("colour.n") == F.col("_n")).select("u", "_old", F.least("colour", "_next").alias("colour")).transform(written)
        colours = after.select("u", "colour")
        if after.filter("colour != _old").isEmpty():
            return colours


def _owners(n: int, gives: list[list[int]]) -> list[int]:
    """For each of n nodes the least node of its component, by one walk with a stack of open nodes."""
    number, low, owner, place, opened, count = [-1] * n, [0] * n, [-1] * n, [0] * n, [], 0

    def enter(x: int) -> None:
        nonlocal count
        number[x] = low[x] = count
        place[x] = len(opened)
        count += 1
        opened.append(x)

    for root in range(n):
        if number[root] >= 0:
            continue
        enter(root)
        walk = [(root, iter(gives[root]))]
        while walk:
            x, rest = walk[-1]
            for y in rest:
                if number[y] < 0:
                    enter(y)
                    walk.append((y, iter(gives[y])))
                    break
                if owner[y] < 0:
                    low[x] = min(low[x], number[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[x])
                if low[x] == number[x]:
                    members = opened[place[x] :]
                    del opened[place[x] :]
                    least = min(members)
                    for y in members:
                        owner[y] = least
    return owner


def _coded(*columns: pd.Series) -> tuple[list[np.ndarray], pd.Index]:
    """Columns of nodes as places in the sorted list of their nodes, and that list."""
    codes, names = pd.factorize(pd.concat(columns, ignore_index=True), sort=True)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), names


def _listed(n: int, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    gives: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        gives[x].append(y)
    return gives


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    """Components of more than one node among the edges (a, b) of a colour."""
    (a, b), names = _coded(frame["a"], frame["b"])
    owner = _owners(len(names), _listed(len(names), a, b))
    sizes = pd.Series(owner).value_counts()
    rows = [(names[x], names[owner[x]]) for x in range(len(names)) if sizes[owner[x]] > 1]
    return pd.DataFrame(rows, columns=["node", "component"])


def _shrunk(edges: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) that are left of a block, and (a, null, a's node in them) for the nodes on its border."""
    (a, b, edge), names = _coded(edges["a"], edges["b"], border["a"])
    n = len(names)
    owner = _owners(n, _listed(n, a, b))
    outer = {owner[x] for x in edge.tolist()}
    gives: dict[int, set[int]] = {}
    comes: dict[int, set[int]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = owner[x], owner[y]
        if x != y:
            gives.setdefault(x, set()).add(y)
            comes.setdefault(y, set()).add(x)
    todo = [x for x in set(gives) | set(comes) if x not in outer]
    while todo:
        x = todo.pop()
        if x not in gives and x not in comes:
            continue
        into, out = comes.get(x, ()), gives.get(x, ())
        if into and out and (len(into) * len(out) > len(into) + len(out) or len(into) + len(out) > BUSIEST):
            continue
        comes.pop(x, None)
        gives.pop(x, None)
        for u in into:
            gives[u].discard(x)
            gives[u] |= out if out else set()
        for v in out:
            comes[v].discard(x)
            comes[v] |= into if into else set()
        todo += [y for y in (*into, *out) if y not in outer]
    rows = [(names[x], names[y], None) for x, ys in gives.items() for y in ys]
    rows += [(names[x], None, names[owner[x]]) for x in set(edge.tolist())]
    return pd.DataFrame(rows, columns=["a", "b", "own"], dtype=object)


def _opened(edges: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """Components of more than one node of a block, where nodes with one mark are in one; what has a mark keeps it as its component."""
    (a, b, marked), names = _coded(edges["a"], edges["b"], marks["a"])
    tied = pd.DataFrame({"x": marked, "c": marks["component"].to_numpy()}).sort_values(["c", "x"], kind="stable")
    x, c = tied["x"].to_numpy(), tied["c"].to_numpy()
    first = np.ones(len(x), bool)
    first[1:] = c[1:] != c[:-1]
    # a ring through the nodes of each mark: to the next one, and from the last one to the first
    start = np.flatnonzero(first)
    following = np.arange(1, len(x) + 1)
    following[np.append(start[1:], len(x))[: len(start)] - 1] = start
    n = len(names)
    owner = np.array(_owners(n, _listed(n, np.concatenate([a, x]), np.concatenate([b, x[following]]))), dtype=np.int64)
    sizes = np.bincount(owner, minlength=n)
    mark = dict(zip(owner[x].tolist(), c, strict=True))
    rows = [(names[y], mark[o] if o in mark else names[o]) for y, o in enumerate(owner.tolist()) if o in mark or sizes[o] > 1]
    return pd.DataFrame(rows, columns=["node", "component"], dtype=object)


def strong_components(edges: DataFrame, source: str, target: str, most: int = MOST_EDGES) -> DataFrame:
    """node and component (its least node) of the components of two nodes and more; edges from or to null and loops don't count.

    Nodes are numbers or strings.  An empty graph has none.
    """
    a, b = F.col(source), F.col(target)
    left = edges.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct().transform(written)
    found = _by_blocks(left, left.count(), most)
    least = found.groupBy("component").agg(F.min("node").alias("_least"))
    return _met(found, least, "component").select("node", F.col("_least").alias("component"))


def _by_blocks(left: DataFrame, n: int, most: int) -> DataFrame:
    """node and component (any of its nodes) of distinct edges (a, b)."""
    kind = left.schema["a"].dataType.simpleString()
    if n <= most:
        return left.withColumn("_c", F.lit(0)).groupBy("_c").applyInPandas(_finish, f"node {kind}, component {kind}").transform(written)
    nodes = left.select("a").unionByName(left.select(F.col("b").alias("a"))).distinct()
    block = nodes.repartitionByRange(-(-n // most), "a").select("a", F.spark_partition_id().alias("block")).transform(written)
    dealt = _met(_met(left, block.withColumnRenamed("block", "_a"), "a"), block.select(F.col("a").alias("b"), F.col("block").alias("_b")), "b").transform(written)
    sizes = dealt.filter("_a = _b").groupBy("_a").agg(F.count("*").alias("_n"))
    wide = sizes.filter(F.col("_n") > WIDEST * most).select("_a")
    inside = dealt.filter("_a = _b").join(wide, "_a", "left_anti").select(F.col("_a").alias("block"), "a", "b").transform(written)
    crossing = dealt.filter("_a != _b").unionByName(dealt.filter("_a = _b").join(wide, "_a", "left_semi").select(*dealt.columns)).transform(written)
    border = crossing.select("a", F.col("_a").alias("block")).unionByName(crossing.select(F.col("b").alias("a"), F.col("_b").alias("block"))).distinct().transform(written)
    shrunk = inside.groupBy("block").cogroup(border.groupBy("block")).applyInPandas(_shrunk, f"a {kind}, b {kind}, own {kind}").transform(written)
    own = shrunk.filter("own IS NOT NULL").select("a", "own")
    part = lambda c: own.select(F.col("a").alias(c), F.col("own").alias(f"_o{c}"))
    mapped = _met(_met(crossing.select("a", "b"), part("a"), "a"), part("b"), "b").select(F.col("_oa").alias("a"), F.col("_ob").alias("b")).filter("a != b").distinct()
    above = mapped.unionByName(shrunk.filter("b IS NOT NULL").select("a", "b")).transform(written)
    m = above.count()
    upper = _by_blocks(above, m, most) if 4 * m <= 3 * n else _by_colours(above, most)
    marks = _met(_met(own, upper.select(F.col("node").alias("own"), "component"), "own"), block, "a").select("block", "a", "component")
    return inside.groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(_opened, f"node {kind}, component {kind}").transform(written)


def _by_colours(left: DataFrame, most: int) -> DataFrame:
    """The same by colours, for edges that no order of the nodes keeps together."""
    node = left.schema["a"].dataType
    found, seed = None, 0
    put = lambda rows: rows if found is None else found.unionByName(rows)
    while not left.isEmpty():
        # what nothing leads to, or leads nowhere, is on no cycle
        for _ in range(2):
            left = _met(_met(left, left.select(F.col("b").alias("a")).distinct(), "a", "left_semi"), left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        left = left.transform(written)
        forward = _colours(left, "a", "b", seed)
        one = lambda c, key: c.select(F.col("u").alias(key), F.col("colour").alias(f"_{key}"))
        inside = _met(_met(left, one(forward, "a"), "a"), one(forward, "b"), "b").filter("_a = _b").select("a", "b", F.col("_a").alias("_c")).transform(written)
        # at most one for each ``most`` edges; joined by shuffles, all edges of a wide colour would be one task's
        wide = F.broadcast(inside.groupBy("_c").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_c"))
        small = inside.join(wide, "_c", "left_anti").select("_c", "a", "b")
        done = small.groupBy("_c").applyInPandas(_finish, f"node {node.simpleString()}, component {node.simpleString()}")
        found = put(done.transform(written))
        large = inside.join(wide, "_c").select("a", "b", "_c").transform(written)
        seed += 1
        if large.isEmpty():
            break
        # the same backwards inside of a colour: what reaches its first node is that node's component
        backward = _colours(large.select("a", "b"), "b", "a", seed - 1)
        both = _met(forward.withColumnRenamed("colour", "_f"), backward.withColumnRenamed("colour", "_g"), "u").transform(written)
        own = both.filter("_f = _g").groupBy("_f").agg(F.min("u").alias("component"), F.count("*").alias("_n")).filter("_n > 1")
        found = put(both.filter("_f = _g").join(own, "_f").select(F.col("u").alias("node"), "component").transform(written))
        rest = both.filter("_f != _g")
        key = lambda k: rest.select(F.col("u").alias(k), F.struct("_f", "_g").alias(f"_{k}"))
        left = _met(_met(large, key("a"), "a"), key("b"), "b").filter("_a = _b").select("a", "b").transform(written)
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
