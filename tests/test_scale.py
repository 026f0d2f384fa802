"""Groups of any size: ranks, quantiles, components, orders, packing, ranges, hash trees, by brute force."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from inkbed.operators import bundles, graph, intervals, merkle, metrics, ordered, release, responses, reviews, scc
from inkbed.plans import registry
from inkbed.session import new_folder
from inkbed.sources import records


def test_quantiles_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(50)])) for _ in range(2000)] + [("c", None), ("d", 4)] + [("a", 7)] * 900
    df = spark.createDataFrame(rows, "g string, v bigint")
    points = {"least": 0.0, "m": 0.5, "p": 0.95, "most": 1.0}
    got = {r.g: tuple(r)[1:] for r in ordered.quantiles(df, ["g"], "v", points).collect()}
    want = {r.g: tuple(r)[1:] for r in df.filter("v IS NOT NULL").groupBy("g").agg(*(F.percentile("v", F.lit(q)) for q in points.values())).collect()}
    assert set(got) == {"a", "b", None, "d"} and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ordered.quantiles(df, [], "v", {"m": 0.5}).first().m == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert ordered.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0 and ordered.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    found = ordered.running(df.withColumn("i", F.monotonically_increasing_id()), ["g"], ["v", "i"], {"at": F.lit(1)}, {"all": "at"}).collect()
    for g in ("a", None):
        own = sorted((r.at, -1 if r.v is None else r.v, r["all"]) for r in found if r.g == g)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {len(own)}
    odd = {r.g: (r.median, r.least) for r in metrics.exemplar_position(df, "g", "v").collect()}
    assert odd["c"] == (None, None) and odd["d"] == (4, 4) and set(odd) == {"a", "b", "c", "d", None}


def reach(edges):
    gives = {}
    for a, b in edges:
        gives.setdefault(a, set()).add(b)
    out = {}
    for x in {n for e in edges for n in e}:
        out[x], left = set(), list(gives.get(x, ()))
        while left:
            y = left.pop()
            if y not in out[x]:
                out[x].add(y)
                left += gives.get(y, ())
    return out


@pytest.mark.parametrize("most", [scc.MOST_EDGES, 3])
def test_strong_components(spark, most):
    """Random graphs and a chain of rings, finished by workers or by colours alone."""
    rng = random.Random(most)
    n = 60 if most > 3 else 20
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 3 // 2)]
    for k in range(8 if most > 3 else 2):
        o = 100 + 10 * k
        edges += [(o, o + 1), (o + 1, o + 2), (o + 2, o), (o + 1, o + 5), (o + 5, o + 10)]
    met = reach(edges)
    want = {x: min(y for y in met[x] if x in met[y]) for x in met if any(y != x and x in met[y] for y in met[x])}
    rows = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "a bigint, b bigint")
    got = scc.strong_components(rows, "a", "b", most).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    on = {x for x in met if x in met[x]}
    if most > 3:
        assert {r.node for r in graph.cyclic_nodes(rows, "a", "b").collect()} == on
        named = scc.strong_components(rows.select(F.col("a").cast("string"), F.col("b").cast("string")), "a", "b").collect()
        assert {int(r.node) for r in named} == set(want)
        assert scc.strong_components(rows.limit(0), "a", "b").count() == 0


def test_long_ring_by_colours(spark):
    """Forty nodes in one ring, in random order, without a worker that sees it whole."""
    ids = list(range(40))
    random.Random(4).shuffle(ids)
    rows = scc.strong_components(spark.createDataFrame(list(zip(ids, ids[1:] + ids[:1], strict=True)), "a bigint, b bigint"), "a", "b", 10).collect()
    assert len(rows) == 40 and {r.component for r in rows} == {0}


def smallest_first(nodes, edges):
    needs = dict.fromkeys(nodes, 0)
    gives = {n: [] for n in nodes}
    for d, p in set(edges):
        if d in needs and p in needs:
            needs[d] += 1
            gives[p].append(d)
    ready, out = [n for n, k in needs.items() if not k], []
    heapq.heapify(ready)
    while ready:
        x = heapq.heappop(ready)
        out.append(x)
        for d in gives[x]:
            needs[d] -= 1
            if not needs[d]:
                heapq.heappush(ready, d)
    return out if len(out) == len(needs) else []


def test_order_of_many_components(spark):
    rng = random.Random(9)
    ids = rng.sample(range(1000), 120)
    edges = [(0, ids[j], ids[i]) for c in range(0, 120, 6) for i in range(c, c + 6) for j in range(i + 1, c + 6) if rng.random() < 0.4] + [(0, ids[0], 5000), (0, 6000, ids[1])]
    edges += [(1, 3, 4), (1, 4, 3), (2, 1, 2)]
    nodes = [(0, n) for n in ids] + [(1, n) for n in range(6)] + [(2, n) for n in range(3)] + [(0, ids[3])]
    got = graph.topological_order(spark.createDataFrame(nodes, "graph bigint, node bigint"), spark.createDataFrame([*edges, edges[0]], "graph bigint, dependent bigint, prerequisite bigint")).collect()
    for g in (0, 1, 2):
        want = smallest_first({n for h, n in nodes if h == g}, [(d, p) for h, d, p in edges if h == g])
        assert [r.node for r in sorted(got, key=lambda r: r.position) if r.graph == g] == want
        assert sorted(r.position for r in got if r.graph == g) == list(range(len(want)))


def test_cycles_by_component(spark):
    edges = [(0, 5, 1), (0, 1, 2), (0, 2, 5), (0, 2, 1), (0, 5, 7), (0, 7, 8), (0, 8, 7), (0, 9, 9), (0, 0, 5), (1, 5, 1), (1, 1, 5), (0, None, 1)]
    got = {(r.graph, r.cycle): (r.path, r.length) for r in graph.cycles(spark.createDataFrame(edges, "graph bigint, dependent bigint, prerequisite bigint")).collect()}
    assert got == {(0, 0): ("1->2->1", 2), (0, 1): ("1->2->5->1", 3), (0, 2): ("7->8->7", 2), (0, 3): ("9->9", 1), (1, 0): ("1->5->1", 2)}


def packed(items, most):
    unit, words, out = 0, 0, []
    for pos, w in items:
        w = w or 0
        if words and int((words + w) * 1.5) > most:
            unit, words = unit + 1, 0
        words += w
        out.append((unit, pos))
    return out


@pytest.mark.parametrize("most", [10, 7.5, 400_000])
def test_packing_by_pointers(spark, most):
    rng = random.Random(int(most))
    large = 1 if most < 1000 else 40_000
    data = {g: [(p, rng.choice([0, 0, None, 1, 2, 3, 9, 30]) and rng.choice([1, 2, 3, 9, 30]) * large) for p in range(n)] for g, n in (("x", 150), ("y", 1), (None, 80), ("z", 40))}
    data["z"] = [(p, 0) for p, _ in data["z"]]
    rows = [(g, p, p, w) for g, items in data.items() for p, w in items]
    got = graph.pack_units(spark.createDataFrame(rows, "grp string, pos bigint, item bigint, words bigint"), most).collect()
    assert sorted(map(str, ((r.grp, r.unit, r.pos) for r in got))) == sorted(str((g, u, p)) for g, items in data.items() for u, p in packed(items, most))


def test_whole_binpack_equals_the_loop(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    items = [((i, n), len(re.findall("[^ \n]+", line))) for i, text in rows for n, line in enumerate((text or "").split("\n"))]
    units = {}
    for (unit, (doc, _)), (_, w) in zip(packed(items, 1500), items, strict=True):
        n, words, first, last = units.get(unit, (0, 0, doc, doc))
        units[unit] = (n + 1, words + w, min(first, doc), max(last, doc))
    got = registry.QUERIES["whole_binpack"](spark, sf_dir).collect()
    assert {r.unit: (r.lines, r.words, r.first_doc, r.last_doc) for r in got} == units


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_overlaps_of_long_ranges(spark, width):
    rng = random.Random(width)
    a, b = ([(rng.choice("kl"), i, (s := rng.randrange(300)), s + rng.choice(sizes)) for i in range(120)] for sizes in ([0, 1, 5, 90, 7000], [0, 1, 3, 40, 900]))
    x, y = spark.createDataFrame(a, "k string, i bigint, start bigint, end bigint"), spark.createDataFrame(b, "k string, j bigint, start bigint, end bigint")
    got = sorted(map(tuple, intervals.overlaps(x, y, "k", width, "i", "j").collect()))
    assert got == sorted((p[0], p[1], q[1], max(p[2], q[2]), min(p[3], q[3])) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3])
    assert intervals.overlaps(x.limit(0), y, "k", width, "i", "j").count() == 0


def test_rows_of_a_long_range(spark):
    """A range of a million cells is at most two nodes a level, not a row for each cell."""
    cells = intervals._in_cells(spark.createDataFrame([(3, 1_000_003)], "start bigint, end bigint"), 1)
    levels = intervals._deepest(cells)
    row = cells.select(intervals.cover(levels).alias("c"), intervals.above(levels).alias("a")).first()
    assert len(row.c) <= 2 * (levels + 1) and len(row.a) <= 2 * (levels + 1)
    assert sorted(x for n in row.c for x in (n["at"] << n["level"], (n["at"] + 1) << n["level"]))[0] == 3
    assert sum(1 << n["level"] for n in row.c) == 1_000_000


def test_tree_diff_reads_a_part(spark):
    rows = [(i, f"text {i}", None if i % 3 else "") for i in range(20_000)]
    one = spark.createDataFrame(rows, "id bigint, a string, b string")
    two = spark.createDataFrame([(i, a, "" if i == 77 else b) for i, a, b in rows if i != 500] + [(None, "x", None), (90_000, None, None)], "id bigint, a string, b string")
    depth = merkle.depth_for(20_000)
    paths = [new_folder(spark, "test-tree") for _ in range(3)]
    for df, path in zip((one, two, one.repartition(3)), paths, strict=True):
        merkle.write(df, "id", ["id", "a", "b"], path, depth)
    assert merkle.root(spark, paths[0]) == merkle.root(spark, paths[2]) != merkle.root(spark, paths[1])
    found = merkle.diff(spark, *paths[:2], depth)
    assert {(r.key, r.change) for r in found.collect()} == {("77", "changed"), ("500", "removed"), ("90000", "added"), (None, "added")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = {m for x in re.findall(r"PartitionFilters: \[folder#\d+ IN \(([^)]*)\)", plan) for m in x.split(",")}
    assert 0 < len(folders) <= 4 < 256
    assert merkle.diff(spark, paths[0], paths[2], depth).count() == 0


def test_row_digests_tell_values_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ('a","c1":"b', "c")], "x string, y string")
    assert rows.select(merkle.row_digest(["x", "y"])).distinct().count() == 5




def test_digests_of_records_tell_fields_and_nulls_apart(spark):
    rows = [(1, 1, "a|b", "c"), (2, 1, "a", "b|c"), (3, 1, None, "c"), (4, 1, "", "c"), (5, 1, "null;", "c"), (6, 1, "1:a;", ""), (7, 1, "a", "1:;"), (8, 1, "a|b", "c")]
    df = spark.createDataFrame(rows, "base bigint, k bigint, x string, y string")
    digests = {r.base: r.digest for r in bundles.component_digest(df, "base", "k", ["x", "y"]).collect()}
    assert digests[1] == digests[8] and len(set(digests.values())) == 7
    signed = {r.base: r.signature for r in responses.freeze(df, "base", "k", ["x", "y"], F.lit(True)).collect()}
    assert len(set(signed.values())) == 7


def test_release_gates_block_what_could_not_be_read(spark):
    releases = spark.createDataFrame([(i,) for i in range(5)], "release bigint")
    runs = [(0, "p1", 0, "pass", 0), (1, "p1", None, None, None), (2, "p1", None, None, None), (2, "p2", 0, "pass", 0), (3, "p1", 0, None, None)]
    found = release.preflight(releases, spark.createDataFrame(runs, "release bigint, preflight_id string, findings int, status string, exit_code int")).collect()
    assert {r.release: r.reason for r in found} == {0: None, 1: "preflight_unreadable", 2: "preflight_unreadable", 3: None, 4: "no_preflight_run"}
    manifests = spark.createDataFrame([(i, "h", "h", 1.0) for i in range(3)], "release bigint, manifest_hash string, current_hash string, agreement double")
    one = spark.createDataFrame([(i, "x") for i in range(3)], "release bigint, hash string")
    drafts = spark.createDataFrame([(i, "d") for i in range(3)], "release bigint, draft string")
    omissions = spark.createDataFrame([], "release bigint, hash string, approved boolean")
    assemblies = spark.createDataFrame([(1, "a", 1.0, 1.0)], "release bigint, assembly string, vs_source double, vs_drafts double")
    args = (releases.filter("release < 3"), manifests, one, drafts, one, omissions, assemblies)
    files = spark.createDataFrame([(0,), (0,), (1,)], "release bigint")
    assert {r.release: r.reason for r in release.correspondence(*args, files).collect()} == {0: "no_assembly_manifest", 1: None, 2: None}
    assert {r.reason for r in release.correspondence(*args).collect()} == {None}


def test_publish_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    numbers = lambda n: spark.range(n).withColumnRenamed("id", "k")
    first = records.publish(numbers(3), path)
    before = records.current(spark, path)
    point = records._point
    monkeypatch.setattr(records, "_point", lambda *_: 1 / 0)  # the writer is lost between its two steps
    with pytest.raises(ZeroDivisionError):
        records.publish(numbers(5), path)
    assert records.current(spark, path).count() == 3
    monkeypatch.setattr(records, "_point", point)
    second = records.publish(numbers(7), path)
    assert records.current(spark, path).count() == 7 and before.count() == 3 and records.current(spark, path, first).count() == 3
    third = records.publish(numbers(1), path)
    gone = records.expire(spark, path)
    assert first in gone and second not in gone and len(gone) == 2
    assert records.current(spark, path).count() == 1 and records.current(spark, path, third).count() == 1 and records.current(spark, path, second).count() == 7


def test_ties_of_last_records(spark):
    for rows in ([("u", 1, "b"), ("u", 1, "a")], [("u", 1, "a"), ("u", 1, "b")]):
        tied = spark.createDataFrame(rows, "unit string, attempt int, result string").coalesce(1)
        assert responses.latest_attempt(tied, 3).first().result == "b"
        cycles = tied.selectExpr("unit AS session", "attempt AS cycle", "CASE result WHEN 'a' THEN 'converged' ELSE 'oscillating' END AS outcome")
        assert reviews.session_outcomes(tied.selectExpr("unit AS session").distinct(), cycles, 5).first().outcome == "oscillating"
