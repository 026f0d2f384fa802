"""Findings of round 3, one small test for each."""

import random

import duckdb
import pytest

from inkbed.plans import registry


def by_sql(name, **tables):
    """Rows of a query's SQL over pandas frames, as a sorted list of rows with columns by name."""
    con = duckdb.connect()
    for t, frame in tables.items():
        con.register(t, frame)
    columns = sorted(con.sql(registry.ORACLES[name]).columns)
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())


def by_spark(spark, name, folder, **tables):
    for t, frame in tables.items():
        frame.to_parquet(f"{folder}/{t}.parquet")
    df = registry.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def documents(ids, **more):
    import pandas as pd

    return pd.DataFrame({"doc_id": list(ids), "text": [f"text {i}" for i in ids], "lang": "en", "source": "s", "n_chars": [7 * i % 400 for i in ids]} | more)


def test_f1_whole_order_of_blocks_with_gaps(spark, tmp_path):
    docs = documents([*range(14), *range(16, 30, 3), *range(40, 46)])
    assert by_spark(spark, "whole_order", tmp_path, documents=docs) == by_sql("whole_order", documents=docs)


def strong_by_hand(edges):
    """node -> least node of its strongly connected component, for components of two and more."""
    gives = {}
    for a, b in edges:
        gives.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in gives.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    reached = {x: reach(x) for x in {y for e in edges for y in e}}
    return {x: min(y for y in reached[x] if x in reached[y]) for x in reached if any(y != x and x in reached[y] for y in reached[x])}


@pytest.mark.parametrize("kind", ["near", "far", "text"])
def test_f2_f3_f4_f5_components_by_blocks(spark, kind):
    from inkbed.operators import scc

    rng = random.Random(kind)
    edges = {(x, x + 1) for x in range(400) if x % 9} | {(x + rng.randrange(2, 30), x) for x in range(0, 400, 25)} | {(x, x) for x in range(5)} | {(399, 700), (700, 390)}
    if kind == "far":
        names = rng.sample(range(10_000), 1000)
        edges = {(names[x], names[y]) for x, y in edges} | {(names[rng.randrange(400)], names[rng.randrange(400)]) for _ in range(60)}
    if kind == "text":
        edges = {(f"g:{x}", f"g:{y}") for x, y in edges}
    df = spark.createDataFrame(sorted(edges), "a string, b string" if kind == "text" else "a bigint, b bigint")
    got = {r.node: r.component for r in scc.strong_components(df, "a", "b", most=40).collect()}
    assert got == strong_by_hand([e for e in edges if e[0] != e[1]])


def test_f2_f3_f4_f5_rounds_do_not_grow(spark, tmp_path):
    """A chain of rings in blocks: no round of colours is needed, which grew with the chain."""
    from inkbed.operators import scc

    def no(*_):
        raise AssertionError("colours")

    edges = [(10 * i + a, 10 * i + b) for i in range(300) for a, b in ((0, 3), (3, 6), (6, 0), (6, 7), (7, 8), (8, 9), (9, 10))]
    kept, scc._colours = scc._colours, no
    try:
        got = scc.strong_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b", most=200).collect()
    finally:
        scc._colours = kept
    assert {(r.node, r.component) for r in got} == {(10 * i + k, 10 * i) for i in range(300) for k in (0, 3, 6)}


@pytest.mark.parametrize("structs", [False, True])
def test_components_of_links_by_levels(spark, structs):
    from inkbed.operators import graph

    rng = random.Random(5)
    links = [(x, x + 1) for x in range(600) if x % 37] + [(rng.randrange(700, 1000), rng.randrange(700, 1000)) for _ in range(150)] + [(2000, 2000), (3000, 5), (None, 4)]
    owner = {x: x for e in links if None not in e for x in e}
    for _ in range(len(owner)):
        before = dict(owner)
        for a, b in links:
            if a is not None:
                owner[a] = owner[b] = min(owner[a], owner[b])
        if before == owner:
            break
    df = spark.createDataFrame(links, "a bigint, b bigint")
    if structs:
        df = df.filter("a IS NOT NULL").selectExpr("struct(a div 50 AS g, a AS n) AS a", "struct(b div 50 AS g, b AS n) AS b")
    got = graph.label_components(df, most=50).collect()
    assert len(got) == len(owner)
    assert {(r.node.n, r.component.n) if structs else (r.node, r.component) for r in got} == set(owner.items())


def test_f8_export_deals_by_short_keys(spark, tmp_path):
    """The driver cuts the ranges by a sample of the keys; whole titles in it made hundreds of MB."""
    from inkbed.sources import records

    titles = ["w" * (k + 1) + f" word {k % 7} " + "x" * 20_000 for k in range(60)]
    rows = spark.createDataFrame([(f"19{k % 3 + 10}", t, "a", "", "") for k, t in enumerate(titles)], "year string, title string, author string, doi string, url string")
    asked, kept = [], type(rows).repartitionByRange
    type(rows).repartitionByRange = lambda self, *c: asked.append(max(map(len, (str(x) for r in self.select(*c).collect() for x in r)))) or kept(self, *c)
    try:
        out = str(tmp_path / "out")
        assert records.export_bibliography(rows, out, "d", "s", ("word",)).first()["record_count"] == 60
    finally:
        type(rows).repartitionByRange = kept
    assert asked and max(asked) <= records.RANGE_CHARS
    got = [(r.year, r.title) for r in spark.read.option("header", True).csv(sorted(map(str, (tmp_path / "out").glob("part-*")))).collect()]
    assert sorted(got) == sorted((f"19{k % 3 + 10}", t) for k, t in enumerate(titles))


def test_f11_f13_f15_scanner_gives_back_little_at_once(spark):
    from inkbed.sources import latex

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    files = spark.createDataFrame([(i, "\\section{A}\n\nsee \\cite{b} " * 40) for i in range(600)], "doc_id bigint, tex string").coalesce(1)
    found = latex.protected_objects(files)
    assert found.count() == 600 * 40
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert latex.partition(files).selectExpr("sum(length(region))").first()[0] == files.selectExpr("sum(length(tex))").first()[0]


def test_f10_long_ranges_makes_no_pairs(spark, tmp_path):
    docs = documents(range(1000))
    docs.to_parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["long_ranges"](spark, str(tmp_path))
    assert "_level" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.select("met", "range_id", "shared").collect())) == by_sql("long_ranges", documents=docs)


def test_f10_totals_equal_the_pairs(spark):
    from inkbed.operators import intervals

    rng = random.Random(3)
    a, b = ([(rng.choice("kl"), i, s, s + rng.choice(sizes)) for i in range(150) for s in [rng.randrange(200)]] for sizes in ([1, 2, 9, 300], [0, 1, 30, 500]))
    x, y = spark.createDataFrame(a, "k string, i bigint, start bigint, end bigint"), spark.createDataFrame(b, "k string, j bigint, start bigint, end bigint")
    pairs = [(q[0], q[1], min(p[3], q[3]) - max(p[2], q[2])) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3]]
    want = {(k, j): (len(v), sum(v)) for k, j in {p[:2] for p in pairs} for v in [[p[2] for p in pairs if p[:2] == (k, j)]]}
    assert {(r.k, r.j): (r.met, r.shared) for r in intervals.overlap_totals(x, y, "k", "j").collect()} == want


def test_f16_small_keys_meet_without_nodes(spark, sf_dir):
    df = registry.QUERIES["overlapping_ranges"](spark, sf_dir)
    assert "_level" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_f7_orders_and_parts_are_one_graph(spark, tmp_path):
    import pandas as pd

    lines = pd.DataFrame({"l_orderkey": [9, 9, 7, 5, 5, 4, 2], "l_partkey": [1, 2, 2, 3, 3, 5, 5]})
    assert by_spark(spark, "span_components", tmp_path, lineitem=lines) == [(2, 2), (2, 4), (5, 5), (7, 7), (7, 9)]


def test_f6_pacing_reads_its_words_once(spark, tmp_path):
    rng = random.Random(6)
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    line = lambda n: " ".join(word(int(rng.paretovariate(0.4)) % 9000) if rng.random() < 0.9 else "of" for _ in range(n))
    texts = ["\n".join(line(rng.choice(sizes)) for _ in range(k)) for k, sizes in ((60, (0, 1, 40, 300)), (3, (2500,)), (9, (0, 1, 2, 700)), (1, (1501,)), (2, (1502, 1)), (1, (0,)))]
    docs = documents(range(len(texts) + 1), text=[*texts, None])
    assert by_spark(spark, "pacing_metrics", tmp_path, documents=docs) == by_sql("pacing_metrics", documents=docs)
    df = registry.QUERIES["pacing_metrics"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert "SortAggregate" not in registry.QUERIES["first_use"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 10, 90, 2000])
def test_f9_f14_packing_by_slices(spark, most):
    from inkbed.operators import graph

    from test_scale import packed

    rng = random.Random(most)
    data = {g: [(p, rng.choice([0, 0, None, 1, 2, 3, 9, 30, 80])) for p in range(n)] for g, n in (("a", 3), (None, 90), ("x", 260), ("y", 1), ("z", 40))}
    data["z"] = [(p, 0) for p, _ in data["z"]]
    rows = [(g, p, p, w) for g, items in data.items() for p, w in items]
    rng.shuffle(rows)
    want = sorted(map(str, ((g, u, p) for g, items in data.items() for u, p in packed(items, most))))
    for size in (6, 45):
        got = graph.pack_units(spark.createDataFrame(rows, "grp string, pos bigint, item bigint, words bigint"), most, size).collect()
        assert sorted(map(str, ((r.grp, r.unit, r.pos) for r in got))) == want


def test_f9_f14_packing_has_no_rounds(spark, monkeypatch):
    """Pointers doubled in as many rounds of joins as the logarithm of the units."""
    from inkbed.operators import graph

    calls, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda *a: calls.append(1) or kept(*a))
    counts = []
    for n in (8, 300):
        calls.clear()
        rows = spark.range(n).selectExpr("'g' AS grp", "id AS pos", "id AS item", "7L AS words")
        assert graph.pack_units(rows, 10).agg({"unit": "max"}).first()[0] == n - 1
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_f12_sets_too_large_are_gone_before_the_index(spark, monkeypatch):
    """Documents of hundreds of words can't be like an item of ten; all their words were sorted and counted."""
    from inkbed.operators import matching

    rng = random.Random(12)
    a = {i: {f"w{rng.randrange(40)}" for _ in range(rng.randrange(11))} for i in range(30)}
    b = {i: {f"w{rng.randrange(60)}" for _ in range(rng.randrange(60))} | {f"v{k}" for k in range(rng.choice((0, 3, 400)))} for i in range(150)}
    b |= {200 + i: set(list(s)[1:]) | {"z"} for i, s in a.items()}
    kept, asked = matching.written, []
    monkeypatch.setattr(matching, "written", lambda rows: asked.append(kept(rows)) or asked[-1])
    x, y = (spark.createDataFrame([(i, sorted(s)) for i, s in rows.items()], f"{n} bigint, tokens array<string>") for n, rows in (("a", a), ("b", b)))
    for least in (0.07, 0.3, 0.9):
        asked.clear()
        got = {(r.a, r.b): r.similarity for r in matching.token_jaccard(x, y, "a", "b", least).collect()}
        assert got == {(i, j): len(s & t) / len(s | t) for i, s in a.items() for j, t in b.items() if s and len(s & t) / len(s | t) >= least}
        assert asked[1].agg({"_m": "max"}).first()[0] <= 10 / least


def test_f17_chains_of_text_nodes_need_no_rounds(spark, monkeypatch):
    """Nodes are texts of an id and a number, as in accepted_cycles: neighbours in their order stay in a block."""
    from inkbed.operators import graph, scc

    def no(*_):
        raise AssertionError("colours")

    monkeypatch.setattr(scc, "_colours", no)
    monkeypatch.setattr(graph, "strong_components", lambda *a: scc.strong_components(*a, most=200))
    edges = [(f"{d}:{i}", f"{d}:{1 if i == 4 and d % 3 == 0 else i + 1}") for d in range(400) for i in range(5)]
    got = graph.cyclic_nodes(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert sorted(r.node for r in got) == sorted(f"{d}:{i}" for d in range(0, 400, 3) for i in (1, 2, 3, 4))


@pytest.mark.parametrize("form", ["blocks", "colours"])
def test_f5_tables_of_the_graph_are_not_broadcast(spark, monkeypatch, form):
    """A broadcast goes through the driver; there were several in each level and each round of colours."""
    from inkbed.operators import scc

    rng = random.Random(5)
    names = rng.sample(range(10_000), 300)
    edges = {(names[x], names[x + 1]) for x in range(299) if x % 60} | {(names[x + 20], names[x]) for x in range(0, 270, 30)}
    plans, kept = [], scc.written
    monkeypatch.setattr(scc, "written", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kept(rows))
    df = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    found = scc.strong_components(df, "a", "b", most=40) if form == "blocks" else scc._by_colours(df, 40)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.node for r in found.collect()} == set(strong_by_hand(edges))
    # wide blocks (_a) and colours (_c, _f) may be: a row for each, and few
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and not any(f"BroadcastHashJoin [{c}#" in line for c in ("_a", "_c", "_f"))]
    assert len(plans) > 5 and not joins
