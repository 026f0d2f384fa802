"""Findings of round 4, one small test for each."""

import random

import pytest

from inkbed.operators import graph


@pytest.fixture
def small_batches(spark):
    """Workers get 5 rows at a time, so that they reach the most rows that they take."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def shuffled_rows(spark, run):
    """What run gives, and the rows that its stages have shuffled."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = set(stages())
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def components_by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_f1_scattered_links_are_read_a_few_times(spark, small_batches):
    """Copies of one graph whose ids alternate: ranges of ids hold no component, and rounds over all links shuffled them again and again."""
    rng = random.Random(1)
    one = {(a, 250 + rng.randrange(120)) for a in range(250) for _ in range(4)}
    links = [(a * 25 + i, b * 25 + i) for i in range(25) for a, b in one]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    rows, shuffled = shuffled_rows(spark, lambda: graph.label_components(df, most=400).collect())
    want = components_by_hand(links)
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert shuffled < 6 * len(links)


@pytest.mark.parametrize("most", [7, 10_000])
def test_f1_nodes_that_share_items(spark, small_batches, most):
    """Sparse, dense, one node with many items, and one item of many nodes."""
    rng = random.Random(2)
    for nodes, items, n in ((200, 150, 250), (40, 5, 200), (1, 40, 90), (90, 1, 90)):
        pairs = [(rng.randrange(nodes) * 5 - 9, rng.randrange(items) * 3 - 7) for _ in range(n)]
        want = {x[1]: least[1] for x, least in components_by_hand([((0, a), (1, b)) for a, b in pairs]).items() if not x[0]}
        df = spark.createDataFrame([*pairs, (None, 4), (4, None)], "node bigint, item int").repartition(3)
        rows = graph.sharing(df, most).collect()
        assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_f1_hooks_of_structs(spark, small_batches):
    ids = list(range(80))
    random.Random(4).shuffle(ids)
    pair = lambda x: (x % 7, x)
    links = [(pair(a), pair(b)) for a, b in zip(ids, ids[1:], strict=False) if a % 9]
    df = spark.createDataFrame(links, "a struct<g: bigint, n: bigint>, b struct<g: bigint, n: bigint>")
    rows = graph._hooked(df, 30).collect()
    assert {(tuple(r.node), tuple(r.component)) for r in rows} == set(components_by_hand(links).items()) and len(rows) == len(components_by_hand(links))
