"""Filter audit, sharding and nested schemas: brute force on small tables and on the given ones, and edge cases."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
import xxhash
from pyspark.sql import functions as F

from inkbed.llm import filteraudit, nested, queries, sharding

DOCS = "doc_id bigint, text string, source string, part int, mask string, digest int, shard int, slot int, _deal int, rows int"
LABELS = "doc_id bigint, quality int, toxic int, part int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3, 4, 5, 6) for i, t, s in rows], DOCS)


# filter audit


def failures(rows):
    """Set of failed filters of each (doc_id, text, source)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        failed = {"A"} if len(w) < 200 else set()
        failed |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        failed |= {"D"} if set(t) & set("#$%&*|") else set()
        failed |= {"E"} if i is not None and i > first[t] else set()
        out.append(failed)
    return out


def audited(rows, labels):
    """All orders, run one after another on the documents themselves."""
    good, toxic = ({i for i, *x in labels if x[k] == 1} - {None} for k in (0, 1))
    out, shapley = {}, Counter()
    fails = failures(rows)
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for k, letter in enumerate(order):
                lost = [x for x in left if letter in x[1]]
                redundant = sum(letter in x[1] for x in gone)
                left, gone = [x for x in left if letter not in x[1]], gone + lost
                shapley[part, letter] += len(lost)
                out[part, "".join(order), k + 1] = (len(left), len(lost), redundant, sum(x[1] == {letter} for x in own), sum(x[0] in good for x in lost), sum(x[0] in toxic for x in lost))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_hand(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(120):
        n = rng.choice([0, 3, 199, 200, 260])
        words = [rng.choice("ab") if i % 3 else f"w{j}" for j in range(n)]
        text = rng.choice([" ", "\n", "\x0b", "  "]).join(words) + rng.choice(["", "", " #", " ABCDEFGHI", " é|"])
        rows.append((i if i % 17 else None, text if i % 11 else None, rng.choice(["s", "", None, "z"])))
        labels += [(i, rng.choice([0, 1, None]), rng.choice([0, 1]))] * (i % 3)
    rows += rows[30:50] + [(200 + i, rows[40][1], "z") for i in range(9)]
    labels += [(7, 1, 1), (None, 1, 1)]
    given = spark.createDataFrame([(*x, 9) for x in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.audit(docs(spark, rows), given).collect()}
    assert got == audited(rows, labels)


def test_audit_of_nothing_and_of_long_texts(spark):
    none = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(docs(spark, []), none).count() == 0
    long_ = " ".join(f"w{i}" for i in range(150_000))
    rows = filteraudit.audit(docs(spark, [(1, long_, "s"), (2, long_, "s"), (2, long_, "s")]), none).filter("step = 1")
    assert {r.filter_order[0]: r.removed for r in rows.collect()} == {"A": 0, "B": 0, "C": 0, "D": 0, "E": 2}


def test_incidence_matrices():
    orders, m = filteraudit.incidence()
    assert len(set(orders)) == 120 and all(x.shape == (32, 600) for x in m.values())
    # a document that fails k filters is removed once in each order, and shares 120 removals among its filters
    for mask in range(32):
        assert m["removed"][mask].sum() == (120 if mask else 0)
        assert (m["removed"] + m["redundant"])[mask].sum() == 120 * mask.bit_count()
        assert set(m["shapley"][mask]) <= {0, 120 // max(1, mask.bit_count())}


# sharding


def spark_hash(*values):
    """Spark's xxhash64 of ints (4 bytes), longs (8 bytes; given as (n,)) and nulls."""
    h = 42
    for v in values:
        if v is None or v == (None,):
            continue
        h = xxhash.xxh64_intdigest(v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def quantile(u, urn, marked, drawn):
    """Exact, with fractions."""
    lo, hi, goal, total = max(0, drawn + marked - urn), min(drawn, marked), Fraction(u), Fraction(0)
    for x in range(lo, hi + 1):
        total += Fraction(math.comb(marked, x) * math.comb(urn - marked, drawn - x), math.comb(urn, drawn))
        if total > goal:
            return x
    return hi


def sharded(rows, shards, seed, per):
    """The same shuffle of (doc_id, text), one step after another in lists."""
    own = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    n = max(sharding.PARTITIONS, -(-len(own) // per))
    parts = defaultdict(list)
    for r in own:
        parts[signed(spark_hash(seed, *((x,) for x in r))) % n].append(r)
    levels = 1
    while sharding.FAN**levels < n:
        levels += 1
    room = {0: sharding.shard_sizes(len(own), shards)}
    for level in range(levels - 1, -1, -1):
        sizes = Counter()
        for p, x in parts.items():
            sizes[p // sharding.FAN**level] += len(x)
        below = {}
        for child in sorted(sizes):
            r, left, got = room[child // sharding.FAN], sizes[child], []
            for s in range(shards):
                u = (spark_hash(seed, level, (child,), s) >> 11) * 2.0**-53
                got.append(quantile(u, sum(r[s:]), r[s], left))
                left -= got[-1]
            below[child] = got
            room[child // sharding.FAN] = [a - b for a, b in zip(r, got, strict=True)]
        assert not any(any(r) for r in room.values())  # all columns come out
        room = below
    sent = defaultdict(list)
    for p, x in parts.items():
        x.sort(key=lambda r: signed(spark_hash(seed + 1, *((v,) for v in r))))  # ties are equal rows
        ends = [sum(room[p][: s + 1]) for s in range(shards)]
        for at, r in enumerate(x, 1):
            sent[sum(e < at for e in ends)].append((spark_hash(seed + 2, (p,), at), r))
    return [(*r, s, k) for s, x in sent.items() for k, (_, r) in enumerate(sorted(x, key=lambda y: y[0]))]


def test_draws_are_exact_quantiles(spark):
    us = [(k + 0.5) / 400 for k in range(400)]
    cases = [(10, 3, 4), (1, 1, 1), (7, 0, 3), (7, 7, 3), (7, 3, 0), (7, 3, 7), (500, 20, 100), (3000, 1500, 1500), (40_000, 1_700, 20_000), (1000, 999, 500)]
    rows = spark.createDataFrame([(u, *c) for c in cases for u in us], "u double, t bigint, k bigint, n bigint")
    got = defaultdict(list)
    for r in rows.select("*", sharding.hypergeometric(F.col("u"), F.col("t"), F.col("k"), F.col("n")).alias("x")).collect():
        got[r.t, r.k, r.n].append((r.u, r.x))
    for (t, k, n), found in got.items():
        lo, hi, total, last = max(0, n + k - t), min(n, k), Fraction(0), None
        ends = []
        for x in range(lo, hi + 1):
            last = Fraction(math.comb(k, x) * math.comb(t - k, n - x), math.comb(t, n)) if last is None else last * Fraction((k - x + 1) * (n - x + 1), x * (t - k - n + x))
            total += last
            ends.append((total, x))
        assert total == 1
        for u, x in found:
            assert x == next(y for end, y in ends if end > u), (t, k, n, u)


def test_draw_at_large_sizes(spark):
    """Mean and deviation at 10**9 rows."""
    t, k, n = 10**9, 10**9 // 24, 5 * 10**8
    u = (F.col("id") + 0.5) / 60
    x = spark.range(60).select(sharding.hypergeometric(u, F.lit(t), F.lit(k), F.lit(n)).alias("x"))
    mean, deviation = x.agg(F.avg("x"), F.stddev("x")).first()
    want = math.sqrt(n * (k / t) * (1 - k / t) * (t - n) / (t - 1))
    assert abs(mean - n * k / t) < 0.01 * want and abs(deviation / want - 1) < 0.04


@pytest.mark.parametrize(("n", "shards", "per"), [(300, 24, 5), (90, 5, 20_000), (5, 24, 20_000)])
def test_shuffle_equals_lists(spark, n, shards, per):
    rng = random.Random(n)
    rows = [(i if i % 40 else None, rng.choice([None, "", "é" * i, f"t{i % 7}"])) for i in range(n)]
    rows += rows[: n // 4]
    got = sharding.shuffled(docs(spark, [(*r, "s") for r in rows]), shards, 7, per).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sharded(rows, shards, 7, per)))


def test_shuffle_of_many_equal_rows(spark):
    rows = [(None, None, "s")] * 700 + [(5, "same", "s")] * 700 + [(i, f"t{i}", "s") for i in range(700)]
    got = sharding.shuffled(docs(spark, rows), 24, 1, 10).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted(map(len, by.values())) == sorted(sharding.shard_sizes(2100, 24))
    same = Counter(r.shard for r in got if r.doc_id == 5)
    assert max(same.values()) < 60 and min(same.values()) > 8  # 29 on average
    assert sharding.shuffled(docs(spark, [])).count() == 0


def test_shuffle_is_even_and_reruns_agree(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = (sorted(sharding.shuffled(t).collect()) for t in (table, table.repartition(5)))
    assert one == two
    other = sharding.shuffled(table, seed=3).collect()
    assert sum(a.shard == b.shard for a, b in zip(sorted(one), sorted(other), strict=True)) < len(one) / 5
    ranks = [r.doc_id for r in sorted(one, key=lambda r: (r.shard, r.slot))]
    descents = sum(a > b for a, b in zip(ranks, ranks[1:], strict=False))
    assert abs(descents - len(ranks) / 2) < 5 * math.sqrt(len(ranks) / 12)


# nested schemas


def placed(rows):
    """(g, value below $.g) of each row (click_id, client_id, props), None where props isn't an object."""
    for click, client, props in rows:
        g = client % 30 if client is not None else 0
        x = zlib.crc32(str("" if click is None else click).encode()) % (g % 37 + 1)

        def refuse(_):
            raise ValueError

        try:
            v = json.loads(props, parse_constant=refuse, parse_int=lambda s: 1) if props is not None else None
        except (ValueError, RecursionError):
            v = None
        v = v if isinstance(v, dict) else None
        yield f"g{g}", None if v is None else {f"x{x}": [v] if click is not None and click % 5 == 0 else v}


NAMES = {type(None): "null", bool: "boolean", int: "integer", float: "double", str: "string", list: "array", dict: "object"}


def inferred(rows):
    """From the top down over whole values: a path, all values at it, then its children."""
    out, bad, tops = {}, Counter(), []
    for g, v in placed(rows):
        if v is None:
            bad["!" + g] += 1
        else:
            tops.append({g: v})

    def walk(path, values, own, parents):
        kinds = Counter(NAMES[type(v)] for v in values)
        objects, arrays = ([v for v in values if isinstance(v, t)] for t in (dict, list))
        names = {n for v in objects for n in v}
        is_map = len(names) > 12 and path != "$"
        lengths = [len(v) for v in arrays]
        assert path not in out
        out[path] = ("|".join(f"{k}:{n}" for k, n in sorted(kinds.items())), len(names), is_map, own not in (None, "*") and len(values) < parents, min(lengths, default=None), max(lengths, default=None))
        if is_map:
            walk(path + ".*", [x for v in objects for x in v.values()], "*", 0)
        else:
            for n in names:
                walk(f"{path}.{n}", [v[n] for v in objects if n in v], n, len(objects))
        if any(lengths):
            walk(path + "[]", [x for v in arrays for x in v], None, 0)

    if tops:
        walk("$", tops, None, 0)
    return out | {k: (f"bad:{n}", 0, False, False, None, None) for k, n in bad.items()}


CLICKS = "click_id bigint, client_id bigint, props string, steps int, top int, path int, present int"


def schema_rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: r[1:] for r in out}


def clicks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], CLICKS)


def test_schema_of_the_table_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "client_id", "props").collect()]
    assert schema_rows(queries.QUERIES["op13_nested"](spark, sf_dir)) == inferred(rows)


ODD = [
    None, "", " ", "{", "[]", "[{}]", "null", "3", '"x"', "{}", " \n{}\t ", '{"a": NaN}', '{"a": 1} x', "{'a': 1}", '{"a": 1, "a": "b"}', '{"": 1}', '{"é": {"ü": []}}',
    '{"a": 1' + "0" * 6000 + "}", '{"a": -0, "b": 1e3, "c": 1.0, "d": true, "e": null}', '{"a": [[], [1, [2.5]], [[[]]], {"b": [1, "x", null]}, {"b": []}]}',
    '{"a": {"b": {"c": {"d": {"e": {"f": {"g": [{"h": [[1], []]}]}}}}}}}', '{"a": ["' + "y" * 300_000 + '"]}', '{"a": [' + ", ".join(["{}", "[]"] * 3000) + "]}",
]


def test_schema_of_odd_rows(spark):
    rows = [(i * k, g, p) for k in (1, 5) for g in (0, 7, None, 31) for i, p in enumerate(ODD)] + [(None, None, '{"z": 1}')] * 3
    assert schema_rows(nested.clicks_schema(clicks(spark, rows))) == inferred(rows)
    assert nested.clicks_schema(clicks(spark, [])).count() == 0
    assert schema_rows(nested.clicks_schema(clicks(spark, [(1, 1, None)]))) == {"!g1": ("bad:1", 0, False, False, None, None)}


def test_schema_of_random_rows_in_small_groups(spark, monkeypatch):
    """Maps in maps, names that are few here and many in all, arrays of objects; groups of rows of a few entries."""
    rng = random.Random(11)

    def value(depth):
        kind = rng.randrange(9 if depth < 5 else 6)
        if kind > 6:
            return {rng.choice([f"k{rng.randrange(2 + 20 * depth)}", "a", "b"]): value(depth + 1) for _ in range(rng.randrange(5))}
        if kind > 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return [None, True, 1, 2.5, "s", -7][kind]

    rows = [(i, rng.choice([1, 2, 13]), json.dumps({f"n{rng.randrange(12)}": value(1) for _ in range(rng.randrange(6))})) for i in range(900)]
    rows += [(i, 2, json.dumps({"m": {f"k{i % 15}": {f"j{i % 40}": {f"l{i % 13 + j}": [i] for j in range(2)}}}})) for i in range(200)]
    want = inferred(rows)
    assert any(v[2] for v in want.values()) and any(k.count(".*") > 1 for k in want)
    monkeypatch.setattr(nested, "GROUP_ENTRIES", 40)
    assert schema_rows(nested.clicks_schema(clicks(spark, rows).repartition(5))) == want


def test_schema_of_nested_and_broken_unicode(spark):
    deep = '{"a":' * 15 + "1" + "}" * 15
    rows = [(1, 1, deep), (2, 1, '{"\\ud800": 1}')]
    got = schema_rows(nested.clicks_schema(clicks(spark, rows)))
    assert got["$.g1.x" + str(zlib.crc32(b"1") % 2) + ".a" * 15][0] == "integer:1"
    assert any(k.endswith(".?") for k in got)
    # beyond what the parser nests, a text is bad
    assert list(schema_rows(nested.clicks_schema(clicks(spark, [(1, 1, '{"a":' * 200_000 + "1" + "}" * 200_000)])))) == ["!g1"]


def test_footers_of_a_row_group():
    root = nested.Shredded()
    for v in ({"a": [1, 2]}, {"a": []}, {}, {"a": [[], [3]]}, {"a": None}):
        root.shred(v)
    got = {"".join(s): (dict(zip(nested.TYPES, values, strict=True)), present, lo, hi) for s, values, present, lo, hi in root.footers()}
    assert got[""][1] == 5 and got[".a"][1:] == (4, 0, 2) and got[".a"][0]["array"] == 3
    assert got[".a[]"][1:] == (4, 0, 1) and got[".a[][]"][1] == 1
    items = root.members["a"].items
    assert items.rep == [0, 1, 0, 0, 1] and items.dfn == [2, 2, 1, 2, 2] and items.items.rep == [0, 1]
