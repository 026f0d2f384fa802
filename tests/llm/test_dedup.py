"""Suffixes, Jaccard join, components and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkbed.llm import components, jaccard, queries, suffixes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int, node int"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in pairs], DOCS)


def cut_by_hand(pairs, depth):
    seen, out = set(), {}
    for i, t in sorted(pairs, key=lambda x: x[0]):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - depth + 1):
            w = raw[p : p + depth]
            if w in seen:
                cover[p : p + depth] = b"\x01" * depth
            seen.add(w)
        rest = bytes(x for x, c in zip(raw, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(raw), sum(cover), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("depth", [100, 12])
def test_suffixes_by_hand(spark, depth):
    rng = random.Random(depth)
    bits = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(1, 3 * depth))) for _ in range(12)]
    texts = [None, "", "a" * (3 * depth), "a" * (2 * depth), "é" * depth, "x" * (depth - 1), "x" * depth]
    texts += ["".join(rng.choice(bits) if rng.random() < 0.6 else rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += texts[10:14]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    rows = suffixes.removed(docs(spark, pairs), depth).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == cut_by_hand(pairs, depth)


@pytest.mark.parametrize("bucket,most", [(50, 400), (1 << 20, 2000)])
def test_suffixes_in_buckets_that_are_too_large(spark, bucket, most):
    """A line shorter than the depth in many surroundings makes buckets that are dealt again, down to single windows."""
    rng = random.Random(bucket)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    line, passage = word(70), word(130)
    texts = [word(40) + line + word(40) for _ in range(60)] + [word(rng.randrange(9)) + passage[rng.randrange(20) :] + line for _ in range(60)] + [passage * 3] * 20
    pairs = list(enumerate(texts))
    table = docs(spark, pairs).repartition(5).select("doc_id", "text")
    want = cut_by_hand(pairs, 100)
    for few in (1, 4):
        spans = suffixes.repeated_spans(table.coalesce(few), 100, 32, bucket, most).collect()
        cover = defaultdict(set)
        for r in spans:
            cover[r.doc_id].update(range(r.lo, r.hi))
        assert {i: len(cover[i]) for i, _ in pairs} == {i: want[i][1] for i, _ in pairs}


def test_equal_groups_by_hand():
    rng = random.Random(5)
    for length in (1, 3, 8, 12, 100):
        raw = bytes(rng.choice(b"ab") if rng.random() < 0.9 else 99 for _ in range(900)) + b"abc" * 80
        at = np.arange(len(raw) - length + 1)
        data = np.frombuffer(raw, np.uint8)
        got, group = suffixes.equal_groups(data, at, np.zeros(len(at), np.int64), length)
        assert list(group) == sorted(group)
        found = defaultdict(set)
        for i, g in zip(got.tolist(), group.tolist(), strict=True):
            found[g].add(i)
        want = defaultdict(set)
        for i in at.tolist():
            want[raw[i : i + length]].add(i)
        assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
        if length >= 8:  # and they come in the order of their bytes
            firsts = [raw[min(found[g]) :][:length] for g in sorted(found)]
            assert firsts == sorted(firsts)


def test_runs_of_pieces_are_those_of_the_whole():
    rng = random.Random(6)
    text = "".join(rng.choice("abcd é") for _ in range(5000))
    windows = lambda parts: sorted((int(texts[t]), int(bases[t]) + p) for texts, bases, data, offsets in parts for t, a, b, *_ in zip(*suffixes.runs(data, offsets)) for p in range(a, b + 1))  # noqa: E731, B905
    column = pa.array(["x" * 150, text, None, "y" * 99, "z" * 101])
    whole = windows(suffixes.pieces(column, 99))
    assert whole == windows(suffixes.pieces(column, 99, 300)) and len(whole) == 51 + len(text.encode()) - 99 + 2


def test_suffixes_edges(spark):
    assert suffixes.removed(docs(spark, [])).count() == 0
    rng = random.Random(1)
    long_ = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = suffixes.removed(docs(spark, [(1, long_), (1, long_), (None, long_), (2, "zz" + long_)]), keep_text=True, keep=("spans", "node")).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed, r.kept_text) for r in rows)
    assert got == [(-1, 0, long_), (1, 0, long_), (1, 0, long_), (2, 300, "zz")]
    assert {(r.spans, r.node) for r in rows} == {(1, 2)}


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_by_hand(pairs):
    out = {}
    for i, t in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def groups_by_hand(pairs, percent=75):
    sets = sets_by_hand(pairs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, bases, copies, words):
    rng = random.Random(seed)
    texts = [None, "", "one", "One", "one two three", "one two  three", "a b c d e", "a b c d e f", "A B c d e f"]
    for _ in range(bases):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, words))]
        for _ in range(rng.randrange(copies)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = [f"w{rng.randrange(60)}"] * rng.randrange(3)
            texts.append(rng.choice([" ", "\n", "  "]).join(t))
    pairs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed,bases,copies,words", [(1, 30, 12, 40), (2, 12, 40, 12), (3, 20, 10, 150)])
def test_jaccard_by_hand(spark, seed, bases, copies, words):
    pairs = near_copies(seed, bases, copies, words)
    rows = jaccard.near_duplicates(docs(spark, pairs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups_by_hand(pairs)


def test_jaccard_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ONE_BLOCK", 3)
    monkeypatch.setattr(jaccard, "OTHER_BLOCK", 5)
    pairs = near_copies(4, 15, 25, 30)
    rows = jaccard.near_duplicates(docs(spark, pairs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups_by_hand(pairs)


@pytest.mark.parametrize("light", [0, 20, 48])
def test_jaccard_at_any_boundary(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda costs: light)
    pairs = near_copies(5, 20, 12, 60)
    rows = jaccard.near_duplicates(docs(spark, pairs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups_by_hand(pairs)


def test_boundary_by_cost():
    assert jaccard.boundary({2: (1, 5), 3: (1, 5), 4: (100, 5), 5: (9, 1)}) == 3
    assert jaccard.boundary({}) == 0


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    rows = jaccard.near_duplicates(docs(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, None)]
    got = defaultdict(set)
    for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect():
        got[r.component].add(r.node)
    assert got[100] == set(range(100, 141))
    assert all(min(v) == k for k, v in got.items())
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_a_shuffled_path(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    rows = components.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint")).collect()
    assert len(rows) == 1000 and {r.component for r in rows} == {0}


def test_queries_on_small_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    pairs = [tuple(r) for r in table]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_jaccard(spark, sf_dir).collect()}
    assert got == groups_by_hand(pairs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffixes(spark, sf_dir).collect()}
    assert got == cut_by_hand(pairs, 100)


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its own input: which rows stay, and what becomes of them."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "repeated_passages", "contamination", "mix"]
    extra = source.limit(1).selectExpr("900001L AS doc_id", "'123 456' AS text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "7L AS n_chars")
    one = corpus_pipeline.kept(stages["language"](spark, source.unionByName(extra), sf_dir))
    assert one.columns == source.columns and one.filter("doc_id = 900001").count() == 0 and one.count() == source.count()
    pairs = [tuple(r) for r in one.select("doc_id", "text").collect()]
    two = corpus_pipeline.kept(stages["near_duplicates"](spark, one, sf_dir))
    assert {r.doc_id for r in two.collect()} == {g for i, (n, g) in groups_by_hand(pairs).items() if g == i}
    pairs = [tuple(r) for r in two.select("doc_id", "text").collect()]
    three = corpus_pipeline.kept(stages["repeated_passages"](spark, two, sf_dir))
    want = cut_by_hand(pairs, 100)
    whole = {r.doc_id: r for r in three.collect()}
    assert whole.keys() == want.keys() and three.columns == source.columns
    before = dict(pairs)
    for i, r in whole.items():
        assert (r.text == before[i]) == (want[i][1] == 0) and r.n_chars == len(r.text)
    four = corpus_pipeline.kept(stages["contamination"](spark, three, sf_dir))
    assert 0 < four.count() <= three.count()
    five = stages["mix"](spark, four, sf_dir)
    assert five.count() == four.count()
    nothing = source.limit(0)
    for stage in stages.values():
        nothing = corpus_pipeline.kept(stage(spark, nothing, sf_dir))
        assert nothing.count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark, sf_dir):
    rows = docs(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m")])
    out = corpus_pipeline.near_duplicates(spark, rows, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_pipeline_with_clashing_names(spark, sf_dir):
    names = ["score", "lang_pred", "_text", "n_bytes", "kept_text", "spans", "component_id", "node", "_id", "size", "target"]
    rows = docs(spark, [(1, "a b c d e f g"), (2, "the cat sat on the mat"), (3, None)]).drop("spans", "node")
    for i, n in enumerate(names):
        rows = rows.withColumn(n, F.lit(i))
    out = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.kept(stage(spark, out, sf_dir))
        assert out.columns == rows.columns, name
    assert sorted((r.doc_id, r.score, r._text, r.node) for r in out.collect()) == [(1, 0, 2, 7), (2, 0, 2, 7)]
    assert corpus_pipeline.mix(spark, out, sf_dir).count() == 2


def test_near_duplicates_with_repeated_and_missing_ids(spark, sf_dir):
    """A repeated doc_id costs neither another text under it nor documents without doc_id, and loses no link."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    pairs = [(5, a), (5, b), (5, b), (6, b + " end"), (3, c), (8, c + " end"), (8, d), (8, d + " end"), (None, "p q"), (None, "r s"), (None, c), (9, ""), (9, "")]
    out = corpus_pipeline.near_duplicates(spark, docs(spark, pairs), sf_dir).collect()
    got = sorted(((r.doc_id or 0, r.text) for r in out), key=lambda x: (x[0], x[1].split(" end")[0]))
    want = [(0, c), (0, "p q"), (0, "r s"), (3, c), (5, a), (5, b), (8, d), (9, "")]
    assert [(i, t.removesuffix(" end")) for i, t in got] == want
    rows = jaccard.near_duplicates(docs(spark, pairs)).collect()
    assert sorted(r.component_id for r in rows if r.doc_id == 8) == [3, 8, 8] and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}


def test_very_long_texts(spark):
    """Texts that are read in pieces or slices of their own give what short ones give."""
    rng = random.Random(8)
    words = [f"{rng.randrange(10**6)}" for _ in range(170_000)]
    long_ = " ".join(words)
    assert len(long_) > 2 * suffixes.PIECE
    pairs = [(1, long_), (2, "x " + long_), (3, " ".join(words[1000:1040])), (4, "short one")]
    table = docs(spark, pairs)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(table).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.removed(table).collect()}
    assert cut == {1: (0, 0), 2: (len(long_), 1), 3: (len(pairs[2][1]), 1), 4: (0, 0)}


def test_pipeline_of_documents_without_ids(spark, sf_dir):
    """Documents without doc_id go through all stages and are judged by their own text."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 200").first().text
    clean = "the cat sat on the mat and the dog lay at the door of the house by the sea"
    out = docs(spark, [(None, item), (None, clean), (None, None), (1, clean + " again"), (1, "an other text of the same number with some more words in it")])
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.kept(stage(spark, out, sf_dir))
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 19), (1, 13), (1, 20)]
