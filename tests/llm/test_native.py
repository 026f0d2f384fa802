"""Quality, mixing, decontamination and chat: SQL on the small tables, brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from inkbed.llm import chat, decontamination, mixing, oracles, quality, queries

DOCS = "doc_id bigint, text string, lang string, source string, extra int"
SPACE = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, None, (sources or {}).get(i, "s"), i) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    text = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert text(df.select(*columns).collect()) == text(want)


@pytest.mark.parametrize("name", [*sorted(set(oracles.ORACLES) - {"op11_filteraudit"}), "op12_sharding"])
def test_no_python_on_the_main_path(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def quality_by_hand(text):
    w = SPACE.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality_by_hand(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "x " * 50, "é# <b>|", "a b c d e a b c d e", "l1\nl1\n\nl1\n"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "#", " ", "\x0b", "\x85"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = quality.apply_policy(quality.ledger(docs(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == quality_by_hand(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_quality_empty_and_ablation(spark):
    assert quality.apply_policy(quality.ledger(docs(spark, []))).count() == 0
    rows = quality.apply_policy(quality.ledger(docs(spark, ["word " * 3, " ".join(f"w{i}" for i in range(40))])))
    out = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(rows).collect()}
    assert out["few_words"] == (1, 0, 1) and out["symbols"] == (0, 0, 1)  # echoes fail it, too
    rows = quality.apply_policy(quality.ledger(docs(spark, [" ".join("abc"), " ".join(f"w{i}" for i in range(40))])))
    out = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(rows).collect()}
    assert out["few_words"] == (1, 0, 1) and out["short_words"] == (1, 0, 1)
    rows = quality.apply_policy(quality.ledger(docs(spark, ["one two three", " ".join(f"w{i}" for i in range(40))])))
    out = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(rows).collect()}
    assert out["few_words"] == (1, 1, 2) and out["echoes"] == (0, 0, 1)


def test_quality_of_odd_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    rows = docs(spark, [long_, "a b", "a b"]).withColumn("doc_id", F.lit(None).cast("bigint")).withColumns({c: F.lit(1) for c in ("n_words", "words", "m", "rule_mask", "kept")})
    out = quality.apply_policy(quality.ledger(rows)).collect()
    assert sorted((r.n_words, r.n_repeat_words, r.base_failed) for r in out) == [(2, 0, True), (2, 0, True), (60_000, 0, False)]


def fill(sizes, weights, most):
    """Water filling by hand, in rounds."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: weights[s] for s in sizes if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s for s in rest if share[s] >= most * sizes[s]}
        if not over:
            return share | capped
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_targets_and_taken(spark):
    rng = random.Random(2)
    sources = {i: rng.choice(["a", "b", "c", None, "zz", "é"]) if i > 60 else "b" for i in range(200)}
    texts = [" ".join("w" for _ in range(rng.randrange(400))) if i % 17 else None for i in range(200)]
    rows = mixing.taken(docs(spark, texts, sources)).collect()
    again = mixing.taken(docs(spark, texts, sources).repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == 200
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[sources[i]] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for s in order:
        own = [r for r in rows if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * want[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
        assert all(0 <= r.taken <= 3 * r.size and r.source_size == sizes[s] for r in own)


def test_mixing_edges(spark):
    assert mixing.taken(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.taken(docs(spark, [None, ""])).collect()] == [0, 0]
    twice = docs(spark, ["a b c"]).unionByName(docs(spark, ["a b c"]))
    rows = mixing.taken(twice).collect()
    assert len(rows) == 2 and sum(r.taken for r in rows) == 6
    long_ = mixing.taken(docs(spark, ["w " * 300_000, "a b"], {0: "x", 1: "y"})).collect()
    assert sorted((r.size, r.taken) for r in long_) == [(2, 6), (300_000, 299_996)]
    rows = docs(spark, ["a b", "c"]).withColumn("doc_id", F.lit(None).cast("bigint")).withColumns({c: F.lit(1) for c in ("rank", "size", "target", "k", "goal")})
    assert sorted(r.taken for r in mixing.taken(rows).collect()) == [1, 2]
    many = docs(spark, [f"a{i} b" for i in range(3000)]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert sorted(r.first_slot for r in mixing.taken(many).collect()) == sorted(i * 2 // 256 for i in range(3000))
    spread = mixing.sizes(many).select(F.substring("_own", 1, 2).alias("b")).groupBy("b").count().collect()
    assert len(spread) > 200 and max(r["count"] for r in spread) < 60  # rows without doc_id aren't one bucket
    pieces = mixing.mix(docs(spark, ["a b c", "d e"], {0: "x", 1: "y"})).collect()
    assert all(0 <= p["from"] < p["to"] for p in pieces)


def test_mixing_of_small_sources(spark):
    """Sources that are small against a block get their target to the word, and the pieces are the documents' words."""
    sources = {i: "a" if i < 3 else "b" if i < 6 else "c" for i in range(40)}
    texts = [" ".join("w" for _ in range(7 if i < 3 else 11 if i < 6 else 100 + i)) for i in range(40)]
    for block in (8, 500):
        rows = mixing.taken(docs(spark, texts, sources), block=block).collect()
        pieces = mixing.mix(docs(spark, texts, sources), block=block).collect()
        assert sum(r.taken for r in rows) == sum(r.size for r in rows)
        words, slots = Counter(), Counter()
        for r in rows:
            own = [p.slot for p in pieces if p.doc_id == r.doc_id]
            assert (r.pieces, r.first_slot, r.last_slot) == (len(own), min(own, default=None), max(own, default=None))
        for p in pieces:
            assert 0 <= p["from"] < p["to"] <= len(texts[p.doc_id].split()) and p["pass"] < 3
            words.update((p["pass"], p.doc_id, i) for i in range(p["from"], p["to"]))
            slots[p.slot] += p["to"] - p["from"]
        assert max(words.values()) == 1 and max(slots.values()) <= block
        for s in "abc":
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1
            assert sum(r.taken for r in own) == sum(p["to"] - p["from"] for p in pieces if p.source == s)


def test_schedule_is_even(spark):
    """Any stretch of the schedule is close to the targets, for few sources and many."""
    for n in (3, 700):
        goals = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(n)], "rank int, target double")
        rows = sorted((r.slot, r["rank"], r.k) for r in mixing.schedule(goals, 6000, 7).collect())
        assert [r[0] for r in rows] == list(range(6000))
        total, seen = sum(1 + i % 5 for i in range(n)), Counter()
        for at, (_, rank, k) in enumerate(rows):
            assert k == seen[rank]
            seen[rank] += 1
            if at % 1000 == 999:
                assert all(abs(seen[i] - (at + 1) * (1 + i % 5) / total) < 6 for i in range(n))


ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge_by_hand(texts, items):
    windows = {}
    for i, t in items:
        w = ITEM.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        w = ITEM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_by_hand(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["aa", "Bb", "c-c", "É", "7", "dd", "ee", "FF"])
    long_ = [" ".join(word() for _ in range(rng.randrange(13, 30))) for _ in range(12)]
    items = [(10 + i, t) for i, t in enumerate([*long_, "only four words here", "one", None, "", "--", long_[0]])]
    texts = [None, "", "!!", "one", "four words here", "x only FOUR words, here"]
    for _ in range(80):
        t = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            src = rng.choice(long_).split(" ")
            a = rng.randrange(len(src))
            t[len(t) // 2 : len(t) // 2] = src[a : a + rng.randrange(1, 30)]
        texts.append(" ".join(t))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    rows = decontamination.judge(docs(spark, texts), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == judge_by_hand(texts, items)


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.contaminated for r in decontamination.judge(docs(spark, ["a b"]), none).collect()] == [False]
    assert decontamination.judge(docs(spark, []), none).count() == 0


def test_decontamination_of_odd_rows(spark):
    """Documents without doc_id, repeated ones, and very long ones are judged by their own text."""
    item = " ".join(f"i{j}" for j in range(20))
    bench = spark.createDataFrame([(7, item), (7, item), (8, "two words"), (None, item)], "item_id bigint, text string")
    clean = " ".join(f"c{j}" for j in range(30))
    long_ = " ".join(f"l{j}" for j in range(30_000))
    rows = [(None, item), (None, clean), (None, None), (1, item), (1, clean), (1, item), (2, long_ + " " + item), (3, "two words"), (4, long_ * 2)]
    table = spark.createDataFrame([(i, t, 1, 2, 3, "h") for i, t in rows], "doc_id bigint, text string, _a int, _b int, n_words int, h string")
    out = decontamination.judge(table, bench)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out.collect())
    assert got == sorted([(0, 20, 20, 1, True), (0, 30, 0, 0, False), (0, 0, 0, 0, False), (1, 20, 20, 1, True), (1, 30, 0, 0, False), (1, 20, 20, 1, True), (2, 30_020, 20, 1, False), (3, 2, 2, 1, True), (4, 59_999, 0, 0, False)])
    left = decontamination.clean(table, bench)
    assert left.columns == table.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in left.collect()) == sorted((i or 0, len(t or "")) for i, t in rows if t in (clean, None) or i in (2, 4))


def test_winnowing_guarantee(spark):
    """Texts that share 13 words share a kept hash."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(13)]
    texts = [" ".join([f"x{rng.random()}"] * rng.randrange(9) + shared + [f"y{rng.random()}" for _ in range(rng.randrange(20))]) for _ in range(20)]
    prints = decontamination.fingerprints(docs(spark, texts), "doc_id").collect()
    first = set(prints[0].prints)
    assert all(first & set(p.prints) for p in prints)


def test_chat_edges(spark):
    schema = "pair_id bigint, turn int, role string, text string, extra int"
    chosen = spark.createDataFrame([(1, 0, "user", "q", 0), (1, 1, "assistant", "good", 0), (2, 0, None, None, 0), (3, 0, "user", "only", 0), (5, 1, "user", "b", 0), (5, 1, "user", "a", 0)], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "q", 9), (1, 1, "assistant", "bad", 9), (2, 0, None, None, 9), (4, 0, "assistant", "x", 9)], schema)
    out = {r.pair_id: r for r in chat.preference_pairs(chosen, rejected).collect()}
    assert out[1].n_common == 1 and out[1].prompt == "<|user|>\nq<|end|>\n"
    r = out[1].chosen_loss[0]
    assert out[1].chosen[r["from"] : r["to"]] == "good<|end|>\n" and out[1].rejected.endswith("bad<|end|>\n")
    assert out[2].n_common == 1 and out[2].chosen == "" == out[2].rejected and out[2].prompt == "<|unknown|>\n<|end|>\n"
    assert out[3].rejected == "" and out[3].chosen_loss == [] and out[4].chosen == ""
    assert out[5].chosen.index("a<") < out[5].chosen.index("b<")
    assert [out[i].degenerate for i in (1, 2, 3, 4)] == [False, True, True, True]
    null = lambda rows: spark.createDataFrame([(None, *r, 7) for r in rows], schema).withColumns({c: F.lit(1) for c in ("_c", "_r", "_key", "prompt", "n_common")})
    long_ = "x" * 500_000
    pair = chat.preference_pairs(null([(0, "user", "q"), (1, "assistant", long_)]), null([(0, "user", "q"), (1, "assistant", "b"), (1, "assistant", "b")])).collect()
    assert [(r.pair_id, r.n_common, r.degenerate, len(r.chosen)) for r in pair] == [(None, 1, False, 500_000 + len("<|assistant|>\n<|end|>\n"))]
    assert pair[0].rejected.count("b<") == 2
    empty = spark.createDataFrame([], schema)
    assert chat.preference_pairs(empty, empty).count() == 0


def test_last_turn_of_equal_numbers(spark):
    """One row is replaced, the last by turn, role and text, in whatever order rows come."""
    schema = "k bigint, turn int, role string, text string"
    rows = [(1, 0, "assistant", "B"), (1, 0, "assistant", "A"), (1, 1, "user", "q"), (1, 2, "assistant", "y"), (1, 2, "assistant", "z"), (1, 2, "user", "u"), (2, 0, "user", "only")]
    rows += [(3, None, "assistant", None), (3, 1, None, "x"), (3, 1, "assistant", "w"), (None, 1, "assistant", "n"), (None, 1, "assistant", "n")]
    want = [(None, 1, "assistant", "n"), (None, 1, "assistant", "n"), (1, 0, "assistant", "A"), (1, 0, "assistant", "B"), (1, 1, "user", "q"), (1, 2, "assistant", "A"), (1, 2, "assistant", "y")]
    want += [(3, None, "assistant", ""), (3, 1, "assistant", "")]
    for given in (rows, rows[::-1]):
        got = chat.last_replaced_by_first(spark.createDataFrame(given, schema), "k").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    long_ = spark.createDataFrame([(1, 0, "assistant", "x" * 500_000), (1, 1, "assistant", "y")], schema)
    assert sorted(len(r.text) for r in chat.last_replaced_by_first(long_, "k").collect()) == [500_000, 500_000]
    assert chat.last_replaced_by_first(long_.limit(0), "k").count() == 0
