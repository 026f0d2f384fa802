"""The state machine over a stream, table functions, split files, the anchored diff."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from inkbed.operators import matching
from inkbed.plans import registry
from inkbed.sources import latex, records
from inkbed.streaming import repairs

SCHEMA = "session string, cycle bigint, outcome string, signature string, ts timestamp"


def at(seconds):
    return datetime.datetime.fromtimestamp(1_700_000_000 + seconds)


def run(spark, folder, loads, **limits):
    for load in loads:
        spark.createDataFrame(load, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    progress = repairs.replay(spark, f"{folder}/in", SCHEMA, f"{folder}/out", f"{folder}/state", files_per_trigger=1, **limits)
    return sorted(map(tuple, spark.read.schema(repairs.OUT).parquet(f"{folder}/out").collect())), progress


def test_walk():
    cycles = lambda *xs: [(i, *x) for i, x in enumerate(xs)]
    assert repairs.walk(cycles(("failed", "a"), ("converged", None), ("failed", "b")), 5) == ("converged", 2, 1)
    assert repairs.walk(cycles(("failed", "a"), ("failed", "b"), ("failed", "a")), 5) == ("oscillating", 3, 0)
    assert repairs.walk(cycles(("failed", None), ("failed", None), ("failed", None)), 2) == ("timeout", 2, 1)
    assert repairs.walk(cycles(("failed", "a")), 2) == ("unresolvable", 1, 0)


def test_stream_equals_batch_in_any_arrival(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{i}", c, rng.choice(["failed"] * 6 + ["converged", None]), rng.choice(["a", "b", "c", "d", "e", None]), at(rng.randrange(100))) for i in range(40) for c in range(rng.randrange(1, 8))]
    rows += [(*r[:2], "failed", "z", r[4]) for r in rows[::9]] + [(None, 1, "failed", "a", at(1)), ("none", None, "failed", "a", at(1))]
    rng.shuffle(rows)
    found, _ = run(spark, tmp_path, [rows[:90], rows[90:], [(None, None, None, None, at(10_000))]], most=5, gap=100, late=200)
    want = repairs.repair_batch(spark.createDataFrame(rows, SCHEMA), 5)
    assert found == sorted(map(tuple, want.select("session", "outcome", "cycles", "ignored").collect())) and len(found) == 40


def test_late_rows_are_counted_and_change_no_verdict(spark, tmp_path):
    first = [("a", 1, "failed", "x", at(0)), ("b", 1, "failed", "x", at(500))]
    second = [("b", 2, "converged", None, at(510))]  # moves nothing of a; a is closed by the watermark of the first load
    third = [("a", 2, "converged", None, at(505)), ("a", 3, "failed", None, at(506)), ("b", 3, "failed", "q", at(2))]
    found, progress = run(spark, tmp_path, [first, second, third, [(None, None, None, None, at(9_000))]], most=5, gap=10, late=20)
    assert found == [("a", "late", 0, 2), ("a", "unresolvable", 1, 0), ("b", "converged", 2, 0)]
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1


def test_table_functions(spark):
    latex.register_table_functions(spark)
    files = spark.createDataFrame([(1, "\\section{A}\n\nText \\cite{k} \\label{l}."), (2, None), (3, "")], "doc_id int, tex string")
    files.createOrReplaceTempView("mechanism_files")
    same = spark.sql("SELECT f.doc_id, r.* FROM mechanism_files f, LATERAL latex_regions(f.tex) r")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, latex.partition(files).collect()))
    only = spark.sql("SELECT f.doc_id, o.raw FROM mechanism_files f, LATERAL latex_objects(f.tex, 'label') o")
    assert list(map(tuple, only.collect())) == [(1, "\\label{l}")]
    assert spark.sql("SELECT * FROM mechanism_files f, LATERAL latex_abstentions(f.tex) a").count() == 0
    with pytest.raises(Exception, match="string"):
        spark.sql("SELECT * FROM latex_regions(5)").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT r.* FROM mechanism_files f, LATERAL latex_regions(f.tex, f.tex) r").collect()


def test_large_bibtex_file_is_split(spark, tmp_path):
    entries = "".join(f"@article{{k{i},\n title = {{T {i} {'x' * (i % 90)} a@b}},\n year = {1990 + i % 9}\n}}\n" for i in range(3000))
    (tmp_path / "one.bib").write_text("% a comment\n" + entries)
    (tmp_path / "two.bib").write_text("@misc{m, title={M}} @misc{n, title={N}}")
    conf = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = records.bibtex_files(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        found = rows.select("key", "title").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == sorted([(f"k{i}", f"T {i} {'x' * (i % 90)} a@b".replace("  ", " ")) for i in range(3000)] + [("m", "M"), ("n", "N")])


def test_export_is_sorted_and_has_a_sidecar(spark, tmp_path):
    rows = [("Zeta writing", "B", "2001"), ("The alpha, \"essay\"", "A", "2001"), ("Writing early", None, "1999"), ("Other", "C", "1990"), (None, "D", "1990")]
    entries = spark.createDataFrame([("k", "x", t, a, y, "", "", "") for t, a, y in rows], ", ".join(f"{c} string" for c in ("kind", "key", "title", "author", "year", "doi", "eprint", "url")))
    a = records.export_bibliography(entries, f"{tmp_path}/a", "D", "s").first()
    text = [line for p in sorted((tmp_path / "a").glob("part*")) for line in p.read_text().splitlines() if not line.startswith("title,")]
    assert [line.split(",")[0].strip('"') for line in text] == ["Writing early", "The alpha", "Zeta writing"] and a.record_count == 3
    again = records.export_bibliography(entries.repartition(5), f"{tmp_path}/b", "D", "s").first()
    other = records.export_bibliography(entries.withColumn("doi", F.lit("10.1/x")), f"{tmp_path}/c", "D", "s").first()
    assert again.rows_sha256 == a.rows_sha256 != other.rows_sha256
    assert records.export_bibliography(entries.filter("false"), f"{tmp_path}/d", "D", "s").first().record_count == 0


def longest_common(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if a == b else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def test_anchored_diff():
    rng = random.Random(7)
    for n in range(300):
        x = [str(v) for v in rng.sample(range(30), rng.randrange(20))]
        y = [str(v) for v in rng.sample(range(30), rng.randrange(20))]
        if n % 3 == 0:  # repeated sentences
            x, y = [v[-1] for v in x], [v[-1] for v in y]
        stay = matching.kept_sentences(x, y)
        assert all(x[i] == y[j] for i, j in stay) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(stay, stay[1:]))
        most = longest_common(x, y)
        assert len(stay) <= most and (n % 3 == 0 or len(stay) == most)
        assert matching.kept_sentences(x, x) == [(i, i) for i in range(len(x))]
    long_ = [str(i) for i in range(200_000)]
    assert len(matching.kept_sentences(long_, ["new", *long_[::2], "end"])) == 100_000
    assert len(matching.kept_sentences(["a", "b"] * 50_000, ["c", *["a", "b"] * 40_000])) == 80_000


def test_added_sentences_of_the_table(spark, sf_dir):
    import re

    found = {}
    for r in registry.QUERIES["added_sentences"](spark, sf_dir).collect():
        found.setdefault(r.key, {})[r.pos] = r.sentence
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    for conv, rows in turns.items():
        rows.sort()
        for (_, old), (turn, new) in zip(rows, rows[2:]):
            if old is None:
                continue
            x, y = ([s for s in re.split(r"(?<=[.!?])\s+", t or "") if s] for t in (old, new))
            added = found.get(f"{conv}:{turn}", {})
            assert all(y[p] == s for p, s in added.items())
            if len(set(x)) == len(x) and len(set(y)) == len(y):
                assert len(y) - len(added) == longest_common(x, y)
