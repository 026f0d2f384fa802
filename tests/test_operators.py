import random
import re
import shutil

from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import gates, graph, intervals, matching, patching, planning
from inkbed.plans import registry
from inkbed.sources import latex, records
from inkbed.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.clean_doi(F.lit("https://doi.org/10.1234/AB.c).,"))) == "10.1234/ab.c"
    assert one(spark, T.slug(F.lit("  "))) == "item"
    assert one(spark, T.title_key(F.lit("The Art & Science of X"))) == "art science x"
    assert one(spark, T.citation_keys(F.lit(r"\cite{a, b} \citep[see][p.~2]{b,c}"))) == ["a", "b", "c"]
    assert one(spark, T.citation_normal(F.lit(r"x \citet{ k1 , k2}"))) == "k1,k2"
    assert one(spark, T.strip_comments(F.lit("a 5\\% b % c\nd"))) == "a 5\\% b \nd"
    assert one(spark, T.numbers(F.lit("1,000 and 2{.}5 or 7"))) == ["1000", "2.5", "7"]
    assert one(spark, T.fenced_json(F.lit("x ```json\n{\"a\": 1}\n``` y"))) == '{"a": 1}'
    assert one(spark, T.is_blank(F.lit(" TBD "))) and one(spark, T.is_blank(F.lit(None).cast("string")))
    assert one(spark, T.acronyms(F.lit("WP1 NASA and ESA NASA"), ("ESA",))) == ["NASA"]
    assert one(spark, T.inverted_index_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"
    assert one(spark, T.bibliography_keys(F.lit("@article{k1, title={x}}\n @book{k2,"))) == ["k1", "k2"]
    assert one(spark, T.sentences(F.lit("A b. C! D"))) == ["A b.", "C!", "D"]
    assert one(spark, F.concat_ws("", T.chapters(F.lit("x\\section{a}y\\chapter{b}z")))) == "x\\section{a}y\\chapter{b}z"
    assert one(spark, T.strip_math(F.lit("a $x$ b \\[ y \\] c"))).split() == ["a", "b", "c"]
    assert one(spark, T.safe_stem(F.lit("A b/C"))) == "a_b_c"
    assert one(spark, T.prose_word_count(F.lit("\\emph{two words} $x+y$"))) == 2
    assert one(spark, T.equation_normal(F.lit("a %c\n  b"))) == "a b"


def test_prose_by_hand(spark):
    cases = {
        "a \\emph{b \\textbf{c \\mbox{d \\texttt{e}}}} f": "a b c d e f",
        "\\begin{align*}x\\end{align*} \\[y\n\\]$$z$$ $u$ \\(v\\) w": "MATHDISP MATHDISP MATHDISP w",
        "see \\citep [p.~2]{k, l} and \\cite{m}\\label{x}, \\ref{y}~z": "see CITEMARK and CITEMARK , z",
        "\\footnote{not {read} on} \\item {but} this \\small and\\includegraphics[w=1]{f}": "but this and",
        "5\\% of $5 and \\[ never \\begin{equation} closed": "5\\% of $5 and \\[ never closed",
        "$$": "", "": "", "\\": "\\", "{{}": "", "a\u00e9\n\nb": "a\u00e9 b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: " ".join(r.y.split()) for r in rows.select("x", T.prose(F.col("x")).alias("y")).collect()} == cases
    long_ = "\\emph{" * 200 + "x" + "}" * 200 + " y {" * 20_000 + "\\cite{k}" * 5_000
    got = one(spark, T.prose(F.lit(long_))).split()
    assert got[0] == "x" and got.count("y") == 20_000 and got.count("CITEMARK") == 5_000
    assert one(spark, T.prose(F.lit(None).cast("string"))) is None


def test_scanner_tiles_any_text():
    rng = random.Random(3)
    parts = ["word ", "\n\n", "% c\n", "\\%", "$x$", "$$y$$", "\\[z\\]", "\\section{A {b}}", "\\begin{equation}e\\label{q}\\end{equation}", "\\begin{odd}", "\\end{odd}", "{", "}", "\\cite{k}", "é"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        found = latex.regions(text)
        assert "".join(text[a:b] for a, b, _ in found) == text
        assert all(x[1] == y[0] for x, y in zip(found, found[1:], strict=False))


def test_align_rows():
    assert latex.align_rows(r"a\label{x}\\b\label{y}") == [r"a\label{x}", r"b\label{y}"]
    assert latex.align_rows(r"a\\b\label{y}") == [r"a\\b\label{y}"]
    assert latex.align_rows(r"a{\\}\label{x}\\b\label{y}") == [r"a{\\}\label{x}", r"b\label{y}"]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    a = [(k, i, s := rng.randrange(500), s + rng.randrange(1, 60)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(a, "k int, i int, start int, end int")
    got = {tuple(r) for r in intervals.overlaps(df, df.withColumnRenamed("i", "j"), "k", 16, "i", "j").filter("i < j").collect()}
    want = {(k, i, j, max(s, t), min(e, f)) for k, i, s, e in a for m, j, t, f in a if k == m and i < j and s < f and t < e}
    assert got == want


def test_coverage_and_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 8, 12), (1, 20, 20)], "k int, start int, end int")
    found = {(r.problem, r.at) for r in intervals.coverage_violations(df, "k", spark.createDataFrame([(1, 30), (2, 4)], "k int, size int")).collect()}
    assert found == {("overlap", 8), ("empty", 20), ("trailing", 20), ("trailing", 0)}
    assert intervals.merged_length(df, "k").first()["covered"] == 12


def test_graph(spark):
    nodes = spark.createDataFrame([(0, x) for x in range(6)] + [(1, 0), (1, 1)], "graph bigint, node bigint")
    edges = spark.createDataFrame([(0, 0, 5), (0, 1, 0), (0, 3, 9), (1, 0, 1), (1, 1, 0)], "graph bigint, dependent bigint, prerequisite bigint")
    got = {(r.node, r.position) for r in graph.topological_order(nodes, edges).collect() if r.graph == 0}
    assert got == {(2, 0), (3, 1), (4, 2), (5, 3), (0, 4), (1, 5)}
    assert [r.path for r in graph.cycles(edges).collect()] == ["0->1->0"]
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a bigint, b bigint")
    assert {r.component for r in graph.label_components(links).collect()} == {0, 30}


def test_components_of_a_shuffled_path(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint")
    rows = graph.label_components(links).collect()
    assert len(rows) == 1000 and {r.component for r in rows} == {0}


def test_levels_of_a_deep_chain(spark):
    nodes = spark.createDataFrame([(0, x) for x in range(67)], "graph bigint, node bigint")
    chain = spark.createDataFrame([(0, x, x - 1) for x in range(1, 67)] + [(0, 66, 0)], "graph bigint, dependent bigint, prerequisite bigint")
    assert {(r.node, r.level) for r in graph.levels(nodes, chain).collect()} == {(x, x) for x in range(67)}


def test_levels_with_cycles(spark):
    """A cycle and what needs it have none; prerequisites that no root leads to don't count."""
    nodes = spark.createDataFrame([(0, x) for x in range(5)], "graph bigint, node bigint")
    edges = [(0, 1, 0), (0, 1, 2), (0, 2, 1), (0, 3, 2), (0, 4, 0), (0, 4, 99)]
    rows = graph.levels(nodes, spark.createDataFrame(edges, "graph bigint, dependent bigint, prerequisite bigint")).collect()
    assert {(r.node, r.level) for r in rows} == {(0, 0), (4, 1)}


def test_span_components_by_hand(spark, sf_dir, tmp_path):
    """All of lineitem, and a fixture of several components."""
    for lines in (spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.createDataFrame([(1, 2), (900, 2), (900, 3), (7, 3), (500, 4), (501, 4), (600, 5)], "l_orderkey bigint, l_partkey bigint")):
        path = f"{tmp_path}/{len(lines.columns)}"
        lines.write.parquet(f"{path}/lineitem.parquet")
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r in lines.select("l_orderkey", "l_partkey").collect():
            one, other = find((1, r.l_partkey)), find((0, r.l_orderkey))
            root[max(one, other)] = min(one, other)  # orders sort before parts
        want = {x[1]: find(x)[1] for x in root if not x[0]}
        got = registry.QUERIES["span_components"](spark, path).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_includes_to_any_depth(spark):
    """A chain of 12 files with a file that includes the first again."""
    files = spark.createDataFrame([(f"f{i}",) for i in range(12)], "path string")
    includes = spark.createDataFrame([(f"f{i}", 0, f"f{(i + 1) % 12}") for i in range(12)] + [("f2", 1, "none")], "path string, place bigint, target string")
    rows = planning.expand_includes(files, includes, "f0").collect()
    assert sorted((r.depth, r.path, r.ordinal) for r in rows) == [(i, f"f{i}", "/000000" * i) for i in range(12)]


def test_matching(spark):
    a = spark.createDataFrame([(1, 1, 0), (1, 2, 10)], "k int, id bigint, at bigint")
    b = spark.createDataFrame([(1, 7, 9), (1, 8, 500)], "k int, id bigint, at bigint")
    assert [(r.a_id, r.b_id) for r in matching.nearest_greedy(a, b, ["k"], 100).collect()] == [(1, 7)]
    pairs = spark.createDataFrame([("a", "One. Two.", "One. New! Two.")], "key string, old string, new string")
    assert [r.sentence for r in matching.added_sentences(pairs).collect()] == ["New!"]


def test_patches(spark):
    status, text = patching.unique_replace(F.lit("aXbX"), F.lit("X"), F.lit("Y"))
    assert (one(spark, status), one(spark, text)) == ("ambiguous", "aXbX")


def test_gates_fail_closed(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, None)], "id int, state string")
    assert [r.locator for r in gates.violations(rows, ~F.col("state").isin("ok"), "c", "id", F.lit("")).collect()] == ["2"]
    assert rows.filter(gates.allowed(F.col("state"), ("ok",))).count() == 1


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('title,doi\n"A, ""b""",10.1/x\n')
    (tmp_path / "in/a.csv.meta.json").write_text('{"database": "D1"}')
    (tmp_path / "in/b.json").write_text('{"records": [{"title": "T", "doi": null}]}')
    (tmp_path / "in/b.meta.json").write_text('{"database": "D2"}')
    got = {(r.file, r.title, r.database) for r in records.imports(spark, str(tmp_path / "in"), ["title", "doi"]).collect()}
    assert got == {("a.csv", 'A, "b"', "D1"), ("b.json", "T", "D2")}
    records.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"), ["a", "b", "c"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).fillna("").collect()] == [("1", "", "")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    lines = records.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted((r.a or 0, r._corrupt or "") for r in lines) == [(0, "broken"), (1, "")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.tex").write_text("x")
    files = records.text_tree(spark, str(tmp_path / "t"))
    assert records.snapshot_hash(files).first()[0] == files.first()["sha256"]
    assert records.manifest(spark, str(tmp_path / "t")).first()["bytes"] == 1


def test_bibtex_and_html():
    entries = records.bibtex_entries('@article{k1, title={A {B} c}, year=2020, note="arXiv:2001.01234"}\n@book{k2, author = "X",}')
    assert entries[0]["title"] == "A {B} c" and entries[0]["eprint"] == "2001.01234" and entries[1]["author"] == "X"
    assert records.html_items('<ul><li>A. Bee (2001): <a href="/x">Title</a></li><li>none</li></ul>') == [("/x", "Title", "A. Bee", "2001")]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    (tmp_path / "events").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events")
    stream = E.read_events(spark, str(tmp_path / "events"))
    q = E.tumbling(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = E.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]
    assert spark.table("tumbling").count() == batch.count()


def test_other_streams_equal_batch(spark, sf_dir, tmp_path):
    """Sliding windows, sessions and deduplication over a folder of two files that overlap."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "events")
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(folder)
    events.filter("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(folder)
    read = lambda: E.read_events(spark, folder, 1)
    batch = spark.read.parquet(folder)
    late = "3650 days"

    def run(rows, name, mode):
        q = rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(E.sliding(read(), late=late), "sliding", "complete").agg(F.count("*"), F.sum("n")).first() == E.sliding(batch).agg(F.count("*"), F.sum("n")).first()
    assert run(E.user_sessions(read(), late=late), "sessions", "complete").agg(F.count("*"), F.sum("n")).first() == E.user_sessions(batch).agg(F.count("*"), F.sum("n")).first()
    assert run(E.deduplicated(read(), late=late), "once", "append").count() == E.deduplicated(batch).count() < batch.count()


def test_queries_without_sql_by_hand(spark, sf_dir):
    """On the tables: greedy matches, packed units, split trees and list items."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id", "event_type", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) / 1000 AS BIGINT) AS at").collect()
    want = set()
    for user in {r.user_id for r in events}:
        of = lambda kind: sorted((r.at, r.event_id) for r in events if r.user_id == user and r.event_type == kind)  # noqa: B023, E731
        free = of("view")
        for at, i in of("click"):
            best = min(((abs(a - at), a, j) for a, j in free), default=None)
            if best and best[0] < 600_000:
                want.add((user, i, best[2], best[0]))
                free.remove(best[1:])
    assert {tuple(r) for r in registry.QUERIES["nearest_match"](spark, sf_dir).collect()} == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    units, leaves = set(), {}
    for i, text in texts.items():
        unit, total = 0, 0
        lines = (text or "").split("\n")
        for n, line in enumerate(lines):
            words = len(re.findall("[^ \n]+", line))
            if total and int((total + words) * 1.5) > 200:
                unit, total = unit + 1, 0
            total += words
            units.add((str(i), unit, n, n, words))
        sizes = [len(x) + (n < len(lines) - 1) for n, x in enumerate(lines)]

        def split(part, leaf, depth, i=i, sizes=sizes):
            if depth == 3 or len(part) == 1 or sum(sizes[n] for n in part) <= 1500:
                leaves[(i, leaf)] = (len(part), sum(sizes[n] for n in part))
                return
            for half in (0, 1):
                split([n for at, n in enumerate(part) if at * 2 // len(part) == half], f"{leaf}{half}", depth + 1)

        split(list(range(len(lines))), "", 0)
    assert {tuple(r) for r in registry.QUERIES["unit_binpack"](spark, sf_dir).collect()} == units
    assert {(r.doc_id, r.leaf): (r["lines"], r.chars) for r in registry.QUERIES["split_tree_leaves"](spark, sf_dir).collect()} == leaves
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    items = sorted((p.page_id, u, t) for p in pages for u, t in re.findall(r'<li><a href="([^"]*)">([^<]+)</a></li>', p.html or ""))
    assert sorted((r.page_id, r.url, r.title) for r in registry.QUERIES["html_list_items"](spark, sf_dir).collect()) == items
