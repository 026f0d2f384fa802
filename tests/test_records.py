"""Sources, sinks, the scanner, matching and record checks, by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkbed.operators import audit, bundles, graph, matching, release, responses, segment
from inkbed.sources import apis, latex, records


def kinds(text):
    found = latex.regions(text)
    assert [a for a, _, _ in found] == [0, *[b for _, b, _ in found][:-1]] and found[-1][1] == len(text)
    return [(k, text[a:b]) for a, b, k in found]


def test_scanner_environments():
    nested = "\\begin{tabular}{c}\\begin{tabular}{c}x\\end{tabular}\\end{tabular}"
    assert kinds(f"a\n\n{nested}\n") == [("prose", "a"), ("whitespace", "\n\n"), ("float", nested), ("whitespace", "\n")]
    code = "\\begin{verbatim}\n50% $ \\section{no}\n\\end{verbatim}"
    assert kinds(code) == [("float", code)]
    for name, kind in (("alignat*", "math"), ("flalign", "math"), ("split", "math"), ("lstlisting", "float"), ("tikzpicture", "float"), ("algorithm", "float")):
        whole = f"\\begin{{{name}}}x\\end{{{name}}}"
        assert kinds(whole) == [(kind, whole)]
    assert ("heading", "\\subparagraph{x}") in kinds("\\subparagraph{x} y")


def test_scanner_commands():
    for name in latex.COMMANDS:
        assert kinds(f"\\{name}[o]{{a {{b}}}}{{c}} d") == [("command", f"\\{name}[o]{{a {{b}}}}{{c}}"), ("prose", " d")]
        assert kinds(f"\\{name}zz{{a}} d") == [("prose", f"\\{name}zz{{a}} d")]
    for name in latex.BIBLIOGRAPHY_COMMANDS:
        assert kinds(f"\\{name}{{a}}\n\nd") == [("bibliography", f"\\{name}{{a}}"), ("whitespace", "\n\n"), ("prose", "d")]
    assert kinds("\\newcommand*{\\x}[2]{#1 {#2}}\n\\input{a") == [("command", "\\newcommand*{\\x}[2]{#1 {#2}}"), ("whitespace", "\n"), ("command", "\\input"), ("prose", "{a")]
    assert kinds("as \\emph{one} and \\citep{k} say") == [("prose", "as \\emph{one} and \\citep{k} say")]


def test_scanner_of_what_is_never_closed():
    text = "pay $5 now\n% note\n\\section{S}\nend"
    assert [k for k, _ in kinds(text)] == ["prose", "comment", "heading", "prose"]
    assert [x[1:] for x in latex.unclosed(text)] == [("$", "mathematics is never closed")]
    text = "\\begin{align} x\n\\section{S}"
    assert [k for k, _ in kinds(text)] == ["command", "prose", "heading"]
    assert latex.unclosed(text) == [(0, "\\begin{align}", "environment is never closed")]
    assert [k for k, _ in kinds("a \\[ b\n\\section{S}")] == ["prose", "heading"]
    assert latex.unclosed("50\\% of $x$ and $$y$$ \\[z\\]") == [] and kinds("50\\% of") == [("prose", "50\\% of")]
    assert kinds("% \\begin{equation}\n") == [("comment", "% \\begin{equation}\n")]


def test_abstentions_and_manifest(spark):
    files = spark.createDataFrame([(1, "\\begin{align}x", 0), (2, None, 0), (3, "a\n\\label{k} \\cite{q} \\cite{ q}\n\\label{k}", 0)], "doc_id bigint, tex string, start int")
    assert [(r.doc_id, r.construct) for r in latex.abstentions(files).collect()] == [(1, "\\begin{align}")]
    rows = sorted((r.start, r.object_type, r.line, r.normal, r.occurrences) for r in latex.object_manifest(files.filter("doc_id = 3")).collect())
    assert rows == [(2, "label", 2, "\\label{k}", 2), (12, "citation", 2, "q", 1), (21, "citation", 2, "q", 1), (31, "label", 3, "\\label{k}", 2)]


def test_imports_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,doi\nOne,10.1/a\n"Two, too",\n')
    (tmp_path / "b.csv").write_text("doi,title\n10.1/b,Three\n")
    (tmp_path / "c.bib").write_text('@article{k, title={Four {x}}, doi="10.1/c"}\n')
    (tmp_path / "d.json").write_text('{"records": [{"title": "Five"}, "Six"]}')
    (tmp_path / "broken.json").write_text("[{")
    (tmp_path / "screening_review.csv").write_text("title\nno\n")
    (tmp_path / "a.csv.meta.json").write_text(json.dumps({"database": "D1", "source_url": "u", "retrieved_at": "t", "query": "q"}))
    (tmp_path / "a.meta.json").write_text('{"database": "other"}')
    (tmp_path / "d.meta.json").write_text(json.dumps({"database": "D2", "sha256": "no"}))
    got = sorted((r.file, r.title, r.doi, r.database) for r in records.imports(spark, str(tmp_path), ["title", "doi"]).fillna("").collect())
    assert got == [("a.csv", "One", "10.1/a", "D1"), ("a.csv", "Two, too", "", "D1"), ("b.csv", "Three", "10.1/b", ""), ("c.bib", "Four {x}", "10.1/c", ""), ("d.json", "Five", "", "D2"), ("d.json", "Six", "", "D2")]
    ledger = {r.file: (r.status, r.records, r.provenance_complete) for r in records.import_ledger(spark, str(tmp_path)).collect()}
    assert ledger == {"a.csv": ("imported", 2, True), "b.csv": ("imported", 1, False), "c.bib": ("imported", 1, False), "d.json": ("imported-provenance-incomplete", 2, False), "broken.json": ("parse-error", 0, False)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log, table, parts = (str(tmp_path / x) for x in ("log", "table", "parts"))
    records.append_log(rows, log)
    records.append_log(rows.limit(1), log)
    assert spark.read.json(log).count() == 3
    records.replace(rows, table, ".old")
    records.replace(rows.filter("k = 1"), table, ".old")
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(table + ".old").count() == 2
    with pytest.raises(FileExistsError):
        records.replace(rows, table, ".old")
    records.save(rows, parts, "k")
    records.save(spark.createDataFrame([(2, "c")], "k int, v string"), parts, "k")
    assert sorted((r.k, r.v) for r in records.load(spark, parts).collect()) == [(1, "a"), (2, "c")]
    assert records.report(rows.withColumn("v", F.lit("x|y")), "T", ["k", "v"]) == "# T\n\n| k | v |\n| --- | --- |\n| 1 | x\\|y |\n| 2 | x\\|y |\n"
    files = spark.createDataFrame([("/x/a.json",), ("/x/b.txt",)], "path string")
    assert [r.path for r in records.publishable(files, ("a.json",)).collect()] == ["/x/a.json"]


def test_occurrences_with_lines(spark):
    texts = spark.createDataFrame([(1, "x=1\ny\nx=1\nx=1"), (2, None)], "doc_id bigint, text string")
    rows = [(1, "a", "x=1", 3), (1, "b", "x=1", 3), (1, "c", "x=1", None), (1, "d", "x=1", 9), (1, "e", "", 1), (2, "f", "x", None)]
    objects = spark.createDataFrame(rows, "doc_id bigint, id string, raw string, line int")
    got = {r.id: (r.start, r.end) for r in audit.map_occurrences(texts, objects, "doc_id").collect()}
    # c has no line and comes first; a takes the third line's, b the last one before it that is free, else the first free one
    assert got["c"] == (0, 3) and got["a"] == (6, 9) and got["b"] == (10, 13) and got["d"] == (None, None) and got["e"] == (None, None) and got["f"] == (None, None)


def test_matches_have_places(spark):
    text = "\\cite{a} b \\cite{a}\\label{x}"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "key bigint, t string")
    got = [(r.key, r.raw, r.start) for r in segment.matches(rows, "key", "t", "\\\\(?:cite|label)\\{[^}]*\\}").orderBy("start").collect()]
    assert got == [(1, "\\cite{a}", 0), (1, "\\cite{a}", 11), (1, "\\label{x}", 19)]


def test_correspondence_takes_the_nearest(spark):
    schema = "key bigint, object_type string, normal string, raw string, start bigint"
    a = spark.createDataFrame([(1, "label", "a", "a", 0), (1, "label", "b", "b", 500), (1, "label", "c", "c", 5000), (1, "label", "same", "s", 10)], schema)
    b = spark.createDataFrame([(1, "label", "x", "x", 490), (1, "label", "y", "y", 900), (1, "label", "same", "s ", 30), (1, "label", "far", "z", 9000)], schema)
    got = sorted((r.status, r.a_start if r.a_start is not None else -1, r.b_start if r.b_start is not None else -1) for r in matching.correspondence(a, b).collect())
    assert got == [("added", -1, 9000), ("explained_change", 10, 30), ("removed", 5000, -1), ("substantive_change", 0, 490), ("substantive_change", 500, 900)]
    assert matching.resolved(matching.correspondence(a, b), 0.8).filter("status = 'unresolved'").count() == 2


def test_token_jaccard_by_hand(spark):
    rng = random.Random(3)
    sets = [sorted({f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(12))}) for _ in range(80)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id bigint, tokens array<string>")
    for least in (0.3, 0.5, 0.72, 1.0):
        got = {(r.a, r.b) for r in matching.token_jaccard(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), "a", "b", least).collect()}
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert got == want


def test_cyclic_nodes(spark):
    chain = [(i, i + 1) for i in range(30)]
    edges = spark.createDataFrame([*chain, (5, 3), (40, 40), (None, 1)], "a bigint, b bigint")
    assert {r.node for r in graph.cyclic_nodes(edges, "a", "b").collect()} == {3, 4, 5, 40}
    assert graph.cyclic_nodes(edges.limit(0), "a", "b").count() == 0


def test_gates_fail_closed(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    releases = spark.createDataFrame([("r",)], "release string")
    empty = none("release string, hash string")
    out = release.correspondence(releases, none("release string, manifest_hash string, current_hash string, agreement double"), empty, none("release string, draft string"), empty, none("release string, hash string, approved boolean"), none("release string, assembly string, vs_source double, vs_drafts double"))
    assert [r.reason for r in out.collect()] == ["missing_source_manifest"]
    assert [r.reason for r in release.preflight(releases, none("release string, preflight_id string, findings int, status string, exit_code int")).collect()] == ["no_preflight_run"]
    assert [r.reason for r in release.gaps(releases, none("release string, json string")).collect()] == ["gap_record_missing"]
    assert [r.reason for r in release.transmissions(releases, none("release string, authorized_by string"), none("release string, mode string")).collect()] == [None]
    assert [r.passed for r in audit.all_hold(none("x int"), F.lit(True), "g").collect()] == [False]
    manifests = spark.createDataFrame([("r", "h", "h", None)], "release string, manifest_hash string, current_hash string, agreement double")
    out = release.correspondence(releases, manifests, empty, none("release string, draft string"), empty, none("release string, hash string, approved boolean"), none("release string, assembly string, vs_source double, vs_drafts double"))
    assert [r.reason for r in out.collect()] == ["low_parser_agreement"]


def test_answers_and_sources_of_odd_rows(spark):
    rows = spark.createDataFrame([("w", None, None), ("e", None, "[]")], "window_id string, abstention string, text string")
    assert [(r.window_id, r.abstention) for r in responses.parse_concepts(rows).collect()] == [("w", "invalid_json")]
    answers = spark.createDataFrame([("q", "m", None), ("q", "m", "{}"), ("q", "m", '{"results": null}')], "query string, search_mode string, payload string")
    assert apis.openalex(answers).count() == 0 and apis.crossref(answers).count() == 0
    assert sorted(r.status for r in apis.events(answers, "results").collect()) == ["http-200", "http-200", "not-run-offline"]
    assert bundles.validate(spark.createDataFrame([("k", None)], "key string, json string"), "SourceSpan").collect()[0].reason == "malformed"
