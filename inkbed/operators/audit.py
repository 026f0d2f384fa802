"""A systematic review's gates, input validation and integrity; term counts; occurrences of objects in texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readiness import blockers, union

#: What counts as decided, inspected, appraised and pinned.
DECISIONS, APPRAISED, PINNED = ("include", "exclude", "uncertain"), ("completed-low-concern", "completed-some-concerns"), ("vendored-commit", "vendored-manifest-pin", "remote-only")


def all_hold(rows: DataFrame, when: Column, gate: str, empty: bool = False) -> DataFrame:
    """One row: gate, n (rows), good, passed: all rows hold, and there are some (unless none are needed); null doesn't hold."""
    good = F.count_if(F.coalesce(when, F.lit(False)))
    return rows.agg(F.lit(gate).alias("gate"), F.count("*").alias("n"), good.alias("good")).withColumn("passed", (F.col("n") == F.col("good")) & ((F.col("n") > 0) | F.lit(empty)))


def at_least(rows: DataFrame, least: float, value: Column, gate: str) -> DataFrame:
    """One row: a rate over all rows that has to reach a target; no row does not."""
    rate = F.avg(F.coalesce(value, F.lit(False)).cast("double"))
    return rows.agg(F.lit(gate).alias("gate"), F.count("*").alias("n"), F.count_if(F.coalesce(value, F.lit(False))).alias("good"), F.coalesce(rate >= least, F.lit(False)).alias("passed"))


def screening_done(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """V-16: every selected row has two decisions and an adjudication; an exclusion has a known code."""
    known = codes.select(F.col("code").alias("_code")).distinct()
    met = rows.filter("selected").join(known, F.col("exclusion_code") == F.col("_code"), "left")
    ok = F.col("reviewer_1").isin(*DECISIONS) & F.col("reviewer_2").isin(*DECISIONS) & F.col("adjudication").isin("include", "exclude") & ((F.col("adjudication") != "exclude") | F.col("_code").isNotNull())
    return all_hold(met, ok, "manual-independent-screening")


def evidence_gates(rows: DataFrame) -> DataFrame:
    """V-16: full text, appraisal and identity of load-bearing evidence (load_bearing, empirical, inspection, verification, appraisal, anchor,
    limitations, doi, identity)."""
    loaded = rows.filter("load_bearing")
    empirical = loaded.filter("empirical")
    text = F.lower("inspection")
    full = (F.contains(text, F.lit("full text")) | F.contains(text, F.lit("full local source"))) & (F.col("verification") == "verified")
    fair = F.col("appraisal").isin(*APPRAISED) & (F.coalesce("anchor", F.lit("")) != "") & (F.coalesce("limitations", F.lit("")) != "")
    return union([
        all_hold(empirical, full, "full-text-load-bearing-evidence"),
        all_hold(empirical, fair, "critical-appraisal"),
        all_hold(loaded.filter("coalesce(doi, '') != ''"), F.col("identity") == "verified", "bibliographic-identity"),
    ])


def input_errors(evidence: DataFrame, questions: DataFrame, links: DataFrame, required: list[str]) -> DataFrame:
    """V-17: evidence (id and the required fields, doi) with empty fields, ids that are empty or repeated, bad DOIs; links (id, question) to unknown
    questions, and evidence without any."""
    own, parts = F.col("id"), []
    for field in required:
        parts.append(blockers(evidence, F.coalesce(F.col(field).cast("string"), F.lit("")) == "", "input", own, F.lit(f"missing {field}")))
    parts.append(blockers(evidence, F.trim(F.coalesce("id", F.lit(""))) == "", "input", F.lit("?"), F.lit("empty id")))
    many = evidence.filter("coalesce(id, '') != ''").groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    parts.append(blockers(many, F.lit(True), "input", own, F.lit("duplicate id")))
    bad = (F.coalesce("doi", F.lit("")) != "") & ~F.lower("doi").rlike("^10[.][0-9]{4,9}/[^ \\t\\n\\r]+$")
    parts.append(blockers(evidence, bad, "input", own, F.concat(F.lit("invalid DOI: "), "doi")))
    parts.append(blockers(links.join(questions.select("question").distinct(), "question", "left_anti"), F.lit(True), "input", own, F.concat(F.lit("unknown question: "), F.coalesce("question", F.lit("null")))))
    parts.append(blockers(evidence.join(links.select("id").distinct(), "id", "left_anti"), F.lit(True), "input", own, F.lit("no question")))
    return union(parts)


def integrity(events: DataFrame, files: DataFrame) -> DataFrame:
    """V-18, V-27: events (event, raw, expected) against the files' hashes (raw, actual): missing, hash-mismatch or pass; without a raw file nothing."""
    met = events.filter("coalesce(raw, '') != ''").join(files.select(F.col("raw").alias("_r"), "actual"), F.col("raw") == F.col("_r"), "left")
    status = F.when(F.col("_r").isNull(), "missing").when((F.coalesce("expected", F.lit("")) != "") & (F.col("actual") == F.col("expected")), "pass").otherwise("hash-mismatch")
    return met.select("event", "raw", status.alias("status"))


def fresh(objects: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """V-19: objects (key, start, raw, hash) whose range still holds their text and whose hash is that of it: key, start, in_place, hash_fresh."""
    met = objects.join(texts.select(F.col(key).alias("_k"), "text"), F.col(key) == F.col("_k"), "left")
    held = F.substring("text", F.col("start").cast("int") + 1, F.length("raw"))
    return met.select(key, "start", F.coalesce(held == F.col("raw"), F.lit(False)).alias("in_place"), (F.sha2("raw", 256) == F.col("hash")).alias("hash_fresh"))


def ids_in_text(texts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """X-11: ids (key, id) that a text (key, text) doesn't hold literally."""
    met = ids.join(texts.select(F.col(key).alias("_k"), "text"), F.col(key) == F.col("_k"), "left")
    return met.filter(~F.coalesce(F.contains("text", F.col("id")), F.lit(False))).select(key, "id")


def term_counts(paragraphs: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """J-21: occurrences of each term (one word) in each paragraph (key, paragraph, text), by an equi join on words; zeros are left out."""
    words = paragraphs.select(key, "paragraph", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    return words.join(terms.select(F.lower("term").alias("term")).distinct(), "term", "left_semi").groupBy(key, "paragraph", "term").agg(F.count("*").alias("n"))


def section_objects(objects: DataFrame, sections: DataFrame, by: str) -> DataFrame:
    """F-06, J-20: objects (by, line, file) in sections (by, section, first, last, file): in the line range, and the object's path ends with the
    section's (null: any)."""
    met = objects.withColumnRenamed("file", "_of").join(sections.withColumnRenamed("file", "_sf"), by)
    own = (F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last")) & (F.col("_sf").isNull() | F.col("_of").endswith(F.col("_sf")))
    return met.filter(own).drop("_of", "_sf")


def map_occurrences(texts: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """J-15, X-07: places of objects (key, id, raw, line) in texts (key, text): key, id, start (null: not to be found), end.

    In order of their lines, each object takes an occurrence that none has: at or after its line, else the last one before it, else the first one
    of the text.  A text and its objects are one row; the choice depends on the order, so it is one task's.
    """
    import pandas as pd

    rows = objects.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("line", F.lit(0)).alias("o"), "id", "raw", "line"))).alias("_o"))
    kind = texts.select(key).schema.fields[0].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, text, found in zip(f[key], f["text"], f["_o"], strict=True):
                starts, taken = [0], set()
                for i, c in enumerate(text or ""):
                    if c == "\n":
                        starts.append(i + 1)
                for o in found:
                    at = _free(text or "", o["raw"] or "", o["line"], starts, taken)
                    out.append((k, o["id"], at, None if at is None else at + len(o["raw"])))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate(((key, "object"), ("id", "object"), ("start", "Int64"), ("end", "Int64")))})

    return texts.join(rows, F.col(key) == F.col("_k")).select(key, "text", "_o").mapInPandas(place, f"`{key}` {kind}, id string, start bigint, end bigint")


def _free(text: str, raw: str, line: int | None, starts: list[int], taken: set[int]) -> int | None:
    if not raw:
        return None
    first = []
    if line is not None and 1 <= line <= len(starts):
        anchor = starts[int(line) - 1]
        first = [text.find(raw, anchor), text.rfind(raw, 0, anchor)]
    for at in first:
        if at >= 0 and at not in taken:
            taken.add(at)
            return at
    at = text.find(raw)
    while at >= 0 and at in taken:
        at = text.find(raw, at + 1)
    if at < 0:
        return None
    taken.add(at)
    return at


def text_rules(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str, object]]) -> DataFrame:
    """V-21: key, name, ok of each rule (name, kind, argument) on the text before its appendix.

    Kinds: headings (all of them are chapters or sections), require and forbid (phrases, in any case and spacing), forbid_pattern, at_most
    ((pattern, n)), words ((least, most), prose words), cited (all cited keys are among them).  A null text passes nothing.
    """
    from inkbed.functions import text as T

    own = rows.select(key, T.main_route(F.col(text)).alias("_t"))
    flat = F.lower(T.collapse_space(F.col("_t")))
    heads = F.regexp_extract_all("_t", F.lit("(?m)^\\\\(?:chapter|section)\\{([^}]*)\\}"), F.lit(1))
    holds = lambda phrases: [F.contains(flat, F.lit(p.lower())) for p in phrases]

    def all_of(found: list[Column]) -> Column:
        out = F.lit(True)
        for c in found:
            out = out & c
        return out

    def check(kind: str, x) -> Column:
        if kind == "headings":
            return F.size(F.array_except(F.array(*map(F.lit, x)), heads)) == 0
        if kind == "require":
            return all_of(holds(x))
        if kind == "forbid":
            return all_of([~c for c in holds(x)])
        if kind == "forbid_pattern":
            return ~F.col("_t").rlike(x)
        if kind == "at_most":
            return F.regexp_count("_t", F.lit(x[0])) <= x[1]
        if kind == "words":
            return T.prose_word_count(F.col("_t")).between(*x)
        if kind == "cited":
            return F.size(F.array_except(T.citation_keys(F.col("_t")), F.array(*map(F.lit, x)).cast("array<string>"))) == 0
        raise ValueError(f"no such kind of rule: {kind}")

    found = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(check(k, x), F.lit(False)).alias("ok")) for n, k, x in rules])
    return own.select(key, F.inline(found))
