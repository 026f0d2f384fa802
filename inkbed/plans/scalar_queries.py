"""Queries on scalar text functions, over the manuscript view and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import segment

from .base import LINES, MANUSCRIPTS, manuscripts, query

_B = "chr(92)"


def _tex(t):
    return manuscripts(t("documents")).select("doc_id", "tex")


@query("object_normal_forms", f"""
WITH {MANUSCRIPTS} SELECT doc_id, 'k' || doc_id || ',z' AS citation, 'a = b' AS equation, 'd' || doc_id AS label, 'x y' AS other FROM ms""")
def object_normal_forms(t):
    """C-02 to C-05: normal forms by type."""
    rows = _tex(t).select(
        "doc_id",
        F.concat(F.lit("see \\citep[p. 3]{ k"), F.col("doc_id").cast("string"), F.lit(" , z } and \\cite{q}")).alias("c"),
        F.lit("a = % note\n   b% end").alias("e"),
        F.concat(F.lit(" d"), F.col("doc_id").cast("string"), F.lit(" ")).alias("l"),
        F.lit(" x \n\t y ").alias("o"),
    )
    kind = lambda k, c: T.type_normal(F.lit(k), F.col(c))
    return rows.select("doc_id", kind("citation", "c").alias("citation"), kind("equation", "e").alias("equation"), kind("label", "l").alias("label"), kind("table", "o").alias("other"))


@query("escaped_texts", """
SELECT doc_id, 'a' || chr(92) || '_b' || chr(92) || '%' || chr(92) || '{' || source || chr(92) || '}' || chr(92) || 'textbackslash{}' AS tex, source || chr(92) || '| x' AS cell, 'http://e/' || source || chr(92) || '%20' || chr(92) || '_' AS url, sha256(regexp_replace(text, '[^' || chr(1) || '-' || chr(127) || ']', '', 'g')) AS ascii FROM documents""")
def escaped_texts(t):
    """C-13."""
    return t("documents").select(
        "doc_id",
        T.tex_escape(F.concat(F.lit("a_b%{"), "source", F.lit("}\\"))).alias("tex"),
        T.markdown_cell(F.concat("source", F.lit("|\nx"))).alias("cell"),
        T.url_escape(F.concat(F.lit("http://e/"), "source", F.lit("%20_"))).alias("url"),
        F.sha2(T.ascii_only(F.col("text")), 256).alias("ascii"),
    )


@query("word_measures", """
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS terms, len(regexp_extract_all(regexp_replace(regexp_replace(text, '[$][^$]*[$]', ' ', 'g'), '\\\\[A-Za-z]+[*]?', ' ', 'g'), '[A-Za-z][A-Za-z''-]*'))::BIGINT AS prose_words,
(len(regexp_extract_all(' ' || lower(text) || ' ', '(?:^|[^a-z0-9])the(?:$|[^a-z0-9])')) + len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '(^|[^a-z0-9])the($|[^a-z0-9])', ' . ', 'g'), '(?:^|[^a-z0-9])the(?:$|[^a-z0-9])')))::BIGINT AS the, length(regexp_replace(text, '[^0-9]', '', 'g')) > 0 AS digits FROM documents""")
def word_measures(t):
    """C-15, C-17, C-25, C-34."""
    x = F.col("text")
    return t("documents").select("doc_id", T.term_words(x).alias("terms"), T.prose_word_count(x).alias("prose_words"), T.term_occurrences(x, "the").alias("the"), (F.size(T.exempt_digits(x)) > 0).alias("digits"))


@query("normalized_terms", """
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents) SELECT w AS term, w AS normal, w AS possessive FROM w""")
def normalized_terms(t):
    """C-24: terms as they are, in capitals with blanks, and with a possessive ending."""
    w = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("term")).distinct()
    return w.select("term", T.term_normal(F.concat(F.lit(" "), F.upper("term"), F.lit(" "))).alias("normal"), T.term_normal(F.concat("term", F.lit("'s"))).alias("possessive"))


@query("line_numbers", f"""WITH {LINES} SELECT doc_id, line_no, line_no + 1 AS of_start, line_no + 1 AS of_last FROM l WHERE "end" > start""")
def line_numbers(t):
    """C-26: the line of each line's first and last character."""
    lines = segment.line_spans(t("documents")).filter("end > start")
    rows = lines.join(t("documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "line_no", T.line_of(F.col("text"), F.col("start")).alias("of_start"), T.line_of(F.col("text"), F.col("end") - 1).alias("of_last"))


@query("line_contexts", f"""
WITH {LINES} SELECT l.doc_id, l.line_no, sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.line_no), '')) AS context FROM l LEFT JOIN l n ON n.doc_id = l.doc_id AND n.line_no BETWEEN l.line_no - 2 AND l.line_no + 2 AND n.line_no <> l.line_no WHERE l.line_no % 4 = 0 GROUP BY ALL""")
def line_contexts(t):
    """C-28: two lines on either side of every fourth line."""
    rows = segment.line_spans(t("documents")).filter("line_no % 4 = 0").join(t("documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "line_no", F.sha2(T.line_context(F.col("text"), F.col("line_no") + 1), 256).alias("context"))


@query("document_slices", f"""
WITH {MANUSCRIPTS}, d AS (SELECT doc_id, tex, 'head' || {_B} || 'begin{{document}}' || tex || {_B} || 'appendix more' || {_B} || 'end{{document}}tail' AS x FROM ms)
SELECT doc_id, 'head' AS preamble, {_B} || 'end{{document}}tail' AS postamble, sha256(tex || {_B} || 'appendix more') AS body, sha256('head' || {_B} || 'begin{{document}}' || tex) AS main_route, '03 D' || doc_id AS label, 2::BIGINT AS chapters FROM d""")
def document_slices(t):
    """C-36, C-37, C-40, C-45: slices of a manuscript that is put into a document."""
    whole = F.concat(F.lit("head\\begin{document}"), "tex", F.lit("\\appendix more\\end{document}tail"))
    rows = _tex(t).select("doc_id", "tex", whole.alias("x"))
    return rows.select(
        "doc_id", T.preamble(F.col("x")).alias("preamble"), T.postamble(F.col("x")).alias("postamble"), F.sha2(T.body(F.col("x")), 256).alias("body"), F.sha2(T.main_route(F.col("x")), 256).alias("main_route"),
        T.chapter_label(F.col("tex"), F.lit(3)).alias("label"), F.size(T.chapters(F.col("x"))).cast("bigint").alias("chapters"),
    )


@query("prose_paragraphs", "SELECT doc_id, 2::BIGINT AS paragraphs, 14 + doc_id % 3 AS tokens, 1::BIGINT AS citations, 1::BIGINT AS displays FROM documents")
def prose_paragraphs(t):
    """C-23: paragraphs of five tokens or more, their tokens, citation and display marks."""
    head = F.concat(F.lit("\\section{D}\n\none two three \\cite[p.~2]{"), "source", F.lit("} five "), F.expr("repeat('four ', CAST(doc_id % 3 AS INT))"))
    text = F.concat(head, F.lit("\n \n short\n\nSee \\emph{the \\textbf{point}} of $x+y$ and \\[z\\] at \\label{d} the~end"))
    rows = t("documents").select("doc_id", F.explode(F.split(text, "\\n\\s*\\n")).alias("b"))
    words = rows.select("doc_id", F.regexp_extract_all(T.prose(F.col("b")), F.lit("([A-Za-z]+)"), F.lit(1)).alias("w")).filter(F.size("w") >= 5)
    n = lambda mark: F.sum(F.size(F.filter("w", lambda x: x == mark))).cast("bigint")
    return words.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.size("w")).cast("bigint").alias("tokens"), n("CITEMARK").alias("citations"), n("MATHDISP").alias("displays"))


@query("cleaned_tex", f"""
SELECT doc_id, source || ' 50' || {_B} || '% a ' || chr(10) || 'b' AS commentless, source || '   end' AS mathless, 'see  end' AS display FROM documents""")
def cleaned_tex(t):
    """C-21, C-22: comments and mathematics taken out."""
    rows = t("documents").select("doc_id", F.concat("source", F.lit(" 50\\% a % note\nb")).alias("c"), F.concat("source", F.lit(" $a+b$ end")).alias("m"), F.lit("see\\[ x\n\\]$$y$$end").alias("d"))
    return rows.select("doc_id", T.strip_comments(F.col("c")).alias("commentless"), T.strip_math(F.col("m")).alias("mathless"), T.strip_math(F.col("d")).alias("display"))


@query("citations_and_words", f"""
WITH {MANUSCRIPTS}, w AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(revised, '\\\\cite\\{{([^}}]*)\\}}', 1), lambda x: trim(x))) AS k, list_transform(regexp_extract_all(revised, '\\\\cite\\{{([^}}]*)\\}}', 1), lambda x: trim(x)) AS a, len(regexp_extract_all(revised, '[^ \\t\\n\\r\\f\\x0B]+')) AS n FROM ms)
SELECT doc_id, CASE WHEN a[1] = a[2] THEN a[1] ELSE a[1] || ',' || a[2] END AS citations, n::BIGINT AS words FROM w""")
def citations_and_words(t):
    """C-20."""
    m = manuscripts(t("documents")).select("doc_id", T.citations_and_words(F.col("revised")).alias("x"))
    return m.select("doc_id", "x.citations", "x.words")


@query("bibliography_entries", "SELECT DISTINCT source AS key FROM documents UNION ALL SELECT DISTINCT 'b' || source FROM documents")
def bibliography_entries(t):
    """C-19."""
    bib = t("documents").select("source").distinct().select(F.concat(F.lit("% @no{x}\n@article{"), "source", F.lit(", title={@misc}}\n  @Book { b"), "source", F.lit(",\n}")).alias("x"))
    return bib.select(F.explode(T.bibliography_keys(F.col("x"))).alias("key"))


@query("fences_and_stems", "SELECT doc_id, '{\"a\": ' || doc_id || '}' AS json, left(lower(replace(source, ' ', '_')) || '_' || doc_id || '_x_y', 50) AS stem FROM documents")
def fences_and_stems(t):
    """C-29, C-32."""
    i = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", T.fenced_json(F.concat(F.lit("so:\n```json\n{\"a\": "), i, F.lit("}\n```\nand ```json\n{}\n```"))).alias("json"), T.safe_stem(F.concat("source", F.lit(" "), i, F.lit("/X Y"))).alias("stem"))


@query("ambiguous_acronyms", "SELECT doc_id, 'AB,' || upper(source) || 'Q' AS acronyms, false AS abstains FROM documents WHERE regexp_matches(upper(source) || 'Q', '^[A-Z]{2,}$') UNION ALL SELECT doc_id, 'AB', false FROM documents WHERE NOT regexp_matches(upper(source) || 'Q', '^[A-Z]{2,}$')")
def ambiguous_acronyms(t):
    """C-43: capital words but for known ones; more than three would be too many."""
    x = F.concat(F.lit("The AB of UK and AB "), F.upper("source"), F.lit("Q."))
    found = T.acronyms(x, ("UK",))
    return t("documents").select("doc_id", F.array_join(found, ",").alias("acronyms"), (F.size(found) > 3).alias("abstains"))


@query("rebuilt_abstracts", f"WITH {LINES}, w AS (SELECT doc_id, string_agg(line_no::VARCHAR, ' ' ORDER BY line_no) AS x FROM l GROUP BY doc_id) SELECT doc_id, x AS abstract FROM w")
def rebuilt_abstracts(t):
    """C-12, S-14: texts from inverted indexes."""
    rows = segment.line_spans(t("documents")).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("line_no").cast("string").alias("w"), F.array("line_no").alias("p"))).alias("e"))
    return rows.select("doc_id", T.inverted_index_text(F.map_from_entries("e")).alias("abstract"))


@query("review_columns", "SELECT doc_id, source AS generated_source, n_chars AS generated_n_chars, '' AS reviewer_1, '' AS reviewer_2 FROM documents")
def review_columns(t):
    """C-39."""
    return t("documents").select("doc_id", "source", "n_chars").select(*T.prefixed(["doc_id", "source", "n_chars"], ["doc_id"], ["reviewer_1", "reviewer_2"]))
