"""A scanner for LaTeX text: gapless regions, and located protected objects, as functions for mapInPandas over whole files.

Offsets are code points.  The scanner has state (comments, nesting), which built-in functions can't express; a file is a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbed.session import short_batches

#: Environments by kind.
MATH = ("equation", "align", "gather", "eqnarray", "multline", "displaymath", "math", "alignat", "flalign", "split", "IEEEeqnarray")
FLOATS = ("figure", "table", "tabular", "tabularx", "longtable", "tikzpicture", "algorithm", "algorithmic", "lstlisting", "verbatim", "Verbatim", "minted", "listing")
BIBLIOGRAPHY = ("thebibliography",)
HEADINGS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
BIBLIOGRAPHY_COMMANDS = ("bibliography", "bibliographystyle", "printbibliography", "addbibresource", "nocite")
COMMANDS = (
    "documentclass", "usepackage", "input", "include", "includeonly", "newcommand", "renewcommand", "providecommand", "DeclareMathOperator", "newenvironment",
    "renewenvironment", "newtheorem", "setlength", "addtolength", "setcounter", "addtocounter", "pagestyle", "thispagestyle", "geometry", "hypersetup", "definecolor",
    "graphicspath", "label", "maketitle", "tableofcontents", "listoffigures", "listoftables", "appendix", "clearpage", "newpage", "pagebreak", "noindent", "centering",
    "raggedright", "small", "footnotesize", "normalsize", "large", "Large", "huge", "Huge",
)
CITATIONS = ("cite", "citep", "citet", "citeauthor", "citeyear", "parencite", "textcite")

_BEGIN = re.compile(r"\\begin\{([A-Za-z]+\*?)\}")
_HEADING = re.compile(r"\\(" + "|".join(HEADINGS) + r")\*?(?:\[[^\]]*\])?\{")
_COMMAND = re.compile(r"\\(" + "|".join((*COMMANDS, *BIBLIOGRAPHY_COMMANDS, "end")) + r")(?![A-Za-z])\*?")
_BLANK = re.compile(r"\n[ \t]*\n\s*")


def group_end(text: str, at: int) -> int:
    """After the brace group that opens at ``at``, escapes heeded; -1 if it doesn't close."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def environment_end(text: str, name: str, at: int) -> int:
    """After the end that belongs to a begin of ``name`` whose body starts at ``at``; -1 if there is none."""
    depth = 1
    for m in re.compile(r"\\(begin|end)\{" + re.escape(name) + r"\}").finditer(text, at):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return m.end()
    return -1


def regions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of comment, math, float, bibliography, heading, command, prose and whitespace; they tile the text."""
    found: list[tuple[int, int, str]] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c == "%":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end + 1
            found.append((at, end, "comment"))
        elif c == "$":
            mark = "$$" if text.startswith("$$", at) else "$"
            end = at + len(mark)
            while (end := text.find(mark, end)) >= 0 and text[end - 1] == "\\":
                end += 1
            if end < 0:  # never closed: it hides nothing
                end = at + len(mark)
            else:
                end += len(mark)
                if mark == "$$":  # mathematics in a line stays in its prose
                    found.append((at, end, "math"))
        elif c == "\\":
            if m := _BEGIN.match(text, at):
                name, base = m[1], m[1].rstrip("*")
                kind = "math" if base in MATH else "float" if base in FLOATS else "bibliography" if base in BIBLIOGRAPHY else None
                end = environment_end(text, name, m.end()) if kind else -1
                if end < 0:  # unknown, or never ended: the begin alone
                    kind, end = "command", m.end()
                found.append((at, end, kind))
            elif text.startswith("\\[", at):
                end = text.find("\\]", at)
                if end < 0:
                    end = at + 2
                else:
                    end += 2
                    found.append((at, end, "math"))
            elif (m := _HEADING.match(text, at)) and (end := group_end(text, m.end() - 1)) > 0:
                found.append((at, end, "heading"))
            elif m := _COMMAND.match(text, at):
                end = m.end()
                while end < len(text) and text[end] in "[{":
                    after = group_end(text, end) if text[end] == "{" else text.find("]", end) + 1
                    if after <= end:
                        break
                    end = after
                found.append((at, end, "bibliography" if m[1] in BIBLIOGRAPHY_COMMANDS else "command"))
            else:
                end = at + 2
        else:
            end = at + 1
        at = end
    out, at = [], 0
    for start, end, kind in [*found, (len(text), len(text), "")]:
        while at < start:  # what lies between is prose, split at blank lines
            m = _BLANK.search(text, at, start)
            stop = m.start() if m else start
            if stop > at:
                out.append((at, stop, "prose" if text[at:stop].strip() else "whitespace"))
            if m:
                out.append((m.start(), m.end(), "whitespace"))
            at = m.end() if m else start
        if kind:
            out.append((start, end, kind))
            at = end
    return out


def unclosed(text: str) -> list[tuple[int, str, str]]:
    """(start, construct, reason) of environments, display and inline mathematics that a scan finds opened and never closed."""
    out, at = [], 0
    for start, end, kind in regions(text):
        at = start
        if kind == "command" and (m := _BEGIN.match(text, start)) and environment_end(text, m[1], m.end()) < 0:
            out.append((start, f"\\begin{{{m[1]}}}", "environment is never closed"))
        elif kind == "prose":
            while at < end:
                if text[at] == "\\":
                    if text.startswith("\\[", at):
                        out.append((at, "\\[", "mathematics is never closed"))
                    at += 2
                elif text[at] == "$":
                    mark = "$$" if text.startswith("$$", at) else "$"
                    close = at + len(mark)
                    while (close := text.find(mark, close)) >= 0 and text[close - 1] == "\\":
                        close += 1
                    if close < 0:
                        out.append((at, mark, "mathematics is never closed"))
                    at = at + len(mark) if close < 0 else close + len(mark)
                else:
                    at += 1
    return out


def align_rows(body: str) -> list[str]:
    """G-08: rows of an aligned display, split outside braces; all of it unless two rows or more have labels."""
    rows, depth, start, at = [], 0, 0, 0
    while at < len(body):
        if body[at] == "\\":
            if not depth and body.startswith("\\\\", at):
                rows.append(body[start:at])
                start = at + 2
            at += 2
            continue
        depth += {"{": 1, "}": -1}.get(body[at], 0)
        at += 1
    rows.append(body[start:])
    labelled = [r for r in rows if "\\label{" in r]
    return labelled if len(labelled) >= 2 else [body]


def objects(text: str) -> list[tuple[str, str, int, int]]:
    """(object_type, raw, start, end) of equations, display mathematics, tables, citations and labels."""
    out = []
    for m in re.finditer(r"\\begin\{((?:" + "|".join(MATH[:5]) + r")\*?)\}", text):
        if (end := environment_end(text, m[1], m.end())) > 0:
            body = text[m.end() : end - len(m[1]) - 6]
            if m[1].rstrip("*") in ("align", "gather", "eqnarray"):
                at = m.end()
                for row in align_rows(body):
                    place = text.index(row, at) if row else at
                    out.append(("equation", row, place, place + len(row)))
                    at = place + len(row)
            else:
                out.append(("equation", text[m.start() : end], m.start(), end))
    out += [("displaymath", m[0], m.start(), m.end()) for m in re.finditer(r"\\\[.*?\\\]", text, re.S)]
    inside = 0
    for m in re.finditer(r"\\begin\{((?:table\*?|tabular\*?|tabularx|longtable))\}", text):
        if m.start() >= inside and (end := environment_end(text, m[1], m.end())) > 0:  # a table within a table is part of it
            out.append(("table", text[m.start() : end], m.start(), end))
            inside = end
    out += [("citation", m[0], m.start(), m.end()) for m in re.finditer(r"\\(?:" + "|".join(CITATIONS) + r")\*?(?:\[[^\]]*\])*\{[^}]*\}", text)]
    out += [("label", m[0], m.start(), m.end()) for m in re.finditer(r"\\label\{[^}]*\}", text)]
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


#: Characters of the texts whose rows a worker gives back at once.
SCAN_CHARS = 1 << 20


def _scanned(files: DataFrame, key: str, text: str, scan, columns: str) -> DataFrame:
    """key and the ``columns`` of scan(text), for some MB of texts at a time, however many rows they have and a task reads."""
    import pandas as pd

    names = [key, *(c.split()[0] for c in columns.split(", "))]

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, read = [], 0
            for k, t in zip(f["k"], f["t"], strict=True):
                rows += [(k, *x) for x in scan(t or "")]
                read += len(t or "")
                if read >= SCAN_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, read = [], 0
            yield pd.DataFrame(rows, columns=names)

    short_batches(files.sparkSession)
    kind = files.select(key).schema[0].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(scanned, f"`{key}` {kind}, {columns}")


def partition(files: DataFrame, key: str = "doc_id", text: str = "tex") -> DataFrame:
    """G-01 to G-07: key, start, end, kind, text of the regions of each file."""
    return _scanned(files, key, text, lambda t: ((s, e, kind, t[s:e]) for s, e, kind in regions(t)), "start bigint, end bigint, kind string, region string")


def abstentions(files: DataFrame, key: str = "doc_id", text: str = "tex") -> DataFrame:
    """G-03: key, start, construct, reason of what is opened and never closed; its text is covered by the partition all the same."""
    return _scanned(files, key, text, unclosed, "start bigint, construct string, reason string")


def object_manifest(files: DataFrame, key: str = "doc_id", text: str = "tex") -> DataFrame:
    """G-14, G-18: protected objects with line, normal form and content hash, an identity of file, type and range, and how often their
    content occurs in the file."""
    from pyspark.sql import Window as W

    from inkbed.functions.text import line_of, type_normal

    found = protected_objects(files, key, text).join(files.select(F.col(key).alias("_k"), F.col(text).alias("_t")), F.col(key) == F.col("_k"))
    rows = found.withColumn("line", line_of(F.col("_t"), F.col("start"))).withColumn("normal", type_normal(F.col("object_type"), F.col("raw"))).withColumn("hash", F.substring(F.sha2("raw", 256), 1, 16))
    identity = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "object_type", F.col("start").cast("string"), F.col("end").cast("string")), 256), 1, 16)
    return rows.select(key, "object_type", "start", "end", "line", "normal", "hash", identity.alias("object_id"), F.count("*").over(W.partitionBy(key, "object_type", "hash")).alias("occurrences"))


def protected_objects(files: DataFrame, key: str = "doc_id", text: str = "tex") -> DataFrame:
    """G-09 to G-11: key, object_type, raw, start, end."""
    return _scanned(files, key, text, objects, "object_type string, raw string, start bigint, end bigint")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """G-13: 1 - min(|x - y| / mean(x, y), 1) of the two parsers' counts, averaged over the kinds that either found."""
    x = a.groupBy("object_type").agg(F.count("*").alias("x"))
    y = b.groupBy("object_type").agg(F.count("*").alias("y"))
    both = x.join(y, "object_type", "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    one = 1 - F.least(F.abs(F.col("x") - F.col("y")) / ((F.col("x") + F.col("y")) / 2), F.lit(1.0))
    return both.agg(F.coalesce(F.avg(one), F.lit(1.0)).alias("agreement"))


def merge_parsers(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """G-12: objects of two parsers, one row for each file, type and collapsed form, with the parsers that found it.

    Of objects that occur more than once the last one stands for labels, citations and whatever the first parser found; for equations and
    displays that only the second parser found, the first one does.
    """
    from inkbed.functions.text import collapse_space

    both = a.withColumn("parser", F.lit(a_name)).unionByName(b.withColumn("parser", F.lit(b_name)))
    form = F.substring(F.sha2(collapse_space(F.col("raw")), 256), 1, 16)
    own, any_ = F.when(F.col("parser") == a_name, F.col("start")), F.col("start")
    last = F.col("object_type").isin("label", "citation") | F.max(own).isNotNull()
    best = F.when(F.col("object_type").isin("label", "citation"), F.max(any_)).when(F.max(own).isNotNull(), F.max(own)).otherwise(F.min(any_))
    raw = F.when(last, F.max_by("raw", "start")).otherwise(F.min_by("raw", "start"))
    return both.withColumn("hash", form).groupBy("doc_id", "object_type", "hash").agg(F.array_join(F.sort_array(F.collect_set("parser")), "+").alias("parser_source"), best.alias("start"), raw.alias("raw"))


def register_table_functions(spark: SparkSession) -> None:
    """G-01, G-03, G-08 to G-11 for SQL: latex_regions, latex_abstentions and latex_objects, called laterally for each row.

    ``SELECT f.doc_id, r.* FROM files f, LATERAL latex_regions(f.tex, 'prose,heading') r``.  The second argument is optional and constant: kinds
    (or object types) to keep, split by commas; it is checked when the query is analysed, as is that the text is a string.  Null texts have no rows.
    """
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import LongType, StringType, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    def table_function(scan, names: list[str], kind: int):
        """A table function of scan(text), whose rows have ``names``, filtered by the column at place ``kind``."""
        schema = StructType()
        for n in names:
            schema = schema.add(n, LongType() if n in ("start", "end") else StringType())

        class Scanned:
            @staticmethod
            def analyze(text: AnalyzeArgument, kinds: AnalyzeArgument | None = None) -> AnalyzeResult:
                if text.dataType != StringType():
                    raise ValueError("the text has to be a string")
                if kinds is not None and not (kinds.isConstantExpression and isinstance(kinds.value, str)):
                    raise ValueError("kinds have to be a constant string")
                return AnalyzeResult(schema)

            def eval(self, text, kinds=None):
                wanted = {k.strip() for k in kinds.split(",")} if kinds else None
                for row in scan(text) if text is not None else ():
                    if wanted is None or row[kind] in wanted:
                        yield row

        return udtf(Scanned)

    def spelled(text: str):
        return [(s, e, kind, text[s:e]) for s, e, kind in regions(text)]

    spark.udtf.register("latex_regions", table_function(spelled, ["start", "end", "kind", "region"], 2))
    spark.udtf.register("latex_abstentions", table_function(unclosed, ["start", "construct", "reason"], 1))
    spark.udtf.register("latex_objects", table_function(objects, ["object_type", "raw", "start", "end"], 0))
