"""Scalar text functions as Column expressions (normalisers, counters, scans); all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a title key leaves out.
TITLE_STOP_WORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "with")
#: Texts that count as blank.
BLANK_WORDS = ("", "tbd", "todo", "unknown", "n/a", "na", "none", "pending", "?")


#: White space of Unicode, as a class of a regular expression.
UNICODE_SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def canonical(*values: Column) -> Column:
    """Values as one text that no other values have: each with its length before it, a null with none."""
    text = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit(";")), F.lit("null;")) for t in text))


def collapse_space(x: Column) -> Column:
    """C-01, C-02: white space runs to one blank, trimmed; case and tokens stay."""
    return F.trim(F.regexp_replace(x, "[ \\t\\n\\r\\f\\x0B]+", " "))


def normal_form(x: Column) -> Column:
    """C-01: runs of any Unicode white space to one blank, trimmed; case and tokens stay."""
    return F.trim(F.regexp_replace(x, UNICODE_SPACE + "+", " "))


def bibliographic(x: Column) -> Column:
    """C-06: lower case, & to and, anything but a-z and 0-9 to one blank (accents become blanks)."""
    lowered = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "&", " and ")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def title_key(x: Column) -> Column:
    """C-07: the bibliographic form without stop words."""
    return F.array_join(F.filter(F.split(bibliographic(x), " "), lambda w: ~w.isin(*TITLE_STOP_WORDS)), " ")


def slug(x: Column) -> Column:
    """C-08: the bibliographic form with hyphens, 80 characters, "item" if nothing is left."""
    return F.coalesce(F.nullif(F.substring(F.replace(bibliographic(x), F.lit(" "), F.lit("-")), 1, 80), F.lit("")), F.lit("item"))


def clean_doi(x: Column) -> Column:
    """C-09: a DOI without resolver prefix and end punctuation, or an empty string."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "^(https?://(dx[.])?doi[.]org/|doi:[ ]*)", "")
    bare = F.regexp_replace(F.replace(bare, F.lit("\\_"), F.lit("_")), "[.,;)]+$", "")
    return F.when(bare.rlike("^10[.][0-9]{4,9}/[^ \\t\\n\\r]+$"), bare).otherwise(F.lit(""))


def term_hits(x: Column, terms: tuple[str, ...]) -> Column:
    """C-11: how many of the terms occur as substrings of the bibliographic form."""
    normal = bibliographic(x)
    return sum((F.when(F.contains(normal, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)).cast("bigint")


def word_count(x: Column) -> Column:
    """C-16: words between white space."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit("[^ \\t\\n\\r\\f\\x0B]+")).cast("bigint")


def prose_word_count(x: Column) -> Column:
    """C-17: words of letters after commands and inline mathematics are gone."""
    bare = F.regexp_replace(F.regexp_replace(x, "[$][^$]*[$]", " "), "\\\\[A-Za-z]+[*]?", " ")
    return F.regexp_count(bare, F.lit("[A-Za-z][A-Za-z'-]*")).cast("bigint")


def strip_comments(x: Column) -> Column:
    """C-21: percent comments to the line's end, unless the percent sign is escaped."""
    return F.regexp_replace(x, "(?m)(?<!\\\\)%.*$", "")


def strip_math(x: Column) -> Column:
    """C-22: display and inline mathematics."""
    out = F.regexp_replace(x, "(?s)\\\\begin\\{(equation|align|gather|eqnarray)[*]?\\}.*?\\\\end\\{\\1[*]?\\}", " ")
    for pattern in ("(?s)\\\\\\[.*?\\\\\\]", "(?s)[$][$].*?[$][$]", "(?s)\\\\\\(.*?\\\\\\)", "[$][^$]*[$]"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def equation_normal(x: Column) -> Column:
    """C-03: comments dropped (not escape-aware), white space collapsed."""
    return collapse_space(F.regexp_replace(x, "(?m)%.*$", ""))


def citation_normal(x: Column) -> Column:
    """C-04: the keys of the first citation, trimmed and joined in their order."""
    keys = F.regexp_extract(x, "\\\\cite[A-Za-z]*[*]?(?:\\[[^\\]]*\\])*\\{([^}]*)\\}", 1)
    return F.array_join(F.transform(F.split(keys, ","), lambda k: F.trim(k)), ",")


def citation_lists(x: Column) -> Column:
    """The key lists of all citations in order."""
    return F.regexp_extract_all(x, F.lit("\\\\cite[A-Za-z]*[*]?(?:\\[[^\\]]*\\])*\\{([^}]*)\\}"), F.lit(1))


def citation_keys(x: Column) -> Column:
    """C-18, C-20: distinct citation keys in first-seen order."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(citation_lists(x), lambda k: F.split(k, ","))), lambda k: F.trim(k)), lambda k: k != ""))


def label_keys(x: Column) -> Column:
    """G-09: label names in order."""
    return F.regexp_extract_all(x, F.lit("\\\\label\\{([^}]*)\\}"), F.lit(1))


def bibliography_keys(x: Column) -> Column:
    """C-19: entry keys of a bibliography."""
    return F.regexp_extract_all(x, F.lit("(?m)^[ \\t]*@[A-Za-z]+[ \\t]*\\{[ \\t]*([^,\\s]+)"), F.lit(1))


def numbers(x: Column) -> Column:
    """C-14: numeric literals without grouping marks."""
    found = F.regexp_extract_all(x, F.lit("([0-9][0-9,.{}\\\\]*[0-9]|[0-9])"), F.lit(1))
    return F.transform(found, lambda n: F.regexp_replace(n, "[{},\\\\]", ""))


def sentences(x: Column) -> Column:
    """C-33: split after end marks."""
    return F.split(x, "(?<=[.!?])\\s+")


def is_blank(x: Column) -> Column:
    """C-31: null, empty or a placeholder."""
    return x.isNull() | F.lower(F.trim(x)).isin(*BLANK_WORDS)


def fenced_json(x: Column) -> Column:
    """C-32: the first fenced JSON block, else an empty string."""
    return F.regexp_extract(x, "(?s)```json\\s*\\n(.*?)\\n```", 1)


def token_estimate(words: Column) -> Column:
    """C-35: tokens of so many words."""
    return F.floor(words * 1.2 * 4.0).cast("bigint")


def acronyms(x: Column, known: tuple[str, ...] = ()) -> Column:
    """C-43: distinct capital words that aren't known."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(x, F.lit("\\b([A-Z]{2,})\\b"), F.lit(1))), F.array(*map(F.lit, known)).cast("array<string>"))


def chapters(x: Column) -> Column:
    """C-37: pieces that begin at a chapter or section; their concatenation is the text."""
    return F.split(x, "(?=\\\\(?:chapter|section)\\{)")


def safe_stem(x: Column) -> Column:
    """C-29: a lower-case file stem of 50 characters."""
    return F.substring(F.replace(F.regexp_replace(F.lower(x), "[^a-z0-9 _]", "_"), F.lit(" "), F.lit("_")), 1, 50)


def inverted_index_text(index: Column) -> Column:
    """C-12: the text of a map from word to places; words of one place in word order."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(entries), lambda s: s["w"]), " ")


def type_normal(kind: Column, x: Column) -> Column:
    """C-05: the normal form by object type."""
    return F.when(kind.isin("equation", "displaymath"), equation_normal(x)).when(kind == "citation", citation_normal(x)).when(kind == "label", F.trim(x)).otherwise(collapse_space(x))


#: Characters that TeX takes as commands, and their escapes.
TEX_ESCAPES = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))


def tex_escape(x: Column) -> Column:
    """C-13: each special character escaped once."""
    marks = dict(TEX_ESCAPES)
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in marks.items() for v in kv]), c), c)), "")


def markdown_cell(x: Column) -> Column:
    """C-13: a table cell: bars escaped, line breaks to blanks."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def url_escape(x: Column) -> Column:
    """C-13: the characters of an address that TeX takes as commands."""
    return F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("\\%")), F.lit("#"), F.lit("\\#")), F.lit("_"), F.lit("\\_"))


def ascii_only(x: Column) -> Column:
    """C-13: characters beyond ASCII are left out."""
    return F.regexp_replace(x, "[^\\x00-\\x7F]", "")


def term_words(x: Column) -> Column:
    """C-15: runs of word characters."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit("[A-Za-z0-9_]+")).cast("bigint")


def term_normal(x: Column) -> Column:
    """C-24: lower case, trimmed, without a possessive ending."""
    return F.regexp_replace(F.trim(F.lower(x)), "'s$", "")


def term_occurrences(x: Column, term: str) -> Column:
    """C-25: occurrences of a whole term, in any case, its words apart by any white space."""
    import re

    body = "\\s+".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", w) for w in term.split())
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(f"(?i)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])")).cast("bigint")


def line_of(x: Column, offset: Column) -> Column:
    """C-26: the line (from 1) in which an offset lies."""
    left = F.substring(x, F.lit(1), offset.cast("int"))
    return (F.length(left) - F.length(F.replace(left, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def line_context(x: Column, line: Column, reach: int = 2) -> Column:
    """C-28: the lines (from 1) around one, itself left out, joined."""
    lines = F.split(x, "\n")
    near = F.filter(F.transform(lines, lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"))), lambda s: (F.abs(s["n"] - line) <= reach) & (s["n"] != line))
    return F.array_join(F.transform(near, lambda s: s["t"]), "\n")


def exempt_digits(x: Column) -> Column:
    """C-34: distinct digits of a matched text."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit("([0-9])"), F.lit(1)))


def preamble(x: Column) -> Column:
    """C-36: what stands before the document begins; all of it if it doesn't."""
    return F.substring_index(x, "\\begin{document}", 1)


def postamble(x: Column) -> Column:
    """C-36: from the document's end on; empty if it doesn't end."""
    at = F.instr(x, "\\end{document}")
    return F.when(at > 0, F.substring(x, at, F.length(x))).otherwise("")


def body(x: Column) -> Column:
    """C-36: what stands between the document's begin and end; empty without them."""
    return F.regexp_extract(x, "(?s)\\\\begin\\{document\\}(.*?)\\\\end\\{document\\}", 1)


def main_route(x: Column) -> Column:
    """C-40: the text before the appendix."""
    return F.substring_index(x, "\\appendix", 1)


def chapter_label(x: Column, number: Column) -> Column:
    """C-45: number and title of a piece that begins with a chapter or section."""
    title = F.regexp_extract(x, "^\\\\(?:chapter|section)\\{([^}]*)\\}", 1)
    return F.format_string("%02d %s", number.cast("int"), F.when(title == "", "front matter").otherwise(title))


def citations_and_words(x: Column) -> Column:
    """C-20: distinct citations in first-seen order, joined, and the number of words."""
    return F.struct(F.array_join(citation_keys(x), ",").alias("citations"), word_count(x).alias("words"))


def prefixed(columns: list[str], keep: list[str], review: list[str], prefix: str = "generated_") -> list[Column]:
    """C-39: all columns but the kept ones under a prefix, and blank cells for a review."""
    return [F.col(c).alias(c if c in keep else prefix + c) for c in columns] + [F.lit("").alias(c) for c in review]


#: Display environments, commands whose texts are read on, and the marks of what is taken out.
DISPLAYS = ("equation", "align", "gather", "multline")
READ_ON = ("emph", "textbf", "textit", "texttt", "mbox", "text", "underline")
DISPLAY_MARK, CITATION_MARK = " MATHDISP ", " CITEMARK "


def _group(depth: int) -> str:
    """Pattern of a brace group with up to ``depth`` levels of groups in it."""
    inner = "(?:[^{}]++)" if not depth else f"(?:[^{{}}]++|{_group(depth - 1)})"
    return f"\\{{{inner}*+\\}}"


def _tokens() -> str:
    """Pattern of one token of a block: a display, mathematics in a line, a command (alone where its text is read on), plain text or any character."""
    kinds = [
        f"(?s:\\\\begin\\{{((?:{'|'.join(DISPLAYS)})\\*?)\\}}.*?\\\\end\\{{\\1\\}})",
        "(?s:\\\\\\[.*?\\\\\\])",
        "(?s:\\$\\$.*?\\$\\$)",
        "(?s:\\\\\\(.*?\\\\\\))",
        "\\$[^$]*\\$",
        f"\\\\(?:{'|'.join(READ_ON)})(?=\\{{)",
        f"\\\\cite[A-Za-z]*\\*?\\s*+(?:\\[[^\\]]*\\]\\s*+)?{_group(3)}",
        f"\\\\[A-Za-z]+\\*?(?:\\[[^\\]]*\\])?(?:{_group(3)})?",
        "[^\\\\${}~]++",
        "(?s:.)",
    ]
    return "|".join(kinds)


_TOKENS = _tokens()


def prose(x: Column) -> Column:
    """C-23: the prose of a block, read once from left to right, token by token.

    A display becomes MATHDISP, a citation CITEMARK; other mathematics, braces, ties and commands become blanks, with their
    argument unless that is read on, to any depth; what is never closed hides nothing.
    """
    display = f"^(?:\\\\begin\\{{(?:{'|'.join(DISPLAYS)})\\*?\\}}.|\\\\\\[.|\\$\\$.)"

    def read(t: Column) -> Column:
        head = F.substring(t, 1, 1)
        return (
            F.when(~head.isin("\\", "$", "{", "}", "~"), t)
            .when(F.length(t) == 1, F.when(head.isin("\\", "$"), t).otherwise(F.lit(" ")))
            .when(t.rlike(f"(?s){display}"), F.lit(DISPLAY_MARK))
            .when(t.rlike("(?s)^\\\\cite.*\\}$"), F.lit(CITATION_MARK))
            .otherwise(F.lit(" "))
        )

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_TOKENS), F.lit(0)), read), "")
