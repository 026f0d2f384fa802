"""Stored answers of bibliographic and package services as tables; requests themselves are out of scope.

Each reader takes rows (query, search_mode, payload: the answer's JSON text) and gives candidate rows; an answer that can't be read gives none,
and its event (events()) says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbed.functions import text as T

_OPENALEX = "results ARRAY<STRUCT<id: STRING, title: STRING, publication_year: STRING, doi: STRING, authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, abstract_inverted_index: MAP<STRING, ARRAY<BIGINT>>, primary_location: STRUCT<source: STRUCT<display_name: STRING>>>>"
_CROSSREF = "message STRUCT<items: ARRAY<STRUCT<title: ARRAY<STRING>, author: ARRAY<STRUCT<given: STRING, family: STRING>>, published: STRUCT<`date-parts`: ARRAY<ARRAY<BIGINT>>>, DOI: STRING, URL: STRING, abstract: STRING, `container-title`: ARRAY<STRING>>>>"
_SEARCH = "results ARRAY<STRUCT<title: STRING, authors: ARRAY<STRING>, displaydate: STRING, url: STRING, abstract: STRING>>"
_TEXT = ("title", "authors", "year", "doi", "url", "abstract", "venue")


def _or_empty(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def _rows(answers: DataFrame, schema: str, items: str) -> DataFrame:
    return answers.select("query", "search_mode", F.explode(F.from_json("payload", schema)[items] if "." not in items else F.from_json("payload", schema)["message"]["items"]).alias("x"))


def openalex(answers: DataFrame) -> DataFrame:
    """S-14, S-16: titles with authors, year, DOI and the abstract rebuilt from its inverted index."""
    rows = _rows(answers, _OPENALEX, "results")
    names = F.array_join(F.transform(F.coalesce("x.authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), "; ")
    return rows.select(
        "query", "search_mode", _or_empty("x.title").alias("title"), names.alias("authors"), _or_empty("x.publication_year").alias("year"), _or_empty("x.doi").alias("doi"),
        F.coalesce(F.nullif(_or_empty("x.doi"), F.lit("")), F.col("x.id"), F.lit("")).alias("url"), _or_empty(T.inverted_index_text(F.col("x.abstract_inverted_index"))).alias("abstract"), _or_empty("x.primary_location.source.display_name").alias("venue"),
    )


def crossref(answers: DataFrame) -> DataFrame:
    """S-15: given and family names joined, tags taken out of abstracts, the first part of the date as year."""
    rows = _rows(answers, _CROSSREF, "message.items")
    name = lambda a: F.array_join(F.filter(F.array(a["given"], a["family"]), lambda n: F.coalesce(n, F.lit("")) != ""), " ")
    authors = F.array_join(F.transform(F.coalesce("x.author", F.array().cast("array<struct<given:string,family:string>>")), name), "; ")
    return rows.select(
        "query", "search_mode", _or_empty(F.get("x.title", F.lit(0))).alias("title"), authors.alias("authors"), _or_empty(F.get(F.get(F.col("x.published.`date-parts`"), F.lit(0)), F.lit(0)).cast("string")).alias("year"), _or_empty("x.DOI").alias("doi"),
        _or_empty("x.URL").alias("url"), F.regexp_replace(_or_empty("x.abstract"), "<[^>]+>", " ").alias("abstract"), _or_empty(F.get(F.col("x.`container-title`"), F.lit(0))).alias("venue"),
    )


def public_search(answers: DataFrame, base: str, venue: str) -> DataFrame:
    """S-16: exact-item searches of a public catalogue: tags out of authors, the first year of the date, addresses made absolute."""
    rows = _rows(answers, _SEARCH, "results")
    authors = F.array_join(F.transform(F.coalesce("x.authors", F.array().cast("array<string>")), lambda a: F.regexp_replace(a, "<[^>]+>", "")), "; ")
    url = F.when(_or_empty("x.url").rlike("^https?://"), F.col("x.url")).otherwise(F.concat(F.lit(base), _or_empty("x.url")))
    return rows.select("query", F.lit("known-item-challenge").alias("search_mode"), _or_empty("x.title").alias("title"), authors.alias("authors"), F.regexp_extract(_or_empty("x.displaydate"), "\\b((?:19|20)[0-9]{2})\\b", 1).alias("year"), F.lit("").alias("doi"), url.alias("url"), _or_empty("x.abstract").alias("abstract"), F.lit(venue).alias("venue"))


def events(answers: DataFrame, items: str) -> DataFrame:
    """The ledger's row of each answer: query, search_mode, status and result_count; null payloads were not run."""
    count = F.size(F.from_json(F.get_json_object("payload", f"$.{items}"), "ARRAY<STRING>"))
    status = F.when(F.col("payload").isNull(), "not-run-offline").when(F.try_parse_json("payload").isNull(), "unreadable").otherwise("http-200")
    return answers.select("query", "search_mode", status.alias("status"), F.when(count > 0, count).otherwise(0).cast("bigint").alias("result_count"))


def registry(packages: DataFrame, answers: DataFrame) -> DataFrame:
    """S-18: packages (name, ecosystem, repository, source) with version, licence and status of their registry's answer (name, payload).

    Only seeds, vendored and imported packages are looked up; others stay as they are.
    """
    asked = F.col("source").isin("protocol-seed", "vendor-manifest", "manual-import")
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("payload", p), F.lit("")) for p in paths], F.lit(""))
    met = packages.join(answers.select(F.col("name").alias("_n"), "payload"), (F.col("name") == F.col("_n")) & asked, "left")
    eco = F.lower("ecosystem")
    hosted = F.col("repository").startswith("https://github.com/")
    kind = F.when(~asked, "not-asked").when(eco == "npm", "npm").when(eco == "python", "python").when(hosted, "repository").otherwise("not-applicable")
    version = F.when(eco == "npm", get("$.info.version", "$.dist-tags.latest")).when(eco == "python", get("$.info.version")).otherwise("")
    licence = F.when(eco.isin("npm", "python"), get("$.info.license")).otherwise(get("$.license.spdx_id"))
    archived = F.coalesce(F.get_json_object("payload", "$.archived") == "true", F.lit(False))
    status = F.when(F.col("payload").isNull(), "").when(archived, "archived").otherwise("metadata-retrieved")
    empty = lambda c: F.when(F.col("payload").isNull(), "").otherwise(c)
    return met.select("name", kind.alias("lookup"), empty(version).alias("registry_version"), empty(licence).alias("registry_license"), status.alias("registry_status"))


def manifest_lines(lines: DataFrame) -> DataFrame:
    """S-19: lines (value) of the form name, commit, address; others are left out."""
    pattern = "^(\\S+)\\s+([0-9a-f]{7,40})\\s+(https?://\\S+)$"
    own = lines.select(F.trim("value").alias("v")).filter(F.col("v").rlike(pattern))
    return own.select(*[F.regexp_extract("v", pattern, i + 1).alias(c) for i, c in enumerate(("name", "commit", "repository"))], F.lit("vendor-manifest").alias("source"))


def visuals(lines: DataFrame) -> DataFrame:
    """S-20: figure and table entries of auxiliary files (doc_id, value): kind and page."""
    pattern = "\\\\contentsline \\{(figure|table)\\}.*?\\}\\}\\{([0-9]+)\\}"
    return lines.filter(F.col("value").rlike(pattern)).select("doc_id", F.regexp_extract("value", pattern, 1).alias("kind"), F.regexp_extract("value", pattern, 2).cast("bigint").alias("page"))


def evidence_files(files: DataFrame, allowed: Column) -> DataFrame:
    """S-25: files (path, text) under the allowed folder prefix; paths that climb out or are absolute are refused: path, text, status."""
    climbs = F.col("path").rlike("(^|/)\\.\\.(/|$)") | F.col("path").startswith("/")
    status = F.when(climbs, "refused").when(~F.col("path").startswith(allowed), "outside").otherwise("read")
    return files.select("path", F.when(status == "read", F.col("text")).alias("text"), status.alias("status"))


def flatten_blueprint(rows: DataFrame, key: str, json: str) -> DataFrame:
    """G-19: units of a blueprint in JSON, nested (chapters with subsections) or flat (subsections), in order: key, chapter, unit, title, word_budget."""
    unit = "STRUCT<title: STRING, word_budget: BIGINT>"
    own = rows.select(key, F.from_json(json, f"chapters ARRAY<STRUCT<title: STRING, subsections: ARRAY<{unit}>>>, subsections ARRAY<{unit}>").alias("b"))
    nested = own.select(key, F.posexplode("b.chapters").alias("chapter", "c")).select(key, "chapter", F.posexplode("c.subsections").alias("unit", "u"))
    flat = own.select(key, F.lit(0).alias("chapter"), F.posexplode("b.subsections").alias("unit", "u"))
    return nested.unionByName(flat).select(key, F.col("chapter").cast("bigint").alias("chapter"), F.col("unit").cast("bigint").alias("unit"), F.coalesce("u.title", F.lit("Untitled")).alias("title"), F.coalesce("u.word_budget", F.lit(500)).cast("bigint").alias("word_budget"))
