"""Readers and writers of record files: text trees, JSON, JSONL, CSV, BibTeX, HTML lists, imports with sidecars, manifests."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_tree(spark: SparkSession, path: str, glob: str = "*.tex") -> DataFrame:
    """S-01, S-02: path, text, sha256 and byte_size of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"))


def snapshot_hash(files: DataFrame) -> DataFrame:
    """Hash over the files' hashes in path order; a single file's own hash.  One short string for each file is gathered."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "sha256"))), lambda f: f["sha256"]), "")
    return files.agg(F.when(F.count("*") == 1, F.max("sha256")).otherwise(F.sha2(joined, 256)).alias("snapshot_hash"))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S-03: typed rows; broken lines are kept in _corrupt."""
    schema = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def _listed(value: str, schema: str):
    """The records of a JSON list, or of an object's list called records."""
    from_object = F.from_json(value, f"struct<records:array<struct<{schema}>>>")["records"]
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, f"array<struct<{schema}>>")).otherwise(from_object)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-04, S-06: whole files that hold a list, or an object with a list called records."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    return text.select("file", F.explode(_listed("value", schema)).alias("r")).select("file", "r.*")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """S-05: a CSV file with header, all strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """K-01, K-09: the fields in order, missing ones empty; refuses a folder that exists."""
    have = set(rows.columns)
    rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in have else F.lit("").alias(f) for f in fields]).write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K-02, K-03: one JSON object for each row, keys in order."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("errorifexists").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """K-04: path, bytes and sha256 of all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


_ENTRY = re.compile(r"@([A-Za-z]+)\s*\{\s*([^,\s]+)\s*,")
_BRACE = re.compile(r"[{}]")
_FIELD = re.compile(r"([A-Za-z][\w-]*)\s*=\s*")


def bibtex_entries(text: str) -> list[dict[str, str]]:
    """S-07: entries with kind, key and fields; values in braces, quotes or bare; DOI and arXiv number from the note."""
    starts = list(_ENTRY.finditer(text))
    out = []
    for m, after in zip(starts, [*starts[1:], None], strict=False):  # a text may have no entry
        body = text[m.end() : after.start() if after else len(text)]
        entry = {"kind": m[1].lower(), "key": m[2]}
        at = 0
        while f := _FIELD.search(body, at):
            at = f.end()
            if body[at : at + 1] == "{":
                depth, end = 0, len(body)
                for brace in _BRACE.finditer(body, at):
                    depth += 1 if brace[0] == "{" else -1
                    if not depth:
                        end = brace.end()
                        break
                value, at = body[at + 1 : end - 1], end
            elif body[at : at + 1] == '"':
                end = body.find('"', at + 1)
                end = len(body) if end < 0 else end
                value, at = body[at + 1 : end], end + 1
            else:
                value = re.match(r"[^,}\s]*", body[at:])[0]
                at += len(value)
            entry[f[1].lower()] = " ".join(value.split())
        note = entry.get("note", "")
        if not entry.get("doi") and (d := re.search(r"10\.\d{4,9}/[^\s,;}]+", note)):
            entry["doi"] = d[0].rstrip(".")
        if not entry.get("eprint") and (a := re.search(r"arXiv:\s*(\d{4}\.\d{4,5})", note)):
            entry["eprint"] = a[1]
        out.append(entry)
    return out


def bibtex(files: DataFrame, text: str = "value") -> DataFrame:
    """S-07, S-11: one row for each entry of BibTeX files (column text): kind, key, title, author, year, doi, eprint, url."""
    import pandas as pd

    fields = ["kind", "key", "title", "author", "year", "doi", "eprint", "url"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([[e.get(x, "") for x in fields] for t in f["t"] for e in bibtex_entries(t or "")], columns=fields)

    return files.select(F.col(text).alias("t")).mapInPandas(parse, ", ".join(f"{x} string" for x in fields))


def bibtex_files(spark: SparkSession, path: str) -> DataFrame:
    """S-07: the entries of BibTeX files of any size, plain or gzipped; columns of bibtex().

    An entry begins with @ at the begin of a line, and the text reader takes that as the separator of its rows: a large plain file is
    read by many tasks, and an entry that crosses the edge of a split belongs to the task in whose split it begins.  Entries that begin
    within a line are read with the one before; a value with a line that begins with @ ends there.
    """
    rows = spark.read.option("lineSep", "\n@").text(path)
    # the first row of a file still has its @
    return bibtex(rows.select(F.when(F.col("value").startswith("@"), F.col("value")).otherwise(F.concat(F.lit("@"), "value")).alias("value")))


#: Terms of the bibliography's filter, in normal form.
EXPORT_TERMS = ("writing", "feedback", "revision", "human ai", "language model", "essay", "creative", "authoring")


#: Characters of a title key by which an export is dealt to tasks; keys that begin with the same ones stay together.
RANGE_CHARS = 64


def selected_bibliography(entries: DataFrame, database: str, terms: tuple[str, ...] = EXPORT_TERMS) -> DataFrame:
    """S-11: entries whose title in normal form holds a term, in the columns of an export; entries without title are left out."""
    from inkbed.functions.text import bibliographic, collapse_space

    title, held = bibliographic(F.col("title")), F.lit(False)
    for term in terms:
        held = held | title.contains(term)
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("year", "doi", "url")]
    return entries.filter((title != "") & held).select("title", collapse_space(F.coalesce("author", F.lit(""))).alias("authors"), *filled, F.lit("").alias("abstract"), F.lit(database).alias("database"))


def export_bibliography(entries: DataFrame, out: str, database: str, source: str, terms: tuple[str, ...] = EXPORT_TERMS) -> DataFrame:
    """S-11: writes the selected entries as CSV at ``out`` in order of year and title key, and a sidecar at ``out``.meta, a row of JSON,
    which is written last: database, source, filter, record_count and a hash of the export's rows in any order.  Returns the sidecar.

    The sort is by ranges, so the files in order of their names are the order; no record is capped.
    """
    from inkbed.functions.text import canonical, title_key

    spark, columns = entries.sparkSession, ["title", "authors", "year", "doi", "url", "abstract", "database"]
    rows = selected_bibliography(entries, database, terms)
    # ranges are cut by a sample on the driver, which gets the keys' first characters only, whole titles may be long
    ranges = rows.repartitionByRange("year", F.substring(title_key(F.col("title")), 1, RANGE_CHARS))
    ranges.sortWithinPartitions("year", title_key(F.col("title")), "title", "authors").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(out)
    back = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("escape", '"').option("multiLine", True).csv(out).na.fill("")
    halves = F.sha2(canonical(*map(F.col, columns)), 256)
    part = lambda at: F.sum(F.conv(F.substring(halves, at, 8), 16, 10).cast("decimal(20,0)"))  # noqa: E731  sums don't depend on the order
    digest = F.sha2(F.concat_ws(",", *(F.coalesce(part(at), F.lit(0)).cast("string") for at in range(1, 64, 8))), 256)
    sidecar = back.agg(F.lit(database).alias("database"), F.lit(source).alias("source"), F.lit("title contains " + ", ".join(terms)).alias("filter"), F.count("*").alias("record_count"), digest.alias("rows_sha256"))
    sidecar.coalesce(1).write.json(f"{out}.meta")
    return spark.read.schema(sidecar.schema).json(f"{out}.meta")


def html_items(html: str) -> list[tuple[str, str, str, str]]:
    """S-08: (url, title, authors, year) of list items with a link; items without link or title are left out."""
    from html.parser import HTMLParser

    class Items(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out, self.url, self.title, self.rest, self.depth = [], None, "", "", 0

        def handle_starttag(self, tag, attrs) -> None:
            if tag == "li":
                self.close_item()
                self.depth = 1
            elif tag == "a" and self.depth and self.url is None:
                self.url, self.depth = dict(attrs).get("href"), 2

        def handle_endtag(self, tag) -> None:
            if tag == "a" and self.depth == 2:
                self.depth = 1
            elif tag in ("li", "ul", "ol"):
                self.close_item()

        def handle_data(self, data) -> None:
            if self.depth == 2:
                self.title += data
            elif self.depth:
                self.rest += data

        def close_item(self) -> None:
            title = " ".join(self.title.split())
            if self.url and title:
                m = re.search(r"(?P<authors>.+?)\s*\((?P<year>\d{4})\)\s*:", " ".join(self.rest.split()))
                self.out.append((self.url, title, m["authors"] if m else "", m["year"] if m else ""))
            self.url, self.title, self.rest, self.depth = None, "", "", 0

    p = Items()
    p.feed(html)
    p.close()
    p.close_item()
    return p.out


def html_lists(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S-08, S-09: key, pos, url, title, authors, year of the linked list items of each page."""
    import pandas as pd

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, p, *x) for k, h in zip(f["k"], f["h"], strict=True) for p, x in enumerate(html_items(h or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "url", "title", "authors", "year"])

    return pages.select(F.col(key).alias("k"), F.col("html").alias("h")).mapInPandas(parse, f"{key} bigint, pos bigint, url string, title string, authors string, year string")


#: Control files of an import folder, which hold no records.
CONTROL_FILES = ("screening_review.csv", "evidence_review.csv", "review_packet_manifest.json")
FILE_FIELDS = ("kind", "file", "status", "error", "sha256")


def parse_import(name: str, raw: bytes) -> list[dict[str, str]]:
    """The records of one export: a CSV with its own header, a JSON list (or an object's list called records), or BibTeX."""
    import csv
    import io
    import json

    text, suffix = raw.decode("utf-8"), name.lower().rsplit(".", 1)[-1]
    if suffix == "json":
        found = json.loads(text)
        found = found if isinstance(found, list) else found.get("records", [])
        if not isinstance(found, list):
            raise ValueError("export must contain a list of records")
        return [r if isinstance(r, dict) else {"title": str(r)} for r in found]
    if suffix in ("bib", "bibtex"):
        return [{**e, "authors": e.get("author", ""), "identifier": e.get("eprint", "")} for e in bibtex_entries(text)]
    return list(csv.DictReader(io.StringIO(text, newline="")))


def _imported(spark: SparkSession, folder: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of records and files, sidecars).  A file is a row and is parsed by itself."""
    import pandas as pd

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    sidecars = whole.filter(F.col("file").endswith(".meta.json")).select(F.regexp_replace("file", "\\.meta\\.json$", "").alias("of"), F.decode("content", "UTF-8").alias("meta"))
    wanted = F.lower("file").rlike("[.](json|csv|bib|bibtex)$") & ~F.col("file").endswith(".meta.json") & ~F.col("file").startswith("README") & ~F.col("file").isin(*CONTROL_FILES)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for f in frames:
            out = []
            for name, raw in zip(f["file"], f["content"], strict=True):
                digest = hashlib.sha256(raw).hexdigest()
                try:
                    records = parse_import(name, bytes(raw))
                except Exception as e:  # the file's failure is a row of the ledger
                    out.append(("file", name, "parse-error", str(e)[:200], digest, *[None] * len(fields)))
                    continue
                out.append(("file", name, "imported", "", digest, *[None] * len(fields)))
                out += [("record", name, "", "", digest, *[None if r.get(x) is None else str(r[x]) for x in fields]) for r in records]
            yield pd.DataFrame(out, columns=[*FILE_FIELDS, *[f"f_{x}" for x in fields]], dtype=object)

    schema = ", ".join(f"`{c}` string" for c in [*FILE_FIELDS, *[f"f_{x}" for x in fields]])
    return whole.filter(wanted).select("file", "content").mapInPandas(parse, schema), sidecars


def _with_sidecar(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds meta: the sidecar named after the file, else that named after its stem."""
    exact, loose = sidecars.select(F.col("of").alias("_e"), F.col("meta").alias("_me")), sidecars.select(F.col("of").alias("_s"), F.col("meta").alias("_ms"))
    stem = F.regexp_replace("file", "\\.[A-Za-z]+$", "")
    return rows.join(exact, F.col("file") == F.col("_e"), "left").join(loose, stem == F.col("_s"), "left").withColumn("meta", F.coalesce("_me", "_ms")).drop("_e", "_s", "_me", "_ms")


def imports(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """S-06, U-12: records of all CSV, JSON and BibTeX files of a folder, with their file and the sidecar's database.

    A sidecar is named after the file (x.csv.meta.json) or its stem (x.meta.json); the first goes before.  Each CSV has its own
    header.  Control files are no exports; files that can't be read give no records, but a row in import_ledger().
    """
    rows, sidecars = _imported(spark, folder, fields)
    found = _with_sidecar(rows.filter("kind = 'record'"), sidecars)
    return found.select("file", *[F.col(f"f_{f}").alias(f) for f in fields], F.get_json_object("meta", "$.database").alias("database"))


def import_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """S-06: file, status, records, provenance_complete and error of each export: a file that can't be read is no abort, but a row."""
    rows, sidecars = _imported(spark, folder, ["title"])
    counts = rows.filter("kind = 'record'").groupBy(F.col("file").alias("_f")).agg(F.count("*").alias("records"))
    met = _with_sidecar(rows.filter("kind = 'file'"), sidecars).join(counts, F.col("file") == F.col("_f"), "left")
    told = F.get_json_object("meta", "$.sha256")
    hash_ok = told.isNull() | (F.lower(told) == F.col("sha256"))
    has = lambda *paths: F.coalesce(*[F.nullif(F.trim(F.get_json_object("meta", f"$.{p}")), F.lit("")) for p in paths]).isNotNull()
    complete = F.coalesce(hash_ok & has("database", "source_database") & has("source_url", "url") & has("retrieved_at", "accessed_at") & has("query_or_filter", "query"), F.lit(False))
    status = F.when((F.col("status") == "imported") & ~hash_ok, "imported-provenance-incomplete").otherwise(F.col("status"))
    return met.select("file", status.alias("status"), F.coalesce("records", F.lit(0)).alias("records"), complete.alias("provenance_complete"), "error")


def append_log(rows: DataFrame, path: str) -> None:
    """K-06: rows at the end of a log; what is there stays."""
    rows.write.mode("append").json(path)


def replace(rows: DataFrame, path: str, suffix: str) -> None:
    """K-05, K-09: an explicit replacement: the old folder moves aside under a suffix, the new one is written beside it and renamed."""
    spark = rows.sparkSession
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staging = f"{path.rstrip('/')}.staging"
    rows.write.mode("overwrite").parquet(staging)
    if fs.exists(place(path)):
        if fs.exists(place(path + suffix)):
            raise FileExistsError(path + suffix)
        fs.rename(place(path), place(path + suffix))
    fs.rename(place(staging), place(path))


POINTER = "CURRENT"


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the current one: the pointer is written aside and renamed over the old one in one step of the file system."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    aside, pointer = hadoop.Path(f"{path}/.{version}"), hadoop.Path(f"{path}/{POINTER}")
    out = aside.getFileSystem(conf).create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(aside.getFileSystem(conf).getUri(), conf)
    context.rename(aside, pointer, over)


def publish(rows: DataFrame, path: str) -> str:
    """K-02, K-03, K-05, K-09: a new version of a table, whole or not at all: its folder is written first, the pointer to it last.

    Readers see the old version until the pointer changes and the new one from then on; what stops in between leaves the old one and a
    folder that nothing points to.  Earlier versions stay until expire() takes them.  Of two writers the last to point wins.
    """
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{version}")
    _point(rows.sparkSession, path, version)
    return version


def current(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The published rows: of the version that the pointer names now, or of a given one."""
    return spark.read.parquet(f"{path}/{version or spark.read.text(f'{path}/{POINTER}').first()[0]}")


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes all but the current version and the ``keep`` newest older ones; newer folders, which a writer may be at, stay."""
    now = spark.read.text(f"{path}/{POINTER}").first()[0]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    older = sorted(f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith("v-") and f.getPath().getName() < now)
    gone = older[: max(0, len(older) - keep)]
    for v in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}"), True)
    return gone


def report(rows: DataFrame, title: str, columns: list[str]) -> str:
    """K-08: a Markdown table of a small aggregate."""
    from inkbed.functions.text import markdown_cell

    cells = rows.select(*[markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).collect()
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in cells)]) + "\n"


def publishable(files: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """K-10: the files (path) whose name is on the allow list."""
    return files.filter(F.regexp_extract("path", "([^/]+)$", 1).isin(*allowed))


def save(rows: DataFrame, path: str, by: str) -> None:
    """K-11: rows partitioned by a key; the partitions that they have are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """K-11: what save() wrote."""
    return spark.read.parquet(path)


def manifest_objects(rows: DataFrame, key: str, json: str) -> DataFrame:
    """S-04: the five lists of a protected-object manifest stacked: key, object_type, hash, content, line."""
    kinds = {"equations": "equation", "labels": "label", "citations": "citation", "displaymath": "displaymath", "tables": "table"}
    own = rows.select(key, F.from_json(json, ", ".join(f"{n} ARRAY<STRUCT<hash: STRING, content: STRING, line: BIGINT>>" for n in kinds)).alias("m"))
    none = F.array().cast("array<struct<hash:string,content:string,line:bigint>>")
    tagged = [_tagged(F.coalesce(f"m.{n}", none), k) for n, k in kinds.items()]
    return own.select(key, F.inline(F.concat(*tagged)))


def _tagged(found, kind: str):
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("object_type"), x["hash"].alias("hash"), x["content"].alias("content"), x["line"].alias("line")))


def json_page(rows: DataFrame, key: str, json: str, terms: tuple[str, ...]) -> DataFrame:
    """S-10: key, title, year of the records of JSON pages (results) whose title or abstract holds one of the terms."""
    found = rows.select(key, F.explode(F.from_json(json, "results ARRAY<STRUCT<title: STRING, displaydate: STRING, abstract: STRING>>")["results"]).alias("r"))
    text = F.lower(F.concat_ws(" ", "r.title", "r.abstract"))
    wanted = found.filter(F.exists(F.array(*map(F.lit, terms)), lambda w: F.contains(text, w)))
    return wanted.select(key, F.coalesce("r.title", F.lit("")).alias("title"), F.regexp_extract(F.coalesce("r.displaydate", F.lit("")), "\\b((?:19|20)[0-9]{2})\\b", 1).alias("year"))


def html_anchors(pages: DataFrame, key: str, pattern: str) -> DataFrame:
    """S-09: url, title, key of links (pattern: address and title as groups); of an address the first link wins."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("u"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("t"))
    links = pages.select(key, F.posexplode(both).alias("_i", "x"))
    first = F.min(F.struct(F.col(key).alias("k"), "_i", F.trim("x.t").alias("t")))
    return links.groupBy(F.col("x.u").alias("url")).agg(first.alias("_f")).select("url", F.col("_f.t").alias("title"), F.col("_f.k").alias(key))


def file_census(files: DataFrame, by: str, top: int = 5) -> DataFrame:
    """S-24: files, test files and the commonest suffixes (by count, then name) of each group of paths."""
    from pyspark.sql import Window as W

    name = F.regexp_extract("path", "([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))
    own = files.select(by, suffix.alias("_s"), (F.contains(F.lower(name), F.lit("test")) | F.col("path").rlike("(^|/)tests/")).alias("_t"))
    counts = own.filter("_s != ''").groupBy(by, "_s").agg(F.count("*").alias("_n")).withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("_n"), "_s"))).filter(F.col("_r") <= top)
    listed = counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", "_s", "_n"))).alias("_l")).select(by, F.array_join(F.transform("_l", lambda x: F.concat(x["_s"], F.lit(":"), x["_n"].cast("string"))), ", ").alias("languages"))
    return own.groupBy(by).agg(F.count("*").alias("files"), F.count_if("_t").alias("tests")).join(listed, by, "left")
