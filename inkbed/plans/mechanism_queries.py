"""Queries by Spark's own mechanisms: a state machine over a stream, table functions called laterally, split files; and critics' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbed.functions import text as T
from inkbed.operators import responses
from inkbed.session import new_folder
from inkbed.sources import latex, records
from inkbed.streaming import repairs

from .base import MANUSCRIPTS, ORACLES, manuscripts, query

_OUTCOME = "CASE WHEN length(coalesce(text, '')) % 11 = 0 THEN 'converged' WHEN length(text) % 13 = 0 THEN 'unresolvable' ELSE 'failed' END"
_SIGNATURE = "concat('s', length(coalesce(text, '')) % 7)"
_CYCLES = f"SELECT conv_id, turn, {_OUTCOME} AS outcome, {_SIGNATURE} AS signature FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"
_VERDICTS = f"""
WITH c AS ({_CYCLES}), u AS (SELECT conv_id, turn, max({{'o': outcome, 's': signature}}) AS b FROM c GROUP BY ALL),
w AS (SELECT conv_id, b.o AS outcome, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, row_number() OVER (PARTITION BY conv_id, b.s ORDER BY turn) > 1 AS again FROM u),
y AS (SELECT *, CASE WHEN outcome <> 'failed' THEN outcome WHEN again THEN 'oscillating' WHEN place = 5 THEN 'timeout' END AS why FROM w),
f AS (SELECT conv_id, count(*) AS n, min(place) FILTER (WHERE why IS NOT NULL) AS place, arg_min(why, place) FILTER (WHERE why IS NOT NULL) AS why FROM y GROUP BY conv_id)
SELECT conv_id::VARCHAR AS session, coalesce(why, 'unresolvable') AS outcome, coalesce(place, n)::BIGINT AS cycles, (n - coalesce(place, n))::BIGINT AS ignored FROM f"""
#: Loads of a replay, and the seconds by which a row may come after its time.
LOADS, DELAY = 4, 300


def _cycles(t):
    return t("conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("bigint").alias("cycle"), F.expr(_OUTCOME).alias("outcome"), F.expr(_SIGNATURE).alias("signature"), "conv_id"
    )


@query("repair_sessions", _VERDICTS)
def repair_sessions(t):
    """M-07: turns as repair cycles, at once."""
    return repairs.repair_batch(_cycles(t), 5)


@query("repair_stream", _VERDICTS)
def repair_stream(t):
    """M-07, W-13 to W-17: the same as a stream.  Rows come in the order of their time and a delay by hash, so sessions mix and cycles swap; four
    loads are written one after another, and the stream may wait for one load's span."""
    rows = _cycles(t)
    spark = rows.sparkSession
    source, sink, state = (new_folder(spark, n) for n in ("cycles", "verdicts", "state"))
    second = F.col("conv_id") * 2 + F.col("cycle") + 1_700_000_000  # a stream's watermark begins at 1970, where rows are late from the start
    timed = rows.select("session", "cycle", "outcome", "signature", second.alias("_s"), (second + F.abs(F.xxhash64("session", "cycle")) % DELAY).alias("_arrival"))
    first, last = timed.agg(F.coalesce(F.min("_arrival"), F.lit(0)), F.coalesce(F.max("_arrival"), F.lit(0))).first()
    span = (last - first) // LOADS + 1
    stamped = timed.select("session", "cycle", "outcome", "signature", F.timestamp_seconds("_s").alias("ts"), F.floor((F.col("_arrival") - first) / span).alias("_load"))
    late = span + DELAY
    end = spark.range(1).select(*(F.lit(None).cast(d).alias(c) for c, d in (("session", "string"), ("cycle", "bigint"), ("outcome", "string"), ("signature", "string"))), F.timestamp_seconds(F.lit(last + 10 * (late + DELAY))).alias("ts"))
    for load in range(LOADS):
        stamped.filter(F.col("_load") == load).drop("_load").write.mode("append").parquet(source)
    end.write.mode("append").parquet(source)
    repairs.replay(spark, source, "session string, cycle bigint, outcome string, signature string, ts timestamp", sink, state, files_per_trigger=64, most=5, gap=DELAY, late=late)
    return spark.read.schema(repairs.OUT).parquet(sink)


@query("lateral_regions", ORACLES["latex_partition"])
def lateral_regions(t):
    """G-01 to G-07 as a table function in SQL: the same rows as latex_partition."""
    files = manuscripts(t("documents"))
    latex.register_table_functions(files.sparkSession)
    parts = files.sparkSession.sql("SELECT f.doc_id, r.* FROM {files} f, LATERAL latex_regions(f.revised) r", files=files)
    from pyspark.sql import Window as W

    bad = (F.col("start") != F.coalesce(F.lag("end").over(W.partitionBy("doc_id").orderBy("start")), F.lit(0))).cast("int")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "region"))), lambda x: x["region"]), "")
    return parts.withColumn("_bad", bad).groupBy("doc_id").agg(
        F.sum(F.length("region")).alias("chars"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_bad").alias("problems"),
        F.count_if(F.col("kind") == "heading").alias("headings"), F.sha2(joined, 256).alias("joined"),
    )


@query("lateral_objects", f"""
WITH {MANUSCRIPTS}, o AS (
  SELECT doc_id, 'citation' AS object_type, unnest(regexp_extract_all(revised, '\\\\cite\\{{[^}}]*\\}}')) AS raw FROM ms
  UNION ALL SELECT doc_id, 'label', unnest(regexp_extract_all(revised, '\\\\label\\{{[^}}]*\\}}')) FROM ms)
SELECT doc_id, object_type, raw, count(*)::BIGINT AS n FROM o GROUP BY ALL""")
def lateral_objects(t):
    """G-09 to G-11 in SQL: citations and labels of each file, by a table function that keeps two types."""
    files = manuscripts(t("documents"))
    latex.register_table_functions(files.sparkSession)
    return files.sparkSession.sql(
        "SELECT f.doc_id, o.object_type, o.raw, count(*) AS n FROM {files} f, LATERAL latex_objects(f.revised, 'citation,label') o GROUP BY ALL", files=files
    )


_WORDS = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.]+', ' ', 'g'))"


def _bib(t) -> str:
    """Documents as BibTeX files in the shared folder: the words of the text as title, the source as author."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.]+", " "))
    i = F.col("doc_id").cast("string")
    entry = F.concat(F.lit("@article{k"), i, F.lit(",\n title = {"), words, F.lit('},\n author="'), F.coalesce("source", F.lit("")), F.lit('", year = '), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit(",\n note={doi 10.1234/x"), i, F.lit("}\n}\n"))
    docs = t("documents")
    path = new_folder(docs.sparkSession, "bib")
    docs.filter("doc_id IS NOT NULL").select(entry.alias("value")).write.text(path)
    return path


@query("bibtex_split", f"SELECT 'article' AS kind, 'k' || doc_id AS key, {_WORDS} AS title, trim(coalesce(source, '')) AS author, (1990 + doc_id % 30)::VARCHAR AS year, '10.1234/x' || doc_id AS doi FROM documents WHERE doc_id IS NOT NULL")
def bibtex_split(t):
    """S-07: files of entries, read in splits, each entry once."""
    path = _bib(t)
    return records.bibtex_files(t("documents").sparkSession, path).select("kind", "key", "title", "author", "year", "doi")


_TERMS = ("time", "data", "work")
_TITLE = f"trim(regexp_replace(lower({_WORDS}), '[^a-z0-9]+', ' ', 'g'))"


@query("bibliography_export", f"""
SELECT {_WORDS} AS title, trim(coalesce(source, '')) AS authors, (1990 + doc_id % 30)::VARCHAR AS year, '10.1234/x' || doc_id AS doi, count(*) OVER ()::BIGINT AS record_count FROM documents
WHERE doc_id IS NOT NULL AND ({" OR ".join(f"contains({_TITLE}, '{w}')" for w in _TERMS)})""")
def bibliography_export(t):
    """S-11: the entries whose titles hold a term, as sorted CSV with a sidecar, read back with the sidecar's count."""
    spark = t("documents").sparkSession
    out = new_folder(spark, "export")
    sidecar = records.export_bibliography(records.bibtex_files(spark, _bib(t)), out, "Anthology", "documents", _TERMS)
    rows = spark.read.schema("title string, authors string, year string, doi string, url string, abstract string, database string").option("header", True).option("escape", '"').csv(out)
    return rows.na.fill("").select("title", "authors", "year", "doi").withColumn("record_count", F.lit(sidecar.first()["record_count"]))


@query("critic_verdicts", """
WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL), v AS (SELECT *, unnest(range(1 + n % 3)) AS i FROM a WHERE n % 10 > 1)
SELECT doc_id AS window_id, CASE WHEN (n + i) % 5 = 0 THEN '' ELSE 'c' || i END AS concept_id, CASE (n + i) % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'unresolved' END AS verdict,
       CASE WHEN (n + i) % 3 = 0 THEN 0.5 ELSE (n % 8) / 8 END AS confidence, (i % 2)::BIGINT AS evidence FROM v""")
def critic_verdicts(t):
    """M-03: answers of a critic, made of the lengths of the texts: abstentions, broken JSON, fields left out."""
    return responses.critic_verdicts(_answers(t))


def _answers(t):
    n = F.length(F.coalesce("text", F.lit("")))

    def item(i):
        m = n + i
        return F.struct(
            F.when(m % 5 != 0, F.concat(F.lit("c"), i.cast("string"))).alias("concept_id"), F.when(m % 4 == 0, "supported").when(m % 4 == 1, "contradicted").alias("verdict"),
            F.when(m % 3 != 0, n % 8 / 8).alias("confidence"), F.when(i % 2 == 1, F.array(F.lit("s1"))).alias("evidence_span_ids"),
        )

    answer = F.to_json(F.transform(F.sequence(F.lit(0), n % 3), item))
    text = F.when(n % 10 == 1, F.concat(F.lit("["), answer)).otherwise(answer)
    return t("documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("window_id"), F.when(n % 10 == 0, "too_long").alias("abstention"), text.alias("text"))


@query("critic_gaps", """
WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL), c AS (SELECT *, unnest(range(2)) AS i FROM a)
SELECT doc_id AS window_id, 'c' || i AS concept_id, CASE WHEN n % 10 < 2 OR n % 3 < i OR (n + i) % 5 = 0 THEN 'unjudged' WHEN (n + i) % 4 = 1 THEN 'contradicted' ELSE 'unresolved' END AS reason
FROM c WHERE n % 10 < 2 OR n % 3 < i OR (n + i) % 5 = 0 OR (n + i) % 4 <> 0""")
def critic_gaps(t):
    """M-03: of two concepts of each document those that the critic didn't confirm."""
    concepts = t("documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("window_id"), F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("concept_id"))
    return responses.critic_gaps(concepts, responses.critic_verdicts(_answers(t)))


_ODD = "translate(coalesce(text, ''), 'eio', chr(160) || chr(8195) || chr(12288))"


@query("unicode_space", f"SELECT doc_id, trim(regexp_replace({_ODD}, '{T.UNICODE_SPACE}+', ' ', 'g')) AS form FROM documents")
def unicode_space(t):
    """C-01: three letters of each text become white space beyond ASCII."""
    odd = F.translate(F.coalesce("text", F.lit("")), "eio", "\u00a0\u2003\u3000")
    return t("documents").select("doc_id", T.normal_form(odd).alias("form"))
