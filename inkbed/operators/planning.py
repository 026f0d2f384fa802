"""Rewrite plans and review ledgers: identifiers, context, ambiguity cases, obligations, registries, split trees, includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.session import ensure_checkpoints


def numbered(rows: DataFrame, by: list[str], order: list, pattern: str, name: str) -> DataFrame:
    """W-07, W-08: identifiers like S-0001 in order, counted for each group ``by``."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, F.format_string(pattern, n))


def context(units: DataFrame, spans: DataFrame, key: str, reach: int = 2) -> DataFrame:
    """M-06: for each unit (key, pos) its own text and that of up to ``reach`` neighbours on either side, in order."""
    near = units.select(key, F.col("pos").alias("unit"), F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos"))
    met = near.join(spans.select(key, "pos", "text"), [key, "pos"])
    part = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return met.groupBy(key, "unit").agg(part(F.col("pos") < F.col("unit")).alias("before"), part(F.col("pos") == F.col("unit")).alias("own"), part(F.col("pos") > F.col("unit")).alias("after"))


def ambiguity_cases(found: list[tuple[str, DataFrame]], key: str, by: str) -> DataFrame:
    """M-09, M-10: cases of several sources in the sources' order, numbered for each group ``by``."""
    out = None
    for i, (reason, rows) in enumerate(found):
        part = rows.select(by, F.col(key).alias("item"), F.lit(reason).alias("reason"), F.lit(i).alias("_source"))
        out = part if out is None else out.unionByName(part)
    return numbered(out, [by], ["_source", "item"], "A-%04d", "case_id").drop("_source")


def obligations(kind: Column) -> Column:
    """M-11: what a rewrite owes a concept, by its type (fixed values)."""
    owed = lambda *x: F.array(*map(F.lit, x))
    return F.when(kind == "definition", owed("state", "exemplify")).when(kind == "claim", owed("state", "support")).otherwise(owed("mention"))


def merge_registry(sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """J-18: one row for each key; each field from the first source in order that fills it."""
    tagged = None
    for i, s in enumerate(sources):
        part = s.select(key, *fields).withColumn("_p", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = lambda f: F.min(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct("_p", f)))[f]
    return tagged.groupBy(key).agg(*[first(f).alias(f) for f in fields], F.min("_p").cast("bigint").alias("priority"))


def best_match(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """J-19: the first row of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def split_leaves(items: DataFrame, key: str, order: str, size: str, most: int, depth: int = 3) -> DataFrame:
    """G-16, G-17: items of oversized jobs halved up to ``depth`` times: leaf is the path of halves, empty for a whole job."""
    out = items.withColumn("leaf", F.lit(""))
    for _ in range(depth):
        group = W.partitionBy(key, "leaf")
        half = F.floor((F.row_number().over(group.orderBy(order)) - 1) * 2 / F.count("*").over(group))
        too_large = (F.sum(size).over(group) > most) & (F.count("*").over(group) > 1)
        out = out.withColumn("_next", F.when(too_large, F.concat("leaf", half.cast("string"))).otherwise(F.concat("leaf", F.lit("."))))
        out = out.withColumn("leaf", F.col("_next")).drop("_next")
    return out.withColumn("leaf", F.replace("leaf", F.lit("."), F.lit("")))


def expand_includes(files: DataFrame, includes: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """S-21 to S-23: files reached from ``root`` with depth and the path of places, which sorts them in reading order; none is entered within itself.

    files: path; includes: path, place, target.  Rounds go on until one adds nothing, or to depth ``most`` where that is given.
    """
    ensure_checkpoints(files.sparkSession)
    at = files.filter(F.col("path") == root).select("path", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("ordinal"), F.array("path").alias("_seen")).checkpoint()
    found, depth = at, 0
    while depth != most and not at.isEmpty():
        depth += 1
        at = (
            at.join(includes, "path")
            .filter(~F.array_contains("_seen", F.col("target")))
            .select(F.col("target").alias("path"), F.lit(depth).cast("bigint").alias("depth"), F.concat("ordinal", F.format_string("/%06d", "place")).alias("ordinal"), F.concat("_seen", F.array("target")).alias("_seen"))
            .join(files.select("path"), "path", "left_semi")
            .checkpoint()
        )
        found = found.unionByName(at)
        if depth % 16 == 0:  # a short plan, however deep the includes are
            found = found.checkpoint()
    return found.drop("_seen")


def expand_text(files: DataFrame, root: str, pattern: str = "\\\\input\\{[^}]*\\}") -> DataFrame:
    """S-21, S-22: one row, path and text of ``root`` with included files (files: path, text) in the place of what names them.

    A file is not entered within itself: such an include, and one of a file that isn't there, becomes a line break.  Texts are cut at their
    includes; pieces have even places and files odd ones, so that the paths of places sort all pieces in reading order.
    """
    from .segment import matches

    found = matches(files, "path", "text", pattern)
    nth = F.row_number().over(W.partitionBy("path").orderBy("start"))
    includes = found.select("path", (nth * 2 - 1).alias("place"), F.regexp_extract("raw", "\\{([^}]*)\\}", 1).alias("target"))
    reached = expand_includes(files.select("path"), includes, root)
    pieces = files.select("path", F.posexplode(F.split("text", pattern)).alias("_i", "piece"))
    own = reached.join(pieces, "path").select(F.concat("ordinal", F.format_string("/%06d", F.col("_i") * 2)).alias("o"), "piece")
    named = reached.join(includes, "path").select(F.concat("ordinal", F.format_string("/%06d", "place")).alias("o"))
    lost = named.join(reached.select(F.col("ordinal").alias("o")), "o", "left_anti").select("o", F.lit("\n").alias("piece"))
    whole = own.unionByName(lost).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return whole.select(F.lit(root).alias("path"), "text")


def mutation_safety(units: DataFrame, before: DataFrame, after: DataFrame, baseline: DataFrame) -> DataFrame:
    """U-04: concepts of a unit that a rewrite drops, and ones it adds that neither unit nor baseline has."""
    lost = before.join(after, ["unit", "concept"], "left_anti").select("unit", "concept", F.lit("deletion").alias("problem"))
    new = after.join(before, ["unit", "concept"], "left_anti").join(baseline, "concept", "left_anti").select("unit", "concept", F.lit("addition").alias("problem"))
    return lost.unionByName(new).join(units, "unit", "left_semi")


def rewrite_mutations(units: DataFrame, before: DataFrame, after: DataFrame, baseline: DataFrame, outputs: DataFrame, least: int = 10) -> DataFrame:
    """U-04: mutation_safety(), concepts that are mentioned only (after has mapping), and outputs (unit, text) of fewer than ``least`` characters."""
    moved = mutation_safety(units, before.select("unit", "concept"), after.select("unit", "concept").distinct(), baseline)
    mentioned = after.filter("mapping = 'mention_only'").select("unit", "concept", F.lit("mention_only").alias("problem"))
    short = units.join(outputs, "unit", "left").filter(F.length(F.trim(F.coalesce("text", F.lit("")))) < least).select("unit", F.lit(None).cast(before.schema["concept"].dataType).alias("concept"), F.lit("truncation").alias("problem"))
    return moved.unionByName(mentioned).unionByName(short)


def revision_failures(rows: DataFrame, key: str, old: str, new: str, protected: list[str], exempt: tuple[str, ...] = ()) -> DataFrame:
    """U-07: key, failure, what: citations, protected texts and numbers (but for exempt digits) that a revision drops, first-person words that
    it brings; an empty revision has no other failure."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"({p})"), F.lit(1)))
    numbers = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.col(c), F.lit("([0-9][0-9,.{}\\\\]*[0-9]|[0-9])"), F.lit(1)), lambda n: F.regexp_replace(n, "[{},\\\\]", "")), lambda n: (F.length(n) > 1) | ~n.isin(*exempt, "")))
    person = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("(?i)\\b(we|us|our|I|me|my)\\b"), F.lit(1)))
    held = F.filter(F.array(*map(F.lit, protected)).cast("array<string>"), lambda x: F.contains(F.col(old), x) & ~F.contains(F.col(new), x))
    empty = F.trim(F.col(new)) == ""
    cases = [
        ("dropped citation", F.array_except(found(old, "\\\\cite\\{[^}]+\\}"), found(new, "\\\\cite\\{[^}]+\\}"))),
        ("removed protected object", held),
        ("dropped number", F.array_except(numbers(old), numbers(new))),
        ("introduced first person", F.array_except(person(new), person(old))),
    ]
    each = F.flatten(F.array(*[_named(name, c) for name, c in cases]))
    all_ = F.when(empty, F.array(F.struct(F.lit("empty revision").alias("failure"), F.lit("").alias("what")))).otherwise(each)
    return rows.select(key, F.inline(all_))


def _named(name: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(name).alias("failure"), x.alias("what")))
