"""Benchmark decontamination by winnowing (native).

Of each ``span - k + 1`` neighbouring k-gram hashes of a text the least is kept.  Two texts that share ``span``
words in a row keep at least one k-gram in common, so the join of the kept hashes finds every document that
holds a window of an item.  Those few documents are then extended: all their windows meet the items' windows,
which gives the words that are hit and the items, exactly.

An item of fewer than ``span`` words, but not none, is one window of its own length; documents for those are found
by their n-grams of just that length (winnowing with a window of one).

Words: A-Z in lower case, runs of ASCII digits, a-z and characters beyond ASCII.

Scale: one pass over the corpus makes the kept hashes and the n-grams of short items' lengths and meets them at once with those
of the items, which are broadcast only while there are no more than BROADCAST_ROWS of them (16 bytes each), else everything is
shuffled; documents that share a popular item are rows of a join, never gathered in one task; hits are gathered by document.

Defined cases: null and empty texts have no words and no hits; items without words have no window; a document is its doc_id and
text, so rows without doc_id and rows of one doc_id with different texts are judged one by one, and repeated rows alike;
very long texts are arrays of words in one row; an item's repeated rows are one item; extra columns are not read, so
their names don't matter; an empty benchmark or empty documents give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import NOT_ITEM_WORD, ascii_lower, gram_hashes, let, split_words
from .tables import kept

SPAN, K = 13, 5
#: The most item fingerprints that are broadcast: 32 MB.
BROADCAST_ROWS = 2_000_000
#: A document counts as contaminated from one hit word in so many on.
SHARE = 20


def item_words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_ITEM_WORD)


def _hashes(words: Column, *salt: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w, *salt))


def winnow(hashes: Column, k: int, width: int) -> Column:
    """The least k-gram hash of each width neighbouring k-grams, each once; of fewer k-grams, the least of all."""

    def least(grams: Column) -> Column:
        if width == 1:
            return grams
        full = F.slice(grams, 1, F.greatest(F.size(grams) - (width - 1), F.lit(1)))
        return F.transform(full, lambda g, i: F.least(g, *[F.get(grams, i + j) for j in range(1, width)]))

    return F.array_distinct(let(gram_hashes(hashes, k), least))


def _sized(rows: DataFrame) -> DataFrame:
    """A broadcast hint for a written table, if its count allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def fingerprints(texts: DataFrame, key: str, span: int = SPAN, k: int = K) -> DataFrame:
    """key, n_words and the array of kept hashes of each text."""
    words = texts.select(key, item_words(F.col("text")).alias("w"))
    return words.select(key, F.size("w").cast("bigint").alias("n_words"), winnow(_hashes(F.col("w")), k, span - k + 1).alias("prints"))


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, its window length n, and two hashes of each window, which together stand for it."""
    words = items.select("item_id", item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    parts = []
    for n in range(1, span + 1):
        own = words.filter(F.size("w") >= span if n == span else F.size("w") == n)
        parts.append(_windows(own, ["item_id"], n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "n", "h", "g").distinct()


def _windows(words: DataFrame, key: list[str], n: int) -> DataFrame:
    """The key's columns, n, at, h, g: each run of n words (column w) with its place."""
    pairs = F.arrays_zip(
        gram_hashes(_hashes(F.col("w")), n).alias("h"),
        gram_hashes(_hashes(F.col("w"), F.lit("g")), n).alias("g"),
    )
    return words.select(*key, F.posexplode(pairs).alias("at", "x")).select(*key, F.lit(n).alias("n"), "at", F.col("x.h").alias("h"), F.col("x.g").alias("g"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both, _a and _b, that tell documents apart, be doc_id null or repeated."""
    own = [F.col("doc_id"), F.coalesce("text", F.lit(""))]
    return docs.select("doc_id", "text", F.xxhash64(F.lit("a"), *own).alias("_a"), F.xxhash64(F.lit("b"), *own).alias("_b"))


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(counts, found): doc_id, key (_a, _b) and n_words of every document; key, at, n, item_id of each window of an item in one."""
    windows = kept(item_windows(items, span), "windows")
    short = sorted(r["n"] for r in windows.filter(F.col("n") < span).select("n").distinct().collect())  # less than span numbers
    salted = lambda n: lambda h: F.xxhash64(h, F.lit(n))  # noqa: E731  so that lengths don't meet
    prints = fingerprints(items, "item_id", span, k).filter(F.col("n_words") >= span).select(F.explode("prints").alias("h"))
    wanted = prints.unionByName(windows.filter(F.col("n") < span).select(F.xxhash64("h", "n").alias("h"))).distinct()
    wanted = kept(wanted.withColumn("_hit", F.lit(True)), "wanted")
    hashes = lambda w: F.concat(
        winnow(w, k, span - k + 1), *[F.transform(F.array_distinct(gram_hashes(w, n)), salted(n)) for n in short]
    )
    words = keyed(docs).select("doc_id", "_a", "_b", item_words(F.col("text")).alias("w"))
    made = words.select("doc_id", "_a", "_b", F.size("w").cast("bigint").alias("n_words"), let(_hashes(F.col("w")), hashes).alias("_h"))
    met = made.select("doc_id", "_a", "_b", "n_words", F.posexplode_outer("_h").alias("_at", "h")).join(_sized(wanted), "h", "left")
    first = F.coalesce("_at", F.lit(0)) == 0
    met = kept(met.filter(first | F.col("_hit")).select("doc_id", "_a", "_b", "n_words", first.alias("_first"), F.col("_hit").isNotNull().alias("_hit")), "met")
    candidates = kept(met.filter("_hit").select("_a", "_b").distinct(), "candidates")
    own = keyed(docs).select("_a", "_b", "text").join(_sized(candidates), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    own = kept(own.select("_a", "_b", item_words(F.col("text")).alias("w")), "words")
    places = None
    for n in [*short, span]:
        part = _windows(own, ["_a", "_b"], n)
        places = part if places is None else places.unionByName(part)
    found = places.join(_sized(windows), ["n", "h", "g"]).select("_a", "_b", "at", "n", "item_id")
    return met.filter("_first").select("doc_id", "_a", "_b", "n_words"), found


def judge(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, share: int = SHARE) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return judged(docs, items, span, k, share).drop("_a", "_b")


def judged(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, share: int = SHARE) -> DataFrame:
    """judge() with the documents' keys, _a and _b."""
    counts, found = hits(docs, items, span, k)
    found, key = kept(found, "found"), ["_a", "_b"]
    spans = found.groupBy(*key, "at").agg(F.max("n").alias("n"))
    before = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    fresh = spans.withColumn("_to", F.max(end).over(before)).select(*key, F.greatest(F.lit(0), end - F.greatest("at", F.coalesce("_to", F.lit(0)))).alias("fresh"))
    covered = fresh.groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = found.select(*key, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        counts.join(covered, key, "left")
        .join(named, key, "left")
        .select("doc_id", *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("_items"))
        .select(
            "doc_id",
            *key,
            "n_words",
            "n_hit",
            F.size("_items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, share: int = SHARE) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = kept(judged(docs, items, span, k, share).filter("contaminated").select("_a", "_b").distinct(), "contaminated")
    text = [docs["doc_id"], F.coalesce(docs["text"], F.lit(""))]
    return docs.join(_sized(bad), (F.xxhash64(F.lit("a"), *text) == bad["_a"]) & (F.xxhash64(F.lit("b"), *text) == bad["_b"]), "left_anti")
