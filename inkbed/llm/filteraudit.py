"""Filter interaction audit by an incidence matrix product.

Five filters give each document a mask of 32 values.  For each part of the corpus, a row of 32 counts says how many documents have
each mask; two more rows count the good and the toxic ones alone.  What a filter does at a step of an order depends on the mask and
nothing else, so four matrices of 32 by 600 zeros and ones (600: 120 orders of five steps) turn these rows into all outcomes:
kept, removed, redundant and unique.  Texts are read once; no order is ever run.

Scale: texts never move.  A row of some 60 bytes for each document (digest, id, mask of four filters, part) meets the least id of
its text by (digest, id), which no group of copies makes hot, and its labels by id; histograms are summed before the shuffle.
The product reads one row for each part, in as many tasks as there are, with matrices that depend on the filters alone.

Defined cases: a null text is empty, a null part is the empty string; empty texts equal each other; a document without id is no
copy and no original of others; repeated rows of the least id are all originals; of several labels for one id, any positive one
counts; very long texts are arrays of words in one row; extra columns are not carried, so their names don't matter; an empty table
has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import let, split_words
from .tables import kept

#: Filters in order of their bits; the last one is decided by the table and not by the text.
FILTERS = "ABCDE"
#: Conditions of failure on the measurements of a text.
CONDITIONS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_chars",
    "D": "has_symbol",
}
SYMBOLS = "[#$%&*|]"
KINDS = ("kept", "removed", "redundant", "unique_fails")
LABELS = ("n", "good", "toxic")
OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the bits of the filters that a text decides (bigint)."""
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counts = let(split_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    rows = text.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        counts.alias("_c"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.col("text").rlike(SYMBOLS).alias("has_symbol"),
    ).select("*", F.col("_c.n_words").cast("bigint").alias("n_words"), F.col("_c.n_distinct").cast("bigint").alias("n_distinct"))
    bits = [F.when(F.expr(CONDITIONS[f]), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS) if f in CONDITIONS]
    return rows.select("doc_id", "part", "digest", sum(bits[1:], bits[0]).cast("bigint").alias("mask"))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask with all five bits: a text that any smaller doc_id has, too, fails the last filter."""
    rows = kept(measured(docs), "masks")  # the texts are read once
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    bit = 1 << FILTERS.index("E")
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, bit).otherwise(0)).alias("mask"))


def histograms(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part: three arrays (all, good, toxic documents) of counts by mask."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))))
    rows = masked.join(said, "doc_id", "left").select("part", "mask", F.lit(1).alias("n"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    cells = rows.groupBy("part", "mask").agg(*(F.sum(x).alias(x) for x in LABELS))
    return cells.groupBy("part").agg(*(F.array(*(F.sum(F.when(F.col("mask") == m, F.col(x)).otherwise(0)) for m in range(1 << len(FILTERS)))).alias(x) for x in LABELS))


def incidence(filters: str = FILTERS):
    """(orders, matrices): for each kind of outcome a matrix of masks by (order, step), and one that adds up removed by filter.

    A column is one step of one order.  For the mask of a document: it was removed before if it has a bit of an earlier filter.
    """
    import numpy as np

    orders = ["".join(p) for p in permutations(filters)]
    mask = np.arange(1 << len(filters))[:, None]
    here = np.array([[1 << filters.index(f) for f in o] for o in orders])
    before = np.cumsum(here, axis=1) - here
    here, before = here.ravel()[None, :], before.ravel()[None, :]
    gone, fails = (mask & before) != 0, (mask & here) != 0
    found = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": np.broadcast_to(mask == here, gone.shape)}
    found = {k: v.astype(np.int64) for k, v in found.items()}
    found["shapley"] = found["removed"] @ (here.T == here).astype(np.int64)  # of a filter: over all columns that are its steps
    return orders, found


def outcomes(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Histogram rows times matrices: one row for each part, order and step."""
    import pyarrow as pa

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        orders, m = incidence(filters)
        names, steps = np.repeat(orders, len(filters)), np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders))
        for b in batches:
            h = {x: np.array(b.column(x).to_pylist(), dtype=np.int64).reshape(b.num_rows, -1) for x in LABELS}
            for at in range(0, b.num_rows, 64):  # parts at a time, so that what a task holds is bounded
                part = b.column("part").slice(at, 64)
                rows = {x: v[at : at + 64] for x, v in h.items()}
                values = [rows["n"] @ m[k] for k in KINDS] + [rows[x] @ m["removed"] for x in ("good", "toxic")] + [rows["n"] @ m["shapley"]]
                k = len(part)
                columns = [part.take(pa.array(np.repeat(np.arange(k), len(names)))), pa.array(np.tile(names, k)), pa.array(np.tile(steps, k)), *(pa.array(v.ravel()) for v in values)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return counts.select("part", *LABELS).mapInArrow(product, OUT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, by part."""
    return outcomes(histograms(masks(docs), labels))
