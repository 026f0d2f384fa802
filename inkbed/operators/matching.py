"""Matching of two versions and deduplication of records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkbed.session import written


def kth_match(a: DataFrame, b: DataFrame, keys: list[str], order: str = "start") -> DataFrame:
    """J-14: the k-th of equal objects of a meets the k-th of b: keys, k, a_start, b_start (null where one lacks)."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    x = a.select(*keys, F.col(order).alias("a_start"), number.alias("k"))
    y = b.select(*keys, F.col(order).alias("b_start"), number.alias("k"))
    return x.join(y, [*keys, "k"], "full")


def nearest_greedy(a: DataFrame, b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """J-13: one to one, in a's order: each takes the nearest b of its keys that is free and nearer than ``most``; ties: the earlier b.

    a and b have keys, id and at.  Greedy choice needs the order, so each group of keys is a row of two sorted lists, of which a worker
    takes many at once.  Groups that lack a side are gone before.
    """
    import pandas as pd

    listed = lambda rows, name: rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("a"), F.col("id").alias("i")))).alias(name))
    kinds = a.select(*keys).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["a_id bigint", "b_id bigint", "distance bigint"])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        for f in frames:
            out = []
            for *key, left, right in zip(*(f[c] for c in [*keys, "_l", "_r"]), strict=True):
                free = [(x["a"], x["i"]) for x in right]
                for x in left:
                    at = x["a"]
                    p = bisect.bisect_left(free, (at,))
                    near = [(abs(free[q][0] - at), free[q][0], q) for q in (p - 1, p) if 0 <= q < len(free)]
                    if near and (best := min(near))[0] < most:
                        q = best[2]
                        while q and free[q - 1][0] == free[q][0]:
                            q -= 1
                        out.append((*key, x["i"], free[q][1], best[0]))
                        del free[q]
            yield pd.DataFrame(out, columns=[*keys, "a_id", "b_id", "distance"])

    renamed = listed(b, "_r").select(*[F.col(k).alias(f"_{k}") for k in keys], "_r")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return listed(a, "_l").join(renamed, same).select(*keys, "_l", "_r").mapInPandas(match, schema)


def correspondence(a: DataFrame, b: DataFrame, most: int = 1000) -> DataFrame:
    """X-08: key, object_type, a_start, b_start, status of the objects of two versions.

    Equal normal forms meet k by k (unchanged, or explained_change where only the raw form differs); of the rest each object takes, in
    order, the nearest free one of its type that is nearer than ``most`` (substantive_change); what is left is removed or added.
    Objects: key, object_type, normal, raw, start.  Only the rest of one key and type is gathered in a task.
    """
    keys, group = ["key", "object_type", "normal"], ["key", "object_type"]
    number = F.row_number().over(W.partitionBy(*keys).orderBy("start"))
    x = a.select(*keys, F.col("raw").alias("a_raw"), F.col("start").alias("a_start"), number.alias("k"))
    y = b.select(*keys, F.col("raw").alias("b_raw"), F.col("start").alias("b_start"), number.alias("k"))
    both = x.join(y, [*keys, "k"], "full")
    status = F.when(F.col("a_raw") == F.col("b_raw"), "unchanged").otherwise("explained_change")
    same = both.filter("a_start IS NOT NULL AND b_start IS NOT NULL").select(*group, "a_start", "b_start", status.alias("status"))
    old = both.filter("b_start IS NULL").select(*group, F.col("a_start").cast("bigint").alias("id"), F.col("a_start").cast("bigint").alias("at"))
    new = both.filter("a_start IS NULL").select(*group, F.col("b_start").cast("bigint").alias("id"), F.col("b_start").cast("bigint").alias("at"))
    near = nearest_greedy(old, new, group, most)
    changed = near.select(*group, F.col("a_id").alias("a_start"), F.col("b_id").alias("b_start"), F.lit("substantive_change").alias("status"))
    left = lambda rows, side: rows.join(near.select(*group, F.col(side).alias("id")), [*group, "id"], "left_anti")
    none = F.lit(None).cast("bigint")
    removed = left(old, "a_id").select(*group, F.col("id").alias("a_start"), none.alias("b_start"), F.lit("removed").alias("status"))
    added = left(new, "b_id").select(*group, none.alias("a_start"), F.col("id").alias("b_start"), F.lit("added").alias("status"))
    return same.unionByName(changed).unionByName(removed).unionByName(added)


def resolved(found: DataFrame, least: float = 0.5) -> DataFrame:
    """X-09: adds confidence (0.7 for matches by place alone, else 1) and makes what is under ``least`` unresolved."""
    confidence = F.when(F.col("status") == "substantive_change", 0.7).otherwise(1.0)
    return found.withColumn("confidence", confidence).withColumn("status", F.when(F.col("confidence") < least, "unresolved").otherwise(F.col("status")))


def first_filled(field: Column, order: Column) -> Column:
    """The first value that isn't empty, in order."""
    filled = field.isNotNull() & (field.cast("string") != "")
    return F.min(F.when(filled, F.struct(order.alias("o"), field.alias("v"))))["v"]


def dedup_merge(rows: DataFrame, identity: Column, order: str, fields: list[str]) -> DataFrame:
    """A-07: one row for each identity: the first filled value of each field, members and the first row's order."""
    keyed = rows.withColumn("identity", identity)
    return keyed.groupBy("identity").agg(*(first_filled(F.col(f), F.col(order)).alias(f) for f in fields), F.min(order).alias("first_seen"), F.count("*").alias("members"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A-08, S-17: the first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def token_jaccard(a: DataFrame, b: DataFrame, a_id: str, b_id: str, least: float) -> DataFrame:
    """J-12, C-10: pairs of token sets whose Jaccard similarity is at least ``least``.

    a and b have an id and an array column tokens of distinct tokens; empty sets match nothing; b is the larger side.  Sets of b that are too large for any
    of a are gone first, and what is left is written once.  Tokens are put in one order: those of one side alone, then those of both sides, rare ones
    first.  Similar sets share a token within their first n - ceil(least * n) + 1, so only those meet in an index, and only where enough tokens follow
    in both; tokens of one side are but counted.  Then whole sets are compared.
    """
    x = a.select(F.col(a_id).alias("_a"), "tokens", F.size("tokens").alias("_n")).transform(written)
    fits = F.size("tokens") * least - 1e-9 <= x.agg(F.max("_n")).scalar()
    y = b.select(F.col(b_id).alias("_b"), "tokens").filter(fits).select("_b", "tokens", F.size("tokens").alias("_m")).transform(written)
    words = lambda rows, *keys: rows.select(*keys, F.explode("tokens").alias("token"))
    of_x = words(x).groupBy("token").agg(F.count("*").alias("_x"))
    often = words(y).join(of_x, "token").groupBy("token").agg((F.count("*") + F.max("_x")).alias("_often")).transform(written)

    def prefix(rows: DataFrame, key: str, size: str, place: str) -> DataFrame:
        shared, own, n = words(rows, key, size).join(often, "token"), W.partitionBy(key), F.col(size)
        placed = shared.withColumn(place, n - F.count("*").over(own) + F.row_number().over(own.orderBy("_often", "token")))
        return placed.filter(F.col(place) <= n - F.ceil(n * least - 1e-9) + 1).select("token", key, size, place)

    met = prefix(x, "_a", "_n", "_i").join(prefix(y, "_b", "_m", "_j"), "token").filter(F.least("_n", "_m") >= least * F.greatest("_n", "_m") - 1e-9)
    # the first token that two sets share has at least as many behind it as they need in common
    enough = F.least(F.col("_n") - F.col("_i"), F.col("_m") - F.col("_j")) + 1 >= (F.col("_n") + F.col("_m")) * (least / (1 + least)) - 1e-9
    pairs = met.filter(enough).select("_a", "_b").distinct().join(x.select("_a", F.col("tokens").alias("_x")), "_a").join(y.select("_b", F.col("tokens").alias("_y")), "_b")
    score = F.size(F.array_intersect("_x", "_y")) / F.size(F.array_union("_x", "_y"))
    return pairs.select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), score.alias("similarity")).filter(F.col("similarity") >= least)


def kept_sentences(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places (i, j), both ascending, of the sentences of ``old`` that stay in ``new``, by an anchored diff in time n log n a level.

    What both begin and end with stays.  Between, the sentences that occur once in either are anchors: the longest run of them that is
    ascending in both stays, and the stretches between anchors are looked at alone.  A stretch without such sentences takes the k-th of
    equal sentences with the k-th as anchors, once.
    """
    import bisect
    from collections import Counter

    out: list[tuple[int, int]] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        n, m = Counter(old[a:b]), Counter(new[c:d])
        at = {new[j]: j for j in range(c, d) if m[new[j]] == 1}
        pairs = [(i, at[old[i]]) for i in range(a, b) if n[old[i]] == 1 and old[i] in at]
        unique = bool(pairs)
        if not unique:
            places: dict[str, list[int]] = {}
            for j in range(c, d):
                places.setdefault(new[j], []).append(j)
            seen: Counter = Counter()
            for i in range(a, b):
                k, seen[old[i]] = seen[old[i]], seen[old[i]] + 1
                if k < m[old[i]]:
                    pairs.append((i, places[old[i]][k]))
        ends: list[int] = []  # of the best run of each length: the least last place in new
        last: list[int] = []
        before = [-1] * len(pairs)
        for p, (_, j) in enumerate(pairs):
            q = bisect.bisect_left(ends, j)
            ends[q : q + 1], last[q : q + 1] = [j], [p]
            before[p] = last[q - 1] if q else -1
        run, p = [], last[-1] if last else -1
        while p >= 0:
            run.append(pairs[p])
            p = before[p]
        run.reverse()
        out += run
        if unique:
            for (i, j), (x, y) in zip([(a - 1, c - 1), *run], [*run, (b, d)], strict=True):
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def added_sentences(pairs: DataFrame) -> DataFrame:
    """X-06: sentences of new that an anchored diff doesn't find in old at their place: key, pos, sentence.

    Where no sentence is repeated, what stays is a longest common run.  A matcher by longest blocks may keep others of repeated or moved
    sentences.  Null texts have no sentences; a pair is one row of a task, in time n log n for nearly all texts.
    """
    import pandas as pd

    def diff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for f in frames:
            out = []
            for key, old, new in zip(f["key"], f["old"], f["new"], strict=True):
                x, y = ([s for s in re.split(r"(?<=[.!?])\s+", t or "") if s] for t in (old, new))
                stay = {j for _, j in kept_sentences(x, y)}
                out += [(key, p, s) for p, s in enumerate(y) if p not in stay]
            yield pd.DataFrame(out, columns=["key", "pos", "sentence"])

    return pairs.select("key", "old", "new").mapInPandas(diff, "key string, pos bigint, sentence string")
