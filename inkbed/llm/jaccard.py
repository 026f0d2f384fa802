"""n-gram Jaccard join: a size-aware, heavy-light set similarity join over distinct word shingles.

Documents of the same word sequence are one class, and a class one set.  Then, exactly and for thresholds by whole
numbers (100 * intersection >= percent * union):

1. Unique shingles.  A set with more than a quarter of shingles that no other set has (at 75 %) can't be linked.  A
   fixed share of all shingles, chosen by their hash, is enough to tell that of almost all sets; the others go on.
2. Shared shingles.  Among the sets that are left all shingles are counted so, and those that only one has are set aside: no
   intersection holds them, so the others bound each set's intersections.
3. Prefixes.  Shingles are put in one order, unique ones first and then rare ones (by a count-min sketch; it bears only on
   speed).  Linked sets share a shingle within their first n - ceil(t n) + 1.
4. Light sets, of up to a boundary size, meet by fixed-size subsets: linked sets share two shingles within prefixes longer by
   one, so they meet under pairs of shingles, which are far more selective.  Heavy sets are found by scanning inverted
   lists of single shingles.  The boundary is where the number of subsets outgrows the length of the lists, summed over
   the sets of each size.
5. Lists.  Each entry of a list is first compared with the list's most copied set, its hub, and with its neighbour by size
   (long lists in parts).  Links make components; then whatever has a hub in common but not yet a component is compared, where
   sizes allow a link: entries of a group's largest component only with others, in tiles of bounded size.  So a group of near
   copies costs rows in proportion to its size and all links between components are found.  A set's prefix holds a shingle of
   a common template only if less than a quarter of its shared shingles are rarer, so what meets there has most in common.

Scale: shuffles carry a share of the shingles' hashes (once), prefixes of the sets that are left, the sets themselves where they
are more than can be sent to all tasks, and the sets of candidate pairs, never texts.  Tasks send at most two rows for a
shingle that many documents share; hubs are found by partial aggregation, and long lists are read in parts by several tasks.

Defined cases: null and empty texts have no shingles and link with nothing; texts of fewer words than a shingle have one, their
whole sequence; very long texts are slices of their own; documents without doc_id are in their class but never its name; rows of
one doc_id with different texts are different sets, repeated rows are one; ties between hubs go to the least class; extra columns
are not read, so their names don't matter; empty tables give empty ones.  Hashes are 64 bits: classes of 10**9 different
texts meet a collision with a chance of some 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import LOWER_BYTE, each_slice, mixed, sorted_distinct, span_hash, word_spans
from .components import components
from .tables import discard, kept, short_batches

WORDS, PERCENT = 5, 75
#: Share of all shingles whose uniqueness is counted, and counters of the sketch (4 bytes each).
UNIQUE_SHARE, COUNTERS = 0.36, 1 << 18
#: Blocks in which the counters are added up, and groups of tasks in the first step.
BLOCKS, SALTS = 16, 256
FLUSH_ROWS = 1 << 18
BROADCAST_ROWS = 1_000_000
#: Largest size of a set that is considered as light: beyond, a set has over twice as many subsets as shingles.
LIGHT_MOST = 64
#: Entries of a list that one task reads at once, about.
LIST_BLOCK = 1000
#: Entries of a tile's two sides, and shingles of the second, about.
ONE_BLOCK, OTHER_BLOCK, TILE_SHINGLES = 256, 2048, 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles in order, and for each text the hash of its whole word sequence."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    h = span_hash(3)
    data = LOWER_BYTE[data]
    words = mixed(h.spans(h.prefix(data), starts, ends))
    text = np.repeat(np.arange(n), np.diff(first))
    odd = [pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(k)]
    # the whole sequence: words times powers of an odd number by their place, summed
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    power = np.full(int(place.max()) + 1 if len(place) else 1, 0xD1342543DE82EF95, np.uint64)
    power[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.multiply.accumulate(power)[place], dtype=np.uint64)])
    whole = mixed(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    count = max(0, len(words) - k + 1)
    gram = np.zeros(count, np.uint64)
    for j in range(k):
        gram += words[j : j + count] * np.uint64(odd[j])
    own = text[:count] == text[k - 1 : k - 1 + count]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    of, hashes = np.concatenate([text[:count][own], few]), np.concatenate([mixed(gram[own]), whole[few]])
    order = np.argsort(of, kind="stable")
    of, hashes = sorted_distinct(of[order], hashes[order])
    return of, hashes, whole


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in each_slice(batch.column("text")):
            of, _, whole = shingles(data, offsets)
            n = np.bincount(of, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "class", "n"])


def _first_and_last(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Of each shingle, the least and the greatest class, which tell whether it has more than one."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    edge = h[1:] != h[:-1]
    first, last = np.concatenate([[True], edge]), np.concatenate([edge, [True]])
    last &= ~first | (np.concatenate([c[1:] != c[:-1], [False]]))
    keep = first | last
    return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].view(np.int64))], ["h", "class"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size, limit = [], 0, np.uint64(int(UNIQUE_SHARE * 2**64))
    for batch in batches:
        for _, _, data, offsets in each_slice(batch.column("text")):
            of, h, whole = shingles(data, offsets)
            own = h < limit
            parts.append((h[own], whole[of[own]]))
            size += int(own.sum())
            if size >= FLUSH_ROWS:
                yield _first_and_last(*map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [], 0
    if size:
        yield _first_and_last(*map(np.concatenate, zip(*parts, strict=True)))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns as they come, and the class of the text."""
    for batch in batches:
        for lo, hi, data, offsets in each_slice(batch.column("text")):
            whole = shingles(data, offsets)[2]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(whole.view(np.int64))], [*batch.schema.names, "class"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in each_slice(batch.column("text")):
            of, h, whole = shingles(data, offsets)
            cuts = np.searchsorted(of, np.arange(hi - lo + 1)) * 8
            raw = h.tobytes()
            sets = pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(whole.view(np.int64)), pa.array(np.diff(cuts) // 8), sets], ["doc_id", "class", "n", "shingles"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        for node, x in zip(batch.column("node").to_numpy(), batch.column("shingles"), strict=True):
            h = _hashes(x)
            parts.append((h, np.full(len(h), node).view(np.uint64)))
            size += len(h)
            if size >= FLUSH_ROWS:
                yield _first_and_last(*map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [], 0
    if size:
        yield _first_and_last(*map(np.concatenate, zip(*parts, strict=True)))


def _without_unique(percent: int):
    """Sets of shared shingles only; sets that are too few of these for any link are gone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rest = [], []
            for i, (x, alone, n) in enumerate(zip(batch.column("shingles"), batch.column("unique"), batch.column("n").to_pylist(), strict=True)):
                h = _hashes(x)
                if alone.is_valid:
                    h = h[np.isin(h, alone.values.to_numpy().view(np.uint64), invert=True)]
                if len(h) >= _needed(n, percent):
                    keep.append(i)
                    rest.append(h.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "copies", "n")), pa.array([len(x) // 8 for x in rest], pa.int64()), pa.array(rest, pa.binary())], ["node", "copies", "n", "shared", "shingles"])

    return task


def _hashes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int32)
    for batch in batches:
        for x in batch.column("shingles"):
            np.add.at(counts, _counter(_hashes(x)), 1)
    blocks = counts.reshape(BLOCKS, -1)
    some = [i for i in range(BLOCKS) if blocks[i].any()]
    if some:
        from pyspark import TaskContext

        salt = pa.array([TaskContext.get().partitionId() % SALTS] * len(some), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), salt, pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "salt", "counts"])


def sketch(sets: DataFrame) -> np.ndarray:
    """Counters of the shingles' sets: a fixed number, whatever the input.

    Tasks' counters are added up by block and salt and then by block, so no group holds a row for each task.
    """

    def added(key, rows):
        import pandas as pd

        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in rows["counts"])
        return pd.DataFrame({"block": [int(key[0])], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int32)
    parts = sets.select("shingles").mapInArrow(_counted, "block int, salt int, counts binary")
    some = parts.groupBy("block", "salt").applyInPandas(added, "block int, counts binary")
    for r in some.groupBy("block").applyInPandas(added, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


def _needed(n: np.ndarray | int, percent: int):
    """Least intersection of a set of n with any set that it is linked with."""
    return -(-percent * n // 100)


def _ordered(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return h[np.lexsort((h, counts[_counter(h)]))]


def boundary(costs: dict[int, tuple[float, float]]) -> int:
    """The size up to which subsets cost less than lists: costs has, by size, the totals of (subsets, lists)."""
    best, at, saved = 0.0, 0, 0.0
    for n in sorted(costs):
        saved += costs[n][1] - costs[n][0]
        if saved > best:
            best, at = saved, n
    return at


def _costs(sets: DataFrame, counts_: object, percent: int) -> dict[int, tuple[float, float]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = counts_.value, {}
        for batch in batches:
            for x, n in zip(batch.column("shingles"), batch.column("n").to_pylist(), strict=True):
                h = _hashes(x)
                need = _needed(n, percent)
                p = len(h) - need + 1  # the unique ones come first in the prefix and are in no list
                if need < 2 or p < 1:
                    continue
                est = np.sort(counts[_counter(h)])[:p].sum()
                a, b = total.get(n, (0.0, 0.0))
                total[n] = (a + (p + 1) * p / 2, b + float(est))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k][0] for k in keys], pa.float64()), pa.array([total[k][1] for k in keys], pa.float64())], ["n", "subsets", "lists"])

    rows = sets.filter(F.col("n") <= LIGHT_MOST).select("n", "shingles").mapInArrow(task, "n bigint, subsets double, lists double")
    return {r["n"]: (r["subsets"], r["lists"]) for r in rows.groupBy("n").agg(F.sum("subsets").alias("subsets"), F.sum("lists").alias("lists")).collect()}


def _postings(counts_: object, light: int, percent: int):
    """Rows (key, node, copies, n, shared): where a set is to be met."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_.value
        for batch in batches:
            keys, which = [], []
            for i, (x, n) in enumerate(zip(batch.column("shingles"), batch.column("n").to_pylist(), strict=True)):
                h = _hashes(x)
                need = _needed(n, percent)
                if need < 1:
                    continue
                rare = _ordered(h, counts)
                if n > light or need < 2 or 100 * n >= percent * (light + 1):  # met by heavy sets, or too small for subsets
                    keys.append(rare[: len(h) - need + 1])
                    which.append(np.full(len(keys[-1]), i))
                if n <= light and need >= 2:
                    longer = rare[: len(h) - need + 2]
                    a, b = np.triu_indices(len(longer), 1)
                    keys.append(mixed(longer[a] * np.uint64(0x9E3779B97F4A7C15) + longer[b] + np.uint64(1)))
                    which.append(np.full(len(a), i))
            if keys:
                at = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), *(batch.column(c).take(at) for c in ("node", "copies", "n", "shared"))], ["key", "node", "copies", "n", "shared"]
                )

    return task


def _verified(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            total = (batch.column("m").to_numpy() + batch.column("n").to_numpy()).tolist()
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                a, b = _hashes(x), _hashes(y)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                if 100 * both >= percent * (total[i] - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return task


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those that are linked, by all their shared shingles."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), "n", F.col("shingles").alias("y"))
    return kept(pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_verified(percent), "a bigint, b bigint"), "links")


def _tile(percent: int):
    """Links between a block of entries outside the largest component and a block of all entries of a group."""
    import pandas as pd

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        one, other = rows[rows["one"]], rows[~rows["one"]]
        out = []
        if len(one) and len(other):
            sets = [np.frombuffer(x, np.uint64) for x in other["shingles"]]
            ids, at = np.unique(np.concatenate(sets), return_inverse=True)
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            nodes, n, part = (other[c].to_numpy() for c in ("node", "n", "part"))
            for node, size, own, raw in zip(one["node"], one["n"], one["part"], one["shingles"], strict=True):
                h = np.frombuffer(raw, np.uint64)
                place = np.minimum(np.searchsorted(ids, h), len(ids) - 1)
                mark = np.zeros(len(ids), np.int64)
                mark[place[ids[place] == h]] = 1
                sums = np.concatenate([[0], np.cumsum(mark[at])])
                both = sums[cuts[1:]] - sums[cuts[:-1]]
                for m in nodes[(100 * both >= percent * (size + n - both)) & (part != own)]:
                    out.append((min(node, m), max(node, m)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return task


def _tiles(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compares the entries of a group that are outside its largest component with all of it, in tiles of bounded size.

    Sets of linked sizes are in the same size class or in neighbouring ones.  Rows grow with the entries times the number of
    blocks, not with the pairs.
    """
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    near = F.array(own - 1, own, own + 1) if percent < 100 else F.array(own)
    one = open_.filter("part != _largest").select("hub", "node", "part", F.explode(near).alias("size"))
    other = open_.select("hub", "node", "part", "n", own.alias("size"))
    counts = other.groupBy("hub", "size").agg(F.count("*").alias("_others"), F.sum("n").alias("_n")).join(one.groupBy("hub", "size").agg(F.count("*").alias("_ones")), ["hub", "size"])
    blocks = kept(
        counts.select("hub", "size", F.ceil(F.col("_ones") / ONE_BLOCK).alias("_i"), F.ceil(F.greatest(F.col("_others") / OTHER_BLOCK, F.col("_n") / TILE_SHINGLES)).alias("_j")), "blocks"
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    one = one.join(blocks, ["hub", "size"]).select("hub", "size", "node", "part", F.lit(True).alias("one"), block("_i").alias("i"), upto("_j").alias("j"))
    other = other.drop("n").join(blocks, ["hub", "size"]).select("hub", "size", "node", "part", F.lit(False).alias("one"), upto("_i").alias("i"), block("_j").alias("j"))
    whole = one.unionByName(other).join(sets.select("node", "n", "shingles"), "node")
    return whole.groupBy("hub", "size", "i", "j").applyInPandas(_tile(percent), "a bigint, b bigint").distinct()


def classes_and_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, links): doc_id, class and n of every document; class and least (its least doc_id); linked classes (a, b).

    Links are as many as it takes to connect all that is connected; copies are links of their class.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    profiles = kept(texts.mapInArrow(_profiles, "doc_id bigint, class bigint, n bigint"), "profiles")
    unique = (
        texts.select("text").mapInArrow(_sampled, "h bigint, class bigint")
        .groupBy("h").agg(F.min("class").alias("class"), F.max("class").alias("_last")).filter("class = _last")
        .groupBy("class").agg(F.count("*").alias("unique"))
    )
    named = profiles.groupBy("class", "doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows")))
    classes = named.groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.sum("rows").alias("copies"), first["rows"].alias("rows"))
    classes = kept(classes.join(unique, "class", "left").withColumn("unique", F.coalesce("unique", F.lit(0))), "classes")
    left = classes.filter((F.col("n") > 0) & F.col("least").isNotNull() & (100 * (F.col("n") - F.col("unique")) >= percent * F.col("n")))
    wanted = left.select(F.col("least").alias("doc_id"), "class", "copies")
    some = texts
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
        some = texts.join(F.broadcast(left.select(F.col("least").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = some.mapInArrow(_sets, "doc_id bigint, class bigint, n bigint, shingles binary").join(wanted, ["doc_id", "class"])
    sets = sets.select(F.col("class").alias("node"), "copies", "n", "shingles")
    if not left.filter("rows > 1").isEmpty():  # the same row more than once
        sets = sets.dropDuplicates(["node"])
    whole = kept(sets, "sets")
    sets = whole
    owned = sets.select("node", "shingles").mapInArrow(_owned, "h bigint, class bigint").groupBy("h").agg(F.min("class").alias("node"), F.max("class").alias("_last"))
    alone = owned.filter("node = _last").groupBy("node").agg(F.collect_list("h").alias("unique"))
    shared = sets.join(alone, "node", "left").select("node", "copies", "n", "shingles", "unique")
    sets = kept(shared.mapInArrow(_without_unique(percent), "node bigint, copies bigint, n bigint, shared bigint, shingles binary"), "shared")
    counts = docs.sparkSession.sparkContext.broadcast(sketch(sets))  # COUNTERS * 4 bytes
    light = boundary(_costs(sets, counts, percent))
    discard(whole)
    postings = kept(sets.mapInArrow(_postings(counts, light, percent), "key bigint, node bigint, copies bigint, n bigint, shared bigint"), "postings")
    top = F.max(F.struct("copies", (-F.col("n")).alias("n"), F.bitwise_not("node").alias("node"), "shared"))
    tops = postings.groupBy("key").agg(top.alias("_top"), F.count("*").alias("_many")).filter("_many > 1")
    hub = F.struct((-F.col("_top.n")).alias("n"), F.bitwise_not("_top.node").alias("node"), F.col("_top.shared").alias("shared"))
    tops = kept(tops.select("key", hub.alias("hub"), F.ceil(F.col("_many") / LIST_BLOCK).alias("_parts")), "tops")
    own = F.struct("n", "node", "shared")
    lists = postings.join(tops, "key").withColumn("_salt", F.pmod(F.xxhash64("node"), F.col("_parts")))
    before = F.lag(own).over(W.partitionBy("key", "_salt").orderBy("n", "node"))
    lists = kept(lists.select("key", own.alias("x"), "hub", before.alias("before")), "lists")
    discard(postings, tops)

    def fits(x: str, y: str):
        """Sizes, and shingles that any other set has, which allow a link."""
        return (100 + percent) * F.least(f"{x}.shared", f"{y}.shared") >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
        fit = rows.filter(fits(x, y) & (F.col(f"{x}.node") != F.col(f"{y}.node")))
        return fit.select(F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b"))

    first = kept(ordered(lists, "x", "hub").unionByName(ordered(lists.filter("before IS NOT NULL"), "x", "before")).distinct(), "pairs")
    links = _linked(first, sets, percent)
    parts = components(links).select(F.col("node").alias("_node"), F.col("component").alias("part"))
    # everything that shares a list is in the group of the list's hub
    groups = lists.select(F.col("hub.node").alias("hub"), F.col("x.node").alias("node"), F.col("x.n").alias("n")).distinct()
    groups = groups.join(parts, F.col("node") == F.col("_node"), "left").select("hub", "node", "n", F.coalesce("part", "node").alias("part"))
    per_part = groups.groupBy("hub", "part").agg(F.count("*").alias("_many"))
    largest = per_part.groupBy("hub").agg(F.max(F.struct("_many", "part")).alias("_l"), F.count("*").alias("_parts")).filter("_parts > 1")
    largest = kept(largest.select("hub", F.col("_l.part").alias("_largest")), "largest")
    open_ = kept(groups.join(largest, "hub"), "open")
    more = kept(_tiles(open_, sets, percent), "links")
    discard(first, lists, largest, open_, sets)
    return profiles, classes.select("class", "least"), links.unionByName(more)


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each document: doc_id, class, n_shingles, part (the least class that links lead to) and component_id."""
    profiles, classes, links = classes_and_links(docs, percent)
    found = components(links).select(F.col("node").alias("class"), F.col("component").alias("part"))
    least = kept(found.join(classes, "class").groupBy("part").agg(F.min("least").alias("_least")), "least")
    found = kept(found.join(least, "part"), "named")
    # written before the join with all documents, so that a class of many copies can be split there
    names = kept(classes.join(found, "class", "left").select("class", F.coalesce("part", "class").alias("part"), F.coalesce("_least", "least").alias("_least")), "names")
    own = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id"))
    return profiles.join(names, "class").select("doc_id", "class", F.col("n").alias("n_shingles"), "part", own.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each document: doc_id, n_shingles and component_id, the least doc_id that links lead to, itself included."""
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id")


def classed(docs: DataFrame) -> DataFrame:
    """All columns of docs as the struct _row, and the class of the text."""
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("class", T.LongType())])
    return rows.mapInArrow(_classed, schema).select("_row", "class")
