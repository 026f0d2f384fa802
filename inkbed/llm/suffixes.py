"""Removal of repeated byte strings: a depth-limited radix sort of suffixes.

Suffixes are ordered by their bytes through ``depth`` and no further, most significant digit first: passes over digits of
eight bytes, at depth 0, 8, 16 and so on, each of which sends on only the groups of two or more.  What is still together
after the last digit are exactly the repeated windows; all but the earliest of a group are removed.  Bytes decide, not hashes.

Suffixes come to the sort in buckets, and neighbours travel together:

1. Sampling.  A window's anchor is its least hashed k-gram.  Equal windows have equal anchors at equal places, so windows whose
   anchor is nowhere else are single and gone before the sort.  Neighbouring windows with one anchor are a run, a row of some
   numbers.  A task first takes out runs that are equal to an earlier one of its own (by two 64-bit hashes).
2. Dealing.  The bytes of the runs that are left are packed by bucket, the hash of what all their windows have in common: at
   first the anchor.
3. Buckets that are too large for one task, such as that of a line that a third of all documents hold in different
   surroundings, are dealt again by longer common parts: a run is cut into thirds of the places that an anchor can have, ninths,
   and so on, down to single windows, whose bucket is that of their whole bytes and needs no more room than its distinct ones.
4. Sorting, as above, bucket by bucket.  Whole runs are sorted first, so that the windows of equal runs are sorted once.

Scale: one row for about 24 bytes of text is shuffled in step 1, and a task sends one row for each anchor and FLUSH_BYTES of text
at most; runs that it knows to share an anchor are spread over all tasks.  Packed bytes are compressed.  Text is shuffled twice,
to meet its runs and its spans.  No step gathers more than MOST_BYTES of a bucket.

Defined cases: null texts are empty; texts shorter than the depth lose nothing; very long texts are read in overlapping
pieces; documents without doc_id lose nothing and make no other lose anything; rows repeated with the same doc_id are one
document and get the same result; of strings that start at the same place of the same document all are the earliest; extra
columns are not read and may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buffers import each_slice, mixed, span_hash
from .tables import discard, drop_shuffles, kept, short_batches

DEPTH, GRAM, DIGIT = 100, 32, 8
#: Bytes of text, and of runs, after which a task sends on what it has.
FLUSH_BYTES, PACK_BYTES = 16 << 20, 8 << 20
#: Bytes of runs in a bucket: so many on average, and at most in one task at a time.
BUCKET_BYTES, MOST_BYTES = 1 << 20, 4 << 20
#: Bytes of a very long text that are read at once.
PIECE = 1 << 19
#: Bits of a row's place for its windows and its anchor, and the anchors that mark a span that is covered and a mere mark.
PLACE_BITS, COVERED, MARK = 12, (1 << 12) - 1, (1 << 12) - 2


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its least one, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    v, at, covered = values, np.arange(len(values), dtype=np.int32), 1
    while covered < width:
        step = min(covered, width - covered)
        later = v[step:] < v[:-step]
        v, at = np.where(later, v[step:], v[:-step]), np.where(later, at[step:], at[:-step])
        covered += step
    return at[:n]


def pieces(column: pa.Array, overlap: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, bases, bytes, offsets) of slices; a very long text comes in pieces that overlap, each with its place in the text."""
    for lo, hi, data, offsets in each_slice(column, size):
        if hi - lo > 1 or len(data) <= 2 * size:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data, offsets
        else:
            for at in range(0, max(1, len(data) - overlap), size):
                part = data[at : at + size + overlap]
                yield np.array([lo]), np.array([at]), part, np.array([0, len(part)])


def runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, anchor, run, off): windows lo..hi (both in) of a text that share an anchor.

    anchor and run are the hashes of the anchor and of all bytes of the windows, off is the anchor's place after lo.  Places are
    relative to the text.
    """
    grams = mixed(span_hash(1).windows(span_hash(1).prefix(data), gram))
    least = leftmost_least(grams, depth - gram + 1)
    if not len(least):
        return (np.zeros(0, np.int64),) * 6
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[: len(least)]
    place = np.arange(len(least))
    valid = place + depth <= offsets[1:][text]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (text[1:] == text[:-1]))
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    whole = span_hash(2)
    run = mixed(whole.spans(whole.prefix(data), lo, hi + depth) + (least[lo] - lo).astype(np.uint64))
    base = offsets[text[lo]]
    return text[lo].astype(np.int64), lo - base, hi - base, grams[least[lo]].view(np.int64), run.view(np.int64), least[lo].astype(np.int64) - lo


def _repeated(key: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """True for all but the earliest (doc, lo) of each key; rows at the same earliest place are both the earliest."""
    order = np.lexsort((lo, doc, key))
    k, d, p = key[order], doc[order], lo[order]
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        same = k[1:] == k[:-1]
        moved = same & ((d[1:] != d[:-1]) | (p[1:] != p[:-1]))
        group = np.concatenate([[0], np.cumsum(~same)])
        seen = np.concatenate([[0], np.cumsum(moved)])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        out[order] = seen > seen[first][group]
    return out


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of half-open spans of each document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    # a running maximum within each document, by lifting each above all earlier ones
    lift = np.cumsum(first).astype(np.int64) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + lift) - lift
    new = first.copy()
    new[1:] |= lo[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return doc[begin], lo[begin], reach[np.append(begin[1:], len(doc)) - 1]


_RUN = "deal bigint, doc_id bigint, place bigint, more bigint"


def _rows(deal, doc, place, more) -> pa.RecordBatch:
    """place is lo, the windows after it and the anchor's place in one number; more is a covered span's end, or 1 for a sure run."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (deal, doc, place, more)], ["deal", "doc_id", "place", "more"])


def _anywhere(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mixed((doc * np.int64(0x9E3779B1) + lo).view(np.uint64)).view(np.int64)


def _sent(parts: list[tuple[np.ndarray, ...]], depth: int) -> Iterator[pa.RecordBatch]:
    """Runs to meet those of other tasks by their anchor, runs that share one here already, and spans that are repeats for certain."""
    if not parts:
        return
    anchor, run, doc, lo, hi, off = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((run, anchor))
    key = np.empty(len(order), np.int64)  # a number for each pair of anchor and run
    key[order] = np.cumsum(np.concatenate([[0], (anchor[order][1:] != anchor[order][:-1]) | (run[order][1:] != run[order][:-1])]))
    old = _repeated(key, doc, lo)
    place = (lo << 2 * PLACE_BITS) | ((hi - lo) << PLACE_BITS) | off
    d, a, b = _merged(doc[old], lo[old], hi[old] + depth)
    if len(d):
        yield _rows(_anywhere(d, a), d, (a << 2 * PLACE_BITS) | COVERED, b)
    _, at, many = np.unique(anchor[~old], return_inverse=True, return_counts=True)
    sure = many[at] > 1
    left = [x[~old] for x in (anchor, doc, place, lo)]
    yield _rows(*(x[~sure] for x in left[:3]), np.zeros(int((~sure).sum())))
    if sure.any():
        yield _rows(_anywhere(left[1][sure], left[3][sure]), left[1][sure], left[2][sure], np.ones(int(sure.sum())))
        marks = np.unique(left[0][sure])
        yield _rows(marks, np.zeros(len(marks)), np.full(len(marks), MARK), np.zeros(len(marks)))


def _runs_of(depth: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for texts, bases, data, offsets in pieces(batch.column("text"), depth - 1):
                text, a, b, anchor, run, off = runs(data, offsets, depth, gram)
                parts.append((anchor, run, ids[texts[text]], a + bases[text], b + bases[text], off))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield from _sent(parts, depth)
                    parts, size = [], 0
        yield from _sent(parts, depth)

    return task


# --- buckets of packed runs

_PACK = "bucket bigint, size bigint, runs binary"


class Runs:
    """Windows lo to lo + n - 1 of doc for each run, the anchor's place after lo, and the bytes of all windows."""

    def __init__(self, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray, data: np.ndarray, depth: int) -> None:
        self.doc, self.lo, self.n, self.off, self.data, self.depth = doc, lo, n, off, data, depth
        self.ends = np.cumsum(n + depth - 1)
        self.starts = self.ends - (n + depth - 1)

    def take(self, at: np.ndarray, first: np.ndarray | int = 0, n: np.ndarray | None = None) -> Runs:
        """Of the runs at some places the n windows from the first on (all by default)."""
        n = self.n[at] if n is None else n
        data = self.data[_ranges(self.starts[at] + first, n + self.depth - 1)]
        return Runs(self.doc[at], self.lo[at] + first, n, self.off[at] - first, data, self.depth)

    def cells(self, width: int) -> tuple[Runs, np.ndarray]:
        """The runs cut by cells of ``width`` places of the anchor, and the hash of what all windows of a cell have in common."""
        far = self.off // width  # windows come in falling order of the anchor's place
        parts = far - (self.off - self.n + 1) // width + 1
        at = np.repeat(np.arange(len(self.n)), parts)
        cell = far[at] - (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts))
        high = np.minimum(self.off[at], (cell + 1) * width - 1)
        low = np.maximum(self.off[at] - self.n[at] + 1, cell * width)
        anchor = self.starts[at] + self.off[at]
        h = span_hash(2)
        core = h.spans(h.prefix(self.data), anchor - cell * width, anchor - (cell + 1) * width + 1 + self.depth)
        return self.take(at, self.off[at] - high, high - low + 1), mixed(core + cell.astype(np.uint64))

    def pack(self) -> bytes:
        numbers = [np.array([len(self.n)], np.int64), self.doc.astype(np.int64), self.lo.astype(np.int64), self.n.astype(np.int16), self.off.astype(np.int16)]
        return b"".join([*(x.tobytes() for x in numbers), self.data.tobytes()])

    @staticmethod
    def unpack(raw: bytes, depth: int) -> Runs:
        (k,) = np.frombuffer(raw, np.int64, 1)
        doc, lo = np.frombuffer(raw, np.int64, 2 * k, 8).reshape(2, k)
        n, off = np.frombuffer(raw, np.int16, 2 * k, 8 + 16 * k).reshape(2, k).astype(np.int64)
        return Runs(doc, lo, n, off, np.frombuffer(raw, np.uint8, offset=8 + 20 * k), depth)

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("doc", "lo", "n", "off", "data")), parts[0].depth)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def widths(depth: int, gram: int) -> list[int]:
    """Widths of cells by level: all places that an anchor can have in a window, a third of them, and so on down to one."""
    n, out = depth - gram + 1, [depth - gram + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // 3))
    return out if n > 1 else [1]


class _Packer:
    """Gathers runs with their buckets and makes rows of them."""

    def __init__(self, buckets: int, width: int) -> None:
        self.buckets, self.width, self.parts, self.keys, self.size = buckets, width, [], [], 0

    def add(self, found: Runs) -> Iterator[pa.RecordBatch]:
        cut, key = found.cells(self.width)
        self.parts.append(cut)
        self.keys.append((key % np.uint64(self.buckets)).astype(np.int64))
        self.size += len(cut.data)
        if self.size >= PACK_BYTES:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        whole, key = Runs.joined(self.parts), np.concatenate(self.keys)
        self.parts, self.keys, self.size = [], [], 0
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        codec, out = pa.Codec("zstd", 1), []
        for at in np.split(order, edges):
            raw = whole.take(at).pack()
            out.append((int(key[at[0]]), len(raw), codec.compress(raw, asbytes=True)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "size", "runs"), x, strict=True)) for x in out], _PACK_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "size", "runs"), x, strict=True)) for x in out], _PACK_SCHEMA)


_PACK_SCHEMA = pa.schema([("bucket", pa.int64()), ("size", pa.int64()), ("runs", pa.binary())])


def _packed(depth: int, buckets: int, width: int):
    """Packs the runs (column _runs) of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, width)
        for batch in batches:
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("_runs"), strict=True):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                lo, hi, off = (found.values.field(i).to_numpy() for i in range(3))
                n = np.minimum(hi, len(raw) - depth) - lo + 1
                lo, n, off = lo[n > 0], n[n > 0], off[n > 0]
                for i in range(0, len(lo), PIECE // (2 * depth)):  # about a piece's bytes at once
                    part = slice(i, i + PIECE // (2 * depth))
                    data = raw[_ranges(lo[part], n[part] + depth - 1)]
                    yield from packer.add(Runs(np.full(len(lo[part]), doc), lo[part], n[part], off[part], data, depth))
        yield from packer.rows()

    return task


def _dealt_again(depth: int, buckets: int, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, width)
        for batch in batches:
            for size, raw in zip(batch.column("size").to_pylist(), batch.column("runs"), strict=True):
                yield from packer.add(Runs.unpack(pa.Codec("zstd").decompress(raw.as_py(), size, asbytes=True), depth))
        yield from packer.rows()

    return task


# --- sorting


def equal_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(places in at, group): the strings at some places of equal first group and equal bytes through their length.

    Passes over digits of eight bytes, most significant first; each drops the strings that are alone.  Strings of one first group
    have one length, which is given for each string or once for all.
    """
    left = np.argsort(group, kind="stable")
    group = group[left]
    length = np.broadcast_to(length, len(at))
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    digits = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))  # the digit at each place
    depth = 0
    while True:
        same = group[1:] == group[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        left, group = left[many], group[many]
        if not len(left) or depth >= int(length[left].max()):
            break
        # the last digit begins early, so that it ends where the string does; strings shorter than a digit are cut
        rest = length[left] - depth
        more = rest > 0
        digit = digits[at[left] + np.where(rest < DIGIT, np.maximum(length[left] - DIGIT, 0), depth)].astype(np.uint64)
        digit >>= (8 * np.maximum(DIGIT - length[left], 0)).astype(np.uint64)
        digit[~more] = 0
        order = np.argsort(digit, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        left, group, digit = left[order], group[order], digit[order]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]))
        depth += DIGIT
    return left, group


def sorted_runs(found: Runs) -> tuple[Runs, tuple[np.ndarray, ...]]:
    """(the earliest of equal runs, spans that the others cover)."""
    length = found.n + found.depth - 1
    at, group = equal_groups(found.data, found.starts, length, length)
    old = np.zeros(len(found.n), bool)
    old[at] = _repeated(group, found.doc[at], found.lo[at])
    return found.take(np.flatnonzero(~old)), (found.doc[old], found.lo[old], found.lo[old] + length[old])


def sorted_windows(found: Runs) -> tuple[np.ndarray, ...]:
    """Spans of the windows that have an equal earlier one."""
    at = _ranges(found.starts, found.n)
    doc, place = np.repeat(found.doc, found.n), _ranges(found.lo, found.n)
    some, group = equal_groups(found.data, at, np.zeros(len(at), np.int64), found.depth)
    old = some[_repeated(group, doc[some], place[some])]
    return doc[old], place[old], place[old] + found.depth


def _sorted(depth: int, most: int):
    """Spans that are covered, from buckets in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in _merged(*found)], ["doc_id", "lo", "hi"])

        now, parts, size = None, [], 0
        for batch in batches:
            for bucket, n, raw in zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist(), batch.column("runs"), strict=True):
                if bucket != now and parts:
                    first, covered = sorted_runs(Runs.joined(parts))
                    yield spans(covered)
                    yield spans(sorted_windows(first))
                    parts, size = [], 0
                now = bucket
                parts.append(Runs.unpack(pa.Codec("zstd").decompress(raw.as_py(), n, asbytes=True), depth))
                size += n
                if size > most:  # a bucket of single windows: only the distinct ones are held
                    first, covered = sorted_runs(Runs.joined(parts))
                    yield spans(covered)
                    parts, size = [first], len(first.data) // 2
        if parts:
            first, covered = sorted_runs(Runs.joined(parts))
            yield spans(covered)
            yield spans(sorted_windows(first))

    return task


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, lo, hi: half-open byte spans that are covered by repeated windows; spans may overlap.

    docs: doc_id bigint and text.
    """
    spark, gram = docs.sparkSession, min(gram, depth)
    if depth - gram >= MARK:
        raise ValueError("the depth may exceed the gram by 4093 at most")
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth))
    low = F.lit(COVERED).cast("bigint")
    kind = F.col("place").bitwiseAND(low)
    met = (
        docs.mapInArrow(_runs_of(depth, gram), _RUN)
        .withColumn("_many", F.count("*").over(W.partitionBy("deal")))
        .filter((kind != MARK) & ((F.col("_many") > 1) | (kind == COVERED) | (F.col("more") == 1)))
    )
    lo = F.shiftright("place", 2 * PLACE_BITS)
    hi = F.when(kind == COVERED, F.col("more")).otherwise(lo + F.shiftright("place", PLACE_BITS).bitwiseAND(low))
    found = kept(met.select("doc_id", lo.alias("lo"), hi.alias("hi"), kind.alias("off")), "runs")
    del met
    drop_shuffles(spark)
    covered = found.filter(F.col("off") == COVERED).select("doc_id", "lo", "hi")
    edges = found.filter(F.col("off") != COVERED)
    total = edges.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + depth), F.lit(0))).first()[0]
    by_doc = edges.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("lo", "hi", "off")).alias("_runs"))
    levels = widths(depth, gram)
    texts = docs.join(by_doc, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "_runs")
    packed = kept(texts.mapInArrow(_packed(depth, -(-total // bucket_bytes) or 1, levels[0]), _PACK), "packed")
    del texts
    drop_shuffles(spark)
    spans = covered
    for i, _ in enumerate(levels):
        sizes = packed.groupBy("bucket").agg(F.sum("size").alias("_size")).filter(F.col("_size") > most_bytes)
        large = kept(sizes, "large") if i + 1 < len(levels) else None
        over = large.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0] if large else 0
        fits = packed.join(large.select("bucket"), "bucket", "left_anti") if over else packed
        done = fits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted(depth, most_bytes), "doc_id bigint, lo bigint, hi bigint")
        spans = spans.unionByName(kept(done, "spans"))
        again = None
        if over:
            rest = packed.join(large.select("bucket"), "bucket", "left_semi")
            again = kept(rest.mapInArrow(_dealt_again(depth, -(-over // bucket_bytes), levels[i + 1]), _PACK), "packed")
        discard(packed)
        if not over:
            break
        packed = again
    drop_shuffles(spark)
    return spans


def _cut(keep_text: bool, keep: tuple[str, ...]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("_spans"), strict=True):
                raw = (text.as_py() or "").encode()
                pieces, at, removed, n = [], 0, 0, 0
                if spans.is_valid:
                    lo, hi = (np.array(x, np.int64) for x in zip(*((s["lo"], s["hi"]) for s in spans.as_py()), strict=True))
                    _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, np.minimum(hi, len(raw)))
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        pieces.append(raw[at:a])
                        at, removed, n = b, removed + b - a, n + 1
                pieces.append(raw[at:])
                rest = b"".join(pieces)
                rows.append((len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text and text.is_valid else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            own = ["doc_id", *keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*own, *names])

    return task


def removed(docs: DataFrame, depth: int = DEPTH, keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns in keep and, if asked for, kept_text.

    kept_text leaves out the bytes of a character that a span cuts in two; it is null where the text is.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    spans = repeated_spans(texts, depth).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select("doc_id", *keep).schema.fields)
    schema = f"{own}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    cut = texts.join(spans, F.col("doc_id") == F.col("_doc"), "left").drop("_doc").mapInArrow(_cut(keep_text, keep), schema)
    return cut if keep_text else cut.drop("kept_text")
