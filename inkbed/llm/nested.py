"""Nested schema inference by columnar shredding.

Each JSON object is shredded: every path that occurs is a column of entries, each with the type of its value, a repetition level
(at which array of its path the entry starts anew) and a definition level (how much of its path is there).  Entries belong to a
row group, a bounded number of rows of one task; when it is full, its columns are summed up in footers, one row for each path: values
by type, presence from the definition levels, array lengths from the runs of the repetition levels.  Footers are added up by path,
then maps are collapsed from the top down, one depth a round.

Scale: what is shuffled are footers, combined by each task before; rows of the input never move.  A round joins footers with the
wide paths of one depth (sort-merge, so nothing is broadcast, and skewed paths can be split); the driver gets one number, the
greatest depth.  A group of rows is bounded in rows and in entries.

Defined cases: what isn't one whole object (null, another value, a broken or an empty text, numbers such as NaN, nesting of more
than some thousand levels) is ``bad`` at its own path; of a name that an object holds twice, the last value counts; names that aren't
valid Unicode have ``?`` for what is wrong; names may hold any character, and paths that look the same are one; a very long text is
shredded in its own group; repeated rows count each time; extra columns are not carried; an empty table has no paths.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept, short_batches

#: Types in alphabetical order, and the most names of a path that aren't a map.
TYPES = ("array", "bad", "boolean", "double", "integer", "null", "object", "string")
MOST_NAMES = 12
MAP = ".*"
#: A row group is closed beyond so many entries, or rows.
GROUP_ENTRIES = 500_000
GROUP_ROWS = 50_000
FOOTER = "steps array<string>, values array<bigint>, present bigint, min_len bigint, max_len bigint"


class Shredded:
    """The columns of a row group: for each path its entries (kind, repetition level, definition level).

    A kind is a place in TYPES; -1 stands for an array without elements, whose definition level is that of the array.
    """

    __slots__ = ("items", "kinds", "level", "defined", "members", "rep", "dfn", "steps")

    def __init__(self, steps: tuple[str, ...] = (), level: int = 0):
        self.steps, self.level, self.defined = steps, level, len(steps)
        self.kinds, self.rep, self.dfn = [], [], []
        self.members: dict[str, Shredded] = {}
        self.items: Shredded | None = None

    def member(self, name: str) -> Shredded:
        out = self.members[name] = Shredded((*self.steps, "." + name), self.level)
        return out

    def elements(self) -> Shredded:
        self.items = Shredded((*self.steps, "[]"), self.level + 1)
        return self.items

    def put(self, kind: int, rep: int) -> None:
        self.kinds.append(kind)
        self.rep.append(rep)
        self.dfn.append(self.defined)

    def shred(self, value: object) -> int:
        """Adds a value that stands at this path, and all below it; the number of entries."""
        self.put(_KIND[type(value)], 0)
        n, stack = 1, [(self, value, 0)]
        while stack:
            at, v, rep = stack.pop()
            below = []
            if type(v) is dict:
                members = at.members
                for name, x in v.items():
                    c = members.get(name) or at.member(name)
                    t = type(x)
                    c.kinds.append(_KIND[t])
                    c.rep.append(rep)
                    c.dfn.append(c.defined)
                    if t is dict or t is list:
                        below.append((c, x, rep))
                n += len(v)
            else:
                c = at.items or at.elements()
                if not v:
                    c.kinds.append(-1)
                    c.rep.append(rep)
                    c.dfn.append(at.defined)
                for x in v:
                    t = type(x)
                    c.kinds.append(_KIND[t])
                    c.rep.append(rep)
                    c.dfn.append(c.defined)
                    if t is dict or t is list:
                        below.append((c, x, rep))
                    rep = c.level
                n += len(v) or 1
            below.reverse()  # elements in their order, which the repetition levels go by
            stack.extend(below)
        return n

    def footers(self) -> Iterator[tuple[list[str], list[int], int, int | None, int | None]]:
        """Of each path: values by type, presence, least and greatest length of its arrays."""
        import numpy as np

        stack = [self]
        while stack:
            c = stack.pop()
            stack.extend(c.members.values())
            least = most = None
            if c.items:
                stack.append(c.items)
                starts = np.flatnonzero(np.array(c.items.rep) < c.items.level)
                lengths = np.diff(np.append(starts, len(c.items.rep)))
                lengths[np.array(c.items.dfn)[starts] < c.items.defined] = 0
                least, most = int(lengths.min()), int(lengths.max())
            there = np.array(c.dfn) == c.defined
            if there.any():
                values = np.bincount(np.array(c.kinds)[there], minlength=len(TYPES)).tolist()
                yield list(c.steps), values, int(there.sum()), least, most


_KIND = {list: 0, bool: 2, float: 3, int: 4, type(None): 5, dict: 6, str: 7}


def footers(rows: DataFrame) -> DataFrame:
    """Footers of rows (two names, whether to put the value into an array, and the text), not yet added up."""
    import pyarrow as pa

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        def refuse(_: str) -> None:
            raise ValueError

        # an integer's value doesn't matter, and may have any number of digits
        decoder = json.JSONDecoder(parse_int=len, parse_constant=refuse)

        def object_of(text: str | None) -> dict | None:
            try:
                v = decoder.decode(text)
            except (ValueError, TypeError, RecursionError):
                return None
            return v if type(v) is dict else None

        group = Group()
        for b in batches:
            for top, below, wrap, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                v = object_of(text)
                group.add(top, below, [v] if wrap and v is not None else v)
                if group.full():
                    yield group.close()
                    group = Group()
        if group.rows:
            yield group.close()

    class Group:
        def __init__(self) -> None:
            self.root, self.bad, self.rows, self.entries = Shredded(), {}, 0, 0

        def add(self, top: str, below: str, v: dict | list | None) -> None:
            self.rows += 1
            if v is None:
                self.bad[top] = self.bad.get(top, 0) + 1
            else:
                self.entries += self.root.shred({top: {below: v}})

        def full(self) -> bool:
            return self.rows >= GROUP_ROWS or self.entries >= GROUP_ENTRIES

        def close(self) -> pa.RecordBatch:
            found = list(self.root.footers())
            found += [(["!" + top], [n if t == "bad" else 0 for t in TYPES], n, None, None) for top, n in self.bad.items()]
            columns = list(zip(*found, strict=True))
            columns[0] = [[s.encode("utf-8", "replace").decode() for s in steps] for steps in columns[0]]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FOOTER.split(", ")])

    return rows.mapInArrow(shred, FOOTER)


def added(found: DataFrame) -> DataFrame:
    """One footer for each path: counts are added, lengths compared.  Columns t0, t1, ... are the values by type."""
    types = [F.sum(F.col(f"t{i}")).alias(f"t{i}") for i in range(len(TYPES))]
    return found.groupBy("steps").agg(*types, F.sum("present").alias("present"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))


def _collapsed(found: DataFrame, most: int) -> DataFrame:
    """Footers by their final paths, each with n_names and is_map."""
    deepest = found.agg(F.max(F.size("steps"))).first()[0] or 0
    named = None
    for d in range(1, deepest + 1):
        parent, step = F.slice("steps", 1, d - 1), F.try_element_at("steps", F.lit(d))
        names = found.filter(F.size("steps") == d).filter(step.startswith(".")).groupBy(parent.alias("steps")).agg(F.count("*").alias("n_names"))
        names = names.withColumn("is_map", (F.col("n_names") > most) & (F.size("steps") > 0))
        names = kept(names, "names")
        if not names.filter("is_map").isEmpty():
            wide = names.filter("is_map").select(F.col("steps").alias("_wide"))
            under = found.withColumn("_above", F.when((F.size("steps") >= d) & step.startswith("."), parent))
            met = under.join(wide.hint("merge"), F.col("_above") == F.col("_wide"), "left")
            rest = F.slice("steps", d + 1, F.greatest(F.size("steps") - d, F.lit(0)))
            found = kept(added(met.withColumn("steps", F.when(F.col("_wide").isNotNull(), F.concat(parent, F.array(F.lit(MAP)), rest)).otherwise(F.col("steps")))), "footers")
        named = names if named is None else named.unionByName(names)
    if named is None:
        return found.withColumns({"n_names": F.lit(0).cast("bigint"), "is_map": F.lit(False)})
    return found.join(named.hint("merge"), "steps", "left").withColumns({"n_names": F.coalesce("n_names", F.lit(0)), "is_map": F.coalesce("is_map", F.lit(False))})


def _path(steps: Column) -> Column:
    """``$``, then the steps; what was bad stands alone."""
    return F.when(F.element_at(F.concat(steps, F.array(F.lit(""))), 1).startswith("!"), F.element_at(F.concat(steps, F.array(F.lit(""))), 1)).otherwise(F.concat(F.lit("$"), F.array_join(steps, "")))


def schema_of(rows: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """One row for each path of rows (top, below, wrap, text): path, types, n_names, is_map, optional, min_len, max_len."""
    short_batches(rows.sparkSession)
    raw = footers(rows.select("top", "below", "wrap", "text"))
    typed = raw.select("steps", *(F.col("values")[i].alias(f"t{i}") for i in range(len(TYPES))), "present", "min_len", "max_len")
    found = kept(_collapsed(kept(added(typed), "footers"), most), "paths")
    n_objects = f"t{TYPES.index('object')}"
    parents = found.filter(f"{n_objects} > 0").select(F.col("steps").alias("_above"), F.col(n_objects).alias("_objects"))
    last = F.element_at(F.concat(F.array(F.lit("")), F.col("steps")), -1)
    own = found.withColumn("_above", F.when(last.startswith("."), F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0)))))
    met = own.join(parents.hint("merge"), "_above", "left")
    lacking = F.coalesce((last != MAP) & (F.col("present") < F.col("_objects")), F.lit(False))
    told = met.withColumns({"path": _path(F.col("steps")), "optional": lacking})
    sums = [F.sum(f"t{i}").alias(f"t{i}") for i in range(len(TYPES))]
    one = told.groupBy("path").agg(*sums, F.sum("n_names").alias("n_names"), F.max("is_map").alias("is_map"), F.max("optional").alias("optional"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))
    types = F.concat_ws("|", *(F.when(F.col(f"t{i}") > 0, F.concat(F.lit(f"{t}:"), F.col(f"t{i}").cast("string"))) for i, t in enumerate(TYPES)))
    return one.select("path", types.alias("types"), "n_names", "is_map", "optional", "min_len", "max_len")


def clicks_schema(clicks: DataFrame) -> DataFrame:
    """The schema of clicks' props, each below two names that go by its client and its id (of a negative client: by the positive rest)."""
    g = F.coalesce(F.pmod("client_id", F.lit(30)), F.lit(0))
    x = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit(""))) % (g % 37 + 1)
    wrap = F.coalesce(F.col("click_id") % 5 == 0, F.lit(False))
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    return schema_of(clicks.select(name("g", g).alias("top"), name("x", x).alias("below"), wrap.alias("wrap"), F.col("props").alias("text")))
