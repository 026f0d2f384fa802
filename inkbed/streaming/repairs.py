"""M-07, W-13 to W-17: the repair cycle as a state machine, over a stream or at once.

Cycles are rows of session, cycle (its number), outcome, signature (of its error) and ts.  They may arrive in any order, so a session keeps
them by number until no later one can come: it closes once the watermark is ``gap`` beyond its last cycle, which a timer tells.  Then its
cycles are walked in order of their numbers:

* converged, oscillating and unresolvable cycles end the session with that outcome;
* a signature that an earlier cycle had ends it as oscillating;
* the last of ``most`` cycles ends it as a timeout; a session whose cycles end before that is unresolvable.

Cycles after the end are ignored and counted.  Of two cycles of one number the one with the greatest (outcome, signature) counts, nulls
least, so arrival decides nothing.  A row that comes after its session closed is late: a row of outcome late, never a second verdict.  What
comes behind the watermark itself is dropped by Spark, which counts it in the query's progress; so is what happened in 1970 or before, where watermarks begin.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Outcomes that end a session.
ENDS = ("converged", "oscillating", "unresolvable")
OUT = "session string, outcome string, cycles bigint, ignored bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(cycles: list[tuple], most: int) -> tuple[str, int, int]:
    """(outcome, cycles used, cycles ignored) of (cycle, outcome, signature) in order."""
    seen: set[str] = set()
    for used, (_, outcome, signature) in enumerate(cycles, 1):
        if outcome in ENDS:
            return outcome, used, len(cycles) - used
        if signature is not None and signature in seen:
            return "oscillating", used, len(cycles) - used
        if used == most:
            return "timeout", used, len(cycles) - used
        seen.add(signature)
    return "unresolvable", len(cycles), 0


class RepairSessions(StatefulProcessor):
    """State of a session: its cycles by number, its timer, and a mark once it is closed, which is forgotten after ``memory_ms``."""

    def __init__(self, gap_ms: int, most: int, memory_ms: int) -> None:
        self.gap_ms, self.most, self.memory_ms = gap_ms, most, memory_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.cycles = handle.getMapState("cycles", "cycle bigint", "outcome string, signature string")
        self.timer = handle.getValueState("timer", "at bigint")
        # an expired timer of the closed session forgets the mark: event time decides, not the clock
        self.closed = handle.getValueState("closed", "at bigint")

    def _set(self, at: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        order = lambda x: tuple((v is not None, v or "") for v in x)
        best: dict[int, tuple] = {}
        last = n = 0
        for f in rows:
            n += len(f)
            last = max(last, int(f["at"].max()))
            for c, *x in zip(f["cycle"], f["outcome"], f["signature"], strict=True):
                x = tuple(None if pd.isna(v) else v for v in x)
                if int(c) not in best or order(x) > order(best[int(c)]):
                    best[int(c)] = x
        if self.closed.exists():
            yield pd.DataFrame({"session": [key[0]], "outcome": ["late"], "cycles": [0], "ignored": [n]})
            return
        for c, x in best.items():
            if not self.cycles.containsKey((c,)) or order(x) > order(self.cycles.getValue((c,))):
                self.cycles.updateValue((c,), x)
        at = last + self.gap_ms
        if not self.timer.exists() or at > self.timer.get()[0]:
            self._set(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.timer.clear()
        if self.closed.exists():
            self.closed.clear()
            return
        found = sorted((k[0], v[0], v[1]) for k, v in self.cycles.iterator()) if self.cycles.exists() else []
        self.cycles.clear()
        self.closed.update((expiredTimerInfo.getExpiryTimeInMs(),))
        self._set(expiredTimerInfo.getExpiryTimeInMs() + self.memory_ms)
        yield pd.DataFrame([(key[0], *walk(found, self.most))], columns=["session", "outcome", "cycles", "ignored"])

    def close(self) -> None:
        pass


def repair_stream(cycles: DataFrame, most: int = 5, gap: int = 600, late: int = 600, memory: int = 86_400) -> DataFrame:
    """session (text), outcome, cycles, ignored of a stream of cycles; gap, late and memory in seconds.

    Closed sessions are remembered for ``memory`` seconds of event time.  The session needs ``spark.sql.streaming.stateStore.providerClass``
    to be ``PROVIDER``.  A state holds one session's cycles; rows without session or number are not cycles and are left out, but move the watermark.
    """
    rows = cycles.withWatermark("ts", f"{late} seconds").select(
        F.when(F.col("cycle").isNotNull(), F.col("session").cast("string")).alias("session"), F.coalesce(F.col("cycle").cast("bigint"), F.lit(0)).alias("cycle"), "outcome", "signature", "ts", F.unix_millis("ts").alias("at")
    )
    machine = RepairSessions(gap * 1000, most, memory * 1000)
    out = rows.groupBy("session").transformWithStateInPandas(machine, OUT, "Append", "EventTime")
    return out.filter("session IS NOT NULL")


def repair_batch(cycles: DataFrame, most: int = 5) -> DataFrame:
    """The same verdicts of a whole table, as windows: the first cycle that ends its session, else timeout or unresolvable."""
    best = cycles.filter("session IS NOT NULL AND cycle IS NOT NULL").groupBy(F.col("session").cast("string").alias("session"), F.col("cycle").cast("bigint").alias("cycle")).agg(
        F.max(F.struct("outcome", "signature")).alias("_b")
    ).select("session", "cycle", "_b.*")
    own = W.partitionBy("session")
    again = (F.row_number().over(W.partitionBy("session", "signature").orderBy("cycle")) > 1) & F.col("signature").isNotNull()
    place = F.row_number().over(own.orderBy("cycle"))
    why = F.when(F.col("outcome").isin(*ENDS), F.col("outcome")).when(F.col("_again"), "oscillating").when(F.col("_place") == most, "timeout")
    rows = best.withColumns({"_again": again, "_place": place}).withColumn("_why", why)
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("_place", "_why")))
    done = rows.groupBy("session").agg(first.alias("_f"), F.count("*").alias("_n"))
    used = F.coalesce(F.col("_f._place").cast("bigint"), F.col("_n"))
    return done.select("session", F.coalesce("_f._why", F.lit("unresolvable")).alias("outcome"), used.alias("cycles"), (F.col("_n") - used).alias("ignored"))


def replay(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files_per_trigger: int = 4, **limits: int) -> list[dict]:
    """Runs the stream over a folder of Parquet files to its end, into Parquet at ``sink``; the progress of its batches.

    What is still open at the end stays in the state for the next run: a source that is known to be whole ends in a row without session,
    later than all others by more than gap and late.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        query = repair_stream(stream, **limits).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
        query.awaitTermination()
        return [p for p in query.recentProgress]
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
