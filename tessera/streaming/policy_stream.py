"""The policy as a Structured Streaming query.

State is kept for each sandbox: process id to taint flag.  Within a trigger the
events of a sandbox are taken in order of arrival (seq), so one trigger over all
events and many small ones give the same flags.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import INTERPRETERS
from tessera.operators.policy import BATCH, EXEC, REGISTER, UNREGISTER, classify, published, violates
from tessera.plans.lineage import shared_folder
from tessera.sources.events import EVENT_SQL

TRACED_SQL = EVENT_SQL + ", is_preinstall long"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Taint(StatefulProcessor):
    """Flags of processes, by process id.  ``ttl_ms``: forget processes that are silent for so long (None: never)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getMapState("flags", "pid long", "flag int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seen: dict[int, int | None] = {}

        def flag(pid: int | None) -> int | None:
            if pid is None:
                return None
            if pid not in seen:
                seen[pid] = self.flags.getValue((pid,))[0] if self.flags.containsKey((pid,)) else None
            return seen[pid]

        changed, out = set(), []
        for kind, pid, ppid, comm, ip in zip(events["event_type"], events["pid"], events["ppid"], events["comm"], events["ip"], strict=True):
            pid, ppid = (None if pd.isna(x) else int(x) for x in (pid, ppid))
            if pid is not None and kind in (REGISTER, UNREGISTER, EXEC):
                changed.add(pid)
                if kind == EXEC:
                    seen[pid] = int(bool(flag(ppid)) or (comm in INTERPRETERS and (ppid or 0) > 1))
                else:
                    seen[pid] = int(ip != 0) if kind == REGISTER else None
            own = flag(pid)
            if own is None and pid is None and kind == EXEC:
                own = int(comm in INTERPRETERS and (ppid or 0) > 1)
            out.append(own if own is not None else (flag(ppid) or 0))
        for pid in changed:
            if seen[pid] is None:
                self.flags.removeKey((pid,))
            else:
                self.flags.updateValue((pid,), (seen[pid],))
        yield events.assign(is_preinstall=out)[~events["event_type"].isin([REGISTER, UNREGISTER])]

    def close(self) -> None:
        pass


def traced(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of events with is_preinstall, is_sensitive and is_unauthorized."""
    states = events.groupBy("sandbox").transformWithStateInPandas(Taint(ttl_ms), TRACED_SQL, "Append", "None")
    return classify(states)


def violations(events: DataFrame) -> DataFrame:
    return traced(events).where(violates())


def start(frame: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Start a query; ``sink`` gets each trigger's rows."""
    frame.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    writer = frame.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.foreachBatch(sink).start() if sink else writer.format("noop").start()


class Batches(StatefulProcessor):
    """Batches of ``BATCH`` events of a sandbox in order of arrival; what does not fill one waits for the next trigger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "batch_id long, n_rows long, violations long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, n, bad = self.open.get() if self.open.exists() else (0, 0, 0)
        out = []
        for flag in pd.concat(list(rows)).sort_values("seq", kind="stable")["violation"]:
            n, bad = n + 1, bad + int(bool(flag))
            if n == BATCH:
                out.append((key[0], batch, n, bad))
                batch, n, bad = batch + 1, 0, 0
        self.open.update((batch, n, bad))
        yield pd.DataFrame(out, columns=["sandbox", "batch_id", "n_rows", "violations"])

    def close(self) -> None:
        pass


def batched(traces: DataFrame) -> DataFrame:
    """(sandbox, batch_id, n_rows, violations): the full batches of a stream of traces, as soon as they are full."""
    marked = traces.select("sandbox", "seq", F.coalesce(violates(), F.lit(False)).alias("violation"))
    return marked.groupBy("sandbox").transformWithStateInPandas(Batches(), "sandbox long, batch_id long, n_rows long, violations long", "Append", "None")


class KillSwitch:
    """A sink that keeps events up to each sandbox's first violation and says when a source is to be stopped.

    Below ``path``, ``events`` has the events, ``stops`` the stopped sandboxes and
    ``published`` the alert and the change of state of each.  Stops are read from there,
    so they outlive the query, and a trigger that runs again writes the same.
    """

    def __init__(self, path: str, on_violation: Callable[[int, int], None] = lambda sandbox, seq: None):
        self.path, self.on_violation = path, on_violation

    def _stops(self, spark: SparkSession, trigger: int) -> DataFrame:
        """(sandbox, _stop) of the triggers before."""
        folder = f"{self.path}/stops"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], "sandbox long, _stop long")
        return spark.read.schema("sandbox long, _stop long, trigger long").parquet(folder).where(F.col("trigger") < trigger).drop("trigger")

    def __call__(self, rows: DataFrame, trigger: int) -> None:
        rows, spark = rows.persist(), rows.sparkSession
        before = self._stops(spark, trigger).select(F.col("sandbox").alias("_box"), "_stop")
        same = F.col("sandbox").eqNullSafe(F.col("_box"))
        running = rows.join(before, same, "left_anti")
        new = running.where(violates()).groupBy("sandbox").agg(F.min("seq").alias("_stop"))
        new.write.mode("overwrite").parquet(f"{self.path}/stops/trigger={trigger}")
        published(running).write.mode("overwrite").parquet(f"{self.path}/published/trigger={trigger}")
        stops = spark.read.schema("sandbox long, _stop long").parquet(f"{self.path}/stops/trigger={trigger}").select(F.col("sandbox").alias("_box"), "_stop")
        kept = running.join(stops, same, "left").where("_stop is null or seq <= _stop").drop("_stop", "_box")
        kept.write.mode("overwrite").parquet(f"{self.path}/events/trigger={trigger}")
        for r in stops.toLocalIterator():  # the sandboxes that this trigger stops
            self.on_violation(r["_box"], r["_stop"])
        rows.unpersist()


def run_once(spark: SparkSession, events: DataFrame, rows_a_trigger: int = 1_000_000) -> DataFrame:
    """The stream over a table: the table is written as a source folder in stretches of arrival, and what the sink wrote is returned.

    A trigger takes one stretch, so a task has at most ``rows_a_trigger`` seqs of a sandbox at a time.
    """
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    bounds = events.agg(F.min("seq"), F.max("seq")).first()
    low, high = (0, -1) if bounds[0] is None else bounds
    part = F.coalesce(F.floor((F.col("seq") - low) / rows_a_trigger), F.lit(0))
    for k in range(max(1, -(-(high - low + 1) // rows_a_trigger))):  # one after the other: a source takes files by their time
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        query = start(traced(source), f"{root}/state", lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/out/trigger={n}"))
        query.awaitTermination()
    return spark.read.schema(f"{TRACED_SQL}, is_sensitive long, is_unauthorized long").parquet(f"{root}/out")
