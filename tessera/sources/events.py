"""Event records: the stream's layout, a view of the driver's events table, and a generator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.binary import read_chunks

EVENT_SQL = "sandbox long, seq long, event_type int, pid long, ppid long, comm string, arg string, ip long, port int"

#: events in terms of the events table; a string, so that other engines can run it
FROM_TABLE = """
SELECT user_id % 4 AS sandbox, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 2 ELSE 3 END AS event_type,
       (event_id * 7) % 101 + 2 AS pid, (user_id * 5 + event_id) % 103 + 1 AS ppid,
       CASE event_id % 11 WHEN 0 THEN 'sh' WHEN 1 THEN 'node' WHEN 2 THEN 'python' WHEN 3 THEN 'npm' WHEN 4 THEN 'bash ' ELSE 'ls' END AS comm,
       CASE event_id % 9 WHEN 0 THEN '/home/u/.ssh/id_rsa' WHEN 1 THEN '/home/u/.ssh' WHEN 2 THEN '/w/.env' WHEN 3 THEN '/ETC/PASSWD'
            WHEN 4 THEN '/etc/passwd' WHEN 5 THEN '/w/node_modules/lodash/index.js' WHEN 6 THEN '/u/.aws/config' WHEN 7 THEN '' ELSE NULL END AS arg,
       (event_id * 2654435761) % 4294967296 AS ip, (event_id * 31) % 65536 AS port
FROM events
"""


#: the same with control events, which set (101) and forget (102) processes
WITH_CONTROL = f"""
SELECT sandbox, seq, CASE WHEN seq % 13 = 0 THEN 101 WHEN seq % 17 = 0 THEN 102 ELSE event_type END AS event_type, pid, ppid, comm, arg, CASE WHEN seq % 13 = 0 THEN seq % 2 ELSE ip END AS ip, port FROM ({FROM_TABLE}) e
"""

#: the same with traps (4) and changes of state (5)
WITH_STATES = f"""
SELECT sandbox, seq, CASE WHEN seq % 19 = 0 THEN 4 WHEN seq % 23 = 0 THEN 5 ELSE event_type END AS event_type, pid, ppid, comm,
       CASE WHEN seq % 23 = 0 AND seq % 19 <> 0 THEN CASE WHEN seq % 2 = 0 THEN 'Running' ELSE 'Virtual Machine Terminated (Security Kill Switch)' END ELSE arg END AS arg, ip, CASE WHEN seq % 23 = 0 THEN (seq + 1) % 2 ELSE port END AS port
FROM ({FROM_TABLE}) e
"""


def from_table(spark: SparkSession, sf_dir: str, view: str = FROM_TABLE) -> DataFrame:
    return spark.sql(view.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def mock(spark: SparkSession, n: int) -> DataFrame:
    """``n`` pairs of events: a script is started, then opens a harmless file."""
    return mock_pairs(spark.range(n))


def stream(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    """Events from a growing folder of Parquet files."""
    reader = spark.readStream.schema(EVENT_SQL)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def mock_stream(spark: SparkSession, pairs_per_second: int = 4) -> DataFrame:
    """The generator as a stream: pairs of events at a steady rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", pairs_per_second).load()
    return mock_pairs(ticks.select(F.col("value").alias("id")))


def mock_pairs(ids: DataFrame) -> DataFrame:
    """The pair of events of each ``id``."""
    event = lambda k, kind, arg: F.struct((F.col("id") * 2 + k).alias("seq"), F.lit(kind).alias("event_type"), F.lit(arg).alias("arg"))
    both = ids.select("id", F.explode(F.array(event(0, 1, "benign_script.js"), event(1, 2, "/workspace/node_modules/benign/index.js"))).alias("e"))
    return both.select(F.lit(0).cast("long").alias("sandbox"), "e.seq", "e.event_type", (F.col("id") + 2001).alias("pid"), F.lit(1000).cast("long").alias("ppid"), F.lit("node").alias("comm"), "e.arg", F.lit(0).cast("long").alias("ip"), F.lit(0).alias("port"))


#: fixed values: the packed record of an event, little-endian
PACKED = np.dtype([("timestamp_ns", "<u8"), ("pid", "<u8"), ("ppid", "<u8"), ("event_type", "<u8"), ("comm", "S32"), ("arg", "S256"), ("ip", "<u4"), ("port", "<u2"), ("padding", "V2")])
PACKED_SQL = "file string, seq long, timestamp_ns long, event_type int, pid long, ppid long, comm string, arg string, ip long, port int"


def unpack(data: bytes, file: str, first: int) -> pa.RecordBatch:
    """Records of packed events; texts end at their first NUL, and bytes that are no UTF-8 are replaced."""
    rows = np.frombuffer(data, PACKED)
    text = lambda c: pa.array([x.split(b"\0", 1)[0].decode("utf-8", "replace") for x in rows[c].tolist()], pa.string())
    whole = lambda c, t: pa.array(rows[c].astype(np.uint64).view(np.int64)).cast(t, safe=False)
    columns = [pa.array([file] * len(rows)), pa.array(np.arange(first, first + len(rows)))]
    columns += [whole("timestamp_ns", pa.int64()), whole("event_type", pa.int32()), whole("pid", pa.int64()), whole("ppid", pa.int64()), text("comm"), text("arg"), whole("ip", pa.int64()), whole("port", pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "seq", "timestamp_ns", "event_type", "pid", "ppid", "comm", "arg", "ip", "port"])


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Events of the files of packed records below ``path``, with their number in the file (seq)."""
    return read_chunks(spark, path, PACKED.itemsize, unpack, PACKED_SQL)
