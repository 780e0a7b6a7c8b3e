"""Rows of fixed stride in binary files, NumPy buffers and scaled tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.schema import TYPES, Schema, SchemaError

_NUMPY = {"uint8": "u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "int8": "i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float64": "<f8"}


def numpy_type(schema: Schema) -> np.dtype:
    if not schema.stride:
        raise SchemaError(f"{schema.name} has no stride")
    return np.dtype({"names": [f.name for f in schema.fields], "formats": [_NUMPY[f.type] for f in schema.fields], "offsets": [f.offset for f in schema.fields], "itemsize": schema.stride})


def decode(schema: Schema, data: bytes) -> dict[str, np.ndarray]:
    """Columns of raw 64-bit values; floating fields are scaled and rounded.  Bytes after the last whole row are an error."""
    if len(data) % schema.stride:
        raise SchemaError(f"{len(data)} bytes are no whole number of rows of {schema.stride}")
    rows = np.frombuffer(data, numpy_type(schema))
    return {f.name: np.rint(rows[f.name] * f.scale).astype(np.int64) if f.type == "float64" else (rows[f.name].view(np.int64) if TYPES[f.type] == (64, False) and rows.strides == (8,) else rows[f.name].astype(np.uint64 if not TYPES[f.type][1] else np.int64).view(np.int64)) for f in schema.fields}


CHUNK_BYTES = 16 << 20
MOST_TASKS = 100_000


def read_chunks(spark: SparkSession, path: str, stride: int, decode: Callable[[bytes, str, int], pa.RecordBatch], schema: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of the files below ``path``, each cut at multiples of ``stride``; ``decode`` gets the bytes, the file and the first row's number.

    A chunk is a row of a table of places, so one large file is many tasks', and no
    value holds more than a chunk.  Chunks are read by the workers through the file
    system of the path; where that is not one that workers open, Spark reads whole files.
    """
    rows = max(1, chunk_bytes // stride)
    files = spark.read.format("binaryFile").load(path)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, n in zip(*[batch.column(c).to_pylist() for c in ("path", "at", "n")], strict=True):
                store, name = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                with store.open_input_file(name) as f:
                    f.seek(at * stride)
                    yield decode(f.read(n * stride), file, at)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                for at in range(0, data.size // stride, rows):
                    yield decode(data.slice(at * stride, min(rows * stride, data.size - at * stride)).to_pybytes(), file, at)

    sizes = files.select("path", "length")
    odd = sizes.where(F.col("length") % stride != 0).first()
    if odd:
        raise SchemaError(f"{odd['path']}: {odd['length']} bytes are no whole number of rows of {stride}")
    scheme = sizes.select(F.regexp_extract("path", "^([a-z0-9]+):", 1).alias("s")).first()
    if scheme is not None and scheme["s"] not in ("file", "hdfs", "s3", "gs"):
        return files.select("path", "content").mapInArrow(contents, schema)
    count = F.col("length") / stride
    places = sizes.where("length > 0").select("path", F.floor(count).alias("rows"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / rows))).alias("k"))
    places = places.select("path", (F.col("k") * rows).alias("at"), F.least(F.lit(rows), F.col("rows") - F.col("k") * rows).alias("n"))
    # a number of its own, as the rows are small and would be put together again
    n = sizes.agg(F.sum(F.ceil(count / rows))).first()[0] or 1
    return places.repartition(min(int(n), MOST_TASKS), "path", "at").mapInArrow(ranges, schema)


def read_binary(spark: SparkSession, path: str, schema: Schema, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of the files below ``path`` with their number in the file (seq) and its name (file)."""
    names = [f.name for f in schema.fields]

    def rows(data: bytes, file: str, first: int) -> pa.RecordBatch:
        n = len(data) // schema.stride
        columns = decode(schema, data)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(first, first + n)), *[pa.array(columns[c]) for c in names]], names=["file", "seq", *names])

    numpy_type(schema)  # a schema without a stride has no rows
    return read_chunks(spark, path, schema.stride, rows, "file string, seq long, " + ", ".join(f"`{n}` long" for n in names), chunk_bytes)


def from_buffer(spark: SparkSession, data: bytes, schema: Schema) -> DataFrame:
    """A DataFrame of rows in memory, with their numbers as ``seq``."""
    columns = decode(schema, bytes(data))
    return spark.createDataFrame(pa.table({"seq": np.arange(len(data) // schema.stride), **columns}))
