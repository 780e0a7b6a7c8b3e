"""Bit-planes and binary rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.text import c_string, dotted_quad, is_sensitive, scaled, swap_port
from tessera.operators.planes import as_rows, native_count, slice_planes, unslice
from tessera.plans.schema import Field, Schema
from tessera.sources.binary import from_buffer, numpy_type, read_binary


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"position": np.arange(len(values)), "v": np.array(values, np.uint64).view(np.int64)}), "position long, v long")


def test_laws(spark):
    for r, b in ((63, 63), (63, 0), (8, 24), (53, 7)):
        values = [0] * 64
        values[r] = 1 << b
        words = {x.bit: x.plane for x in as_rows(slice_planes(frame(spark, values), "position", "v")).collect()}
        assert words[b] % (1 << 64) == 1 << r and all(w == 0 for k, w in words.items() if k != b)


def test_round_trip_and_count(spark):
    values = np.random.default_rng(42).integers(0, 1 << 64, 64 * 5 + 3, dtype=np.uint64)
    planes = slice_planes(frame(spark, values), "position", "v")
    back = unslice(planes).orderBy("position").toPandas()
    assert (back["value"].to_numpy().view(np.uint64) == values).all()
    for t in (0, 5, 1 << 63, (1 << 64) - 1):
        assert native_count(planes, t).first().result == int((values > np.uint64(t)).sum())
    assert native_count(slice_planes(frame(spark, [25000 + 100 * i for i in range(64)]), "position", "v"), 28000).first().result == 33
    low = {x.bit: x.plane for x in as_rows(slice_planes(frame(spark, values), "position", "v", 3)).where("block_id = 0").collect()}
    assert all(low[b] == 0 for b in range(3, 64)) and low[0] != 0
    assert native_count(slice_planes(frame(spark, []), "position", "v"), 1).first().result == 0


def test_binary(spark, tmp_path):
    odd = Schema("odd", (Field("x", 0), Field("y", 9, "uint32"), Field("z", 13, "float64", 100)), 21)
    rows = np.zeros(1000, numpy_type(odd))
    rows["x"], rows["y"], rows["z"] = np.arange(1000), 7, 0.25
    (tmp_path / "a.bin").write_bytes(rows.tobytes())
    cut = read_binary(spark, str(tmp_path), odd, chunk_bytes=1000)  # many chunks of one file
    assert sorted(tuple(r)[1:] for r in cut.collect()) == [(i, i, 7, 25) for i in range(1000)] and cut.rdd.getNumPartitions() > 1
    got = read_binary(spark, str(tmp_path), odd)
    assert got.where("x > 10").count() == 989 and got.agg(F.sum("z")).first()[0] == 25_000 and got.agg(F.min("y")).first()[0] == 7
    assert from_buffer(spark, rows.tobytes(), odd).where("x = seq").count() == 1000


def test_functions(spark):
    row = spark.createDataFrame([(0x08080404, 443, "/home/.ssh/id", "ab\x00cd", 10)], "ip long, port int, p string, c string, n long")
    out = row.select(dotted_quad(F.col("ip")).alias("a"), dotted_quad(F.col("ip"), True).alias("b"), swap_port(F.col("port")).alias("c"), is_sensitive(F.col("p")).alias("d"), c_string(F.col("c"), 16).alias("e"), scaled(F.col("n"), 4).alias("f")).first()
    assert tuple(out) == ("8.8.4.4", "4.4.8.8", 0xBB01, True, "ab", 2.5)
