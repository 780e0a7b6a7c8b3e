"""The policy, in batch and as a stream, against a plain fold."""

import random

import numpy as np
import pytest

from tessera.functions.text import INTERPRETERS, SENSITIVE
from tessera.operators import policy
from tessera.sources.events import EVENT_SQL, mock
from tessera.operators.policy import REGISTER, UNREGISTER
from tessera.streaming.policy_stream import KillSwitch, batched, start, traced


def fold(events):
    flags, out = {}, {}
    for box, seq, kind, pid, ppid, comm, *_ in sorted(events, key=lambda e: (e[0], e[1])):
        if kind == 1:
            flags[box, pid] = bool(flags.get((box, ppid))) or (comm in INTERPRETERS and ppid > 1)
        out[box, seq] = int(flags[box, pid] if (box, pid) in flags else flags.get((box, ppid), False))
    return out


def events(n=300, seed=1):
    r = random.Random(seed)
    return [(r.randrange(2), i, r.choice([1, 2, 3]), r.randrange(2, 14), r.randrange(0, 14), r.choice(["sh", "npm", "ls", "Node", "node", None]), r.choice([*SENSITIVE, "/x", ".ssh", "/ETC/PASSWD", None]), 1, 80) for i in range(n)]


def test_batch_is_fold(spark):
    for seed in (1, 2):
        e = events(seed=seed)
        got = policy.taint(spark.createDataFrame(e, EVENT_SQL)).collect()
        assert {(r.sandbox, r.seq): r.is_preinstall for r in got} == fold(e) and len(got) == len(e)


def test_stream_is_fold(spark, tmp_path):
    e = events(seed=5)
    for i in range(0, 300, 100):
        spark.createDataFrame(e[i : i + 100], EVENT_SQL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENT_SQL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start(traced(source), str(tmp_path / "state"), lambda rows, k: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/trigger={k}")))
    q.awaitTermination()
    got = {(r.sandbox, r.seq): r.is_preinstall for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == fold(e)


def test_seeds_and_rules(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), EVENT_SQL)
    e = f((0, 1, 1, 101, 100, "sh", None, 0, 0), (0, 2, 1, 102, 101, "node", None, 0, 0), (0, 3, 2, 102, 101, "node", "/h/.ssh/id_rsa", 0, 0), (0, 4, 1, 102, 1, "ls", None, 0, 0), (0, 5, 2, 102, 101, "ls", "/a/.env", 0, 0), (0, 6, 3, 900, 101, "x", None, 134744072, 443))
    seeds = spark.createDataFrame([(0, 100, 0)], "sandbox long, pid long, flag int")
    traces = policy.classify(policy.taint(e, seeds))
    assert [r.is_preinstall for r in traces.orderBy("seq").collect()] == [1, 1, 1, 0, 0, 1]
    assert sorted(r.seq for r in traces.where(policy.violates()).collect()) == [3, 6]
    assert policy.kill_switch(traces).count() == 3
    assert policy.counters(traces).first()[1:] == (3, 2, 1, 2)


def test_batches_tree_and_literals(spark):
    traces = policy.classify(policy.taint(mock(spark, 40)))
    got = policy.batches(traces).orderBy("batch_id").collect()
    assert [(r.n_rows, r.violations, r.complete) for r in got] == [(64, 0, True), (16, 0, False)]
    rows = spark.createDataFrame([(p,) for p in (*SENSITIVE, ".ssh", "/ETC/PASSWD", None)], "arg string").selectExpr("arg", "2 as event_type")
    assert policy.classify(rows).where("is_sensitive = 1").count() == 12
    tree = policy.process_tree(spark.createDataFrame([(0, 1, 1, 10, 1, "a", None, 0, 0), (0, 2, 1, 11, 10, "b", None, 0, 0), (0, 3, 1, 12, 11, "c", None, 0, 0), (0, 4, 1, 13, 10, "d", None, 0, 0)], EVENT_SQL))
    assert [(r.pid, r.depth) for r in tree.orderBy("path").collect()] == [(10, 0), (11, 1), (12, 2), (13, 1)]
    assert policy.last_events(traces).count() == 12


def test_deep_tree(spark):
    """A chain of 41 below a process of its own start is one tree, beside a process whose parent starts later."""
    chain = [(0, i, 1, 100 + i, 99 + i if i else 1, "sh", None, 0, 0) for i in range(41)]
    rows = spark.createDataFrame([*chain, (0, 41, 1, 300, 301, "sh", None, 0, 0), (0, 42, 1, 301, 140, "sh", None, 0, 0), (1, 0, 1, 140, 140, "sh", None, 0, 0)], EVENT_SQL)
    got = {(r.sandbox, r.pid): (r.depth, r.path) for r in policy.process_tree(rows).collect()}
    label = lambda *seqs: "/".join(f"{x:020}" for x in seqs)
    want = {(0, 100 + i): (i, label(*range(i + 1))) for i in range(41)}
    assert got == want | {(0, 300): (0, label(41)), (0, 301): (41, label(*range(41), 42)), (1, 140): (0, label(0))}


def test_traps_and_states(spark):
    rows = [(0, 1, 1, 10, 1, "sh", None, 0, 0), (0, 2, 4, 10, 1, "sh", "0x1", 0, 0), (0, 3, 5, 0, 0, None, "Running", 0, 0), (0, 4, 4, 10, 1, "sh", "0x2", 0, 0), (0, 5, 5, 0, 0, None, "Kill Switch", 0, 0), (1, 6, 2, 10, 1, "sh", "/x", 0, 0)]
    events = spark.createDataFrame(rows, EVENT_SQL)
    assert sorted(tuple(r) for r in policy.status(events).collect()) == [(0, 2, "Kill Switch"), (1, 0, None)]
    assert [r.seq for r in policy.last_events(events, 4).collect()] == [6, 4, 2, 1]


@pytest.mark.parametrize("flag", [0, 1])
def test_stream_control_and_kill_switch(spark, tmp_path, flag):
    rows = [(0, 1, REGISTER, 50, 0, None, None, flag, 0), (0, 2, 3, 50, 1, "x", None, 1, 1), (0, 3, UNREGISTER, 50, 0, None, None, 0, 0), (0, 4, 3, 50, 1, "x", None, 1, 1)]
    spark.createDataFrame(rows, EVENT_SQL).write.parquet(str(tmp_path / "in"))
    seen = []
    sink = KillSwitch(str(tmp_path / "out"), lambda box, seq: seen.append((box, seq)))
    start(traced(spark.readStream.schema(EVENT_SQL).parquet(str(tmp_path / "in"))), str(tmp_path / "state"), sink).awaitTermination()
    assert seen == ([(0, 2)] if flag else [])
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out/events")).collect()) == ([2] if flag else [2, 4])
    told = [(r.sandbox, r.position, r.event_type, r.vm_running) for r in spark.read.parquet(str(tmp_path / "out/published")).orderBy("position").collect()]
    assert told == ([(0, 0, 3, 1), (0, 1, policy.STATE, 0)] if flag else [])
    # a new sink on the same folder goes on from its stops
    spark.createDataFrame([(0, 5, 3, 50, 1, "x", None, 1, 1), (1, 6, 3, 50, 1, "x", None, 1, 1)], EVENT_SQL).write.mode("append").parquet(str(tmp_path / "in"))
    again = KillSwitch(str(tmp_path / "out"), lambda box, seq: seen.append((box, seq)))
    start(traced(spark.readStream.schema(EVENT_SQL).parquet(str(tmp_path / "in"))), str(tmp_path / "state"), again).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out/events")).collect()) == ([2, 6] if flag else [2, 4, 5, 6])
    assert seen == ([(0, 2)] if flag else [])


def test_nothing_is_lost(spark, monkeypatch):
    """Null types, sandboxes, processes and parents, repeated rows and equal seqs: each event comes back once; stretches change nothing."""
    r = random.Random(7)
    maybe = lambda x: None if r.random() < 0.15 else x
    rows = [(maybe(0), i // 2 * 9000, maybe(r.choice([1, 2, 3])), maybe(r.randrange(2, 9)), maybe(r.randrange(0, 9)), maybe("sh"), maybe("/w/.env"), 1, 80) for i in range(200)]
    e = spark.createDataFrame(rows + rows[:20], EVENT_SQL)
    whole = [policy.taint(e), policy.kill_switch(policy.classify(policy.taint(e))), policy.batches(policy.classify(policy.taint(e)))]
    key = lambda x: tuple(map(repr, x))
    first = [sorted((tuple(x) for x in w.collect()), key=key) for w in whole]
    assert sorted(key(x[:9]) for x in first[0]) == sorted(key(x) for x in rows + rows[:20])
    assert sum(x[2] for x in first[2]) == 220 and all(x[2] == 64 for x in first[2] if x[4])
    monkeypatch.setattr(policy, "STRETCH_BITS", 62)
    assert first == [sorted((tuple(x) for x in w.collect()), key=key) for w in (policy.taint(e), policy.kill_switch(policy.classify(policy.taint(e))), policy.batches(policy.classify(policy.taint(e))))]


def test_control_events(spark, tmp_path):
    """Batch and stream agree where processes are set and forgotten among the events."""
    r = random.Random(11)
    rows = [(e[0], e[1], r.choice([e[2], e[2], REGISTER, UNREGISTER]), *e[3:7], r.randrange(2), 80) for e in events(seed=9)]
    got = {(x.sandbox, x.seq): x.is_preinstall for x in policy.taint(spark.createDataFrame(rows, EVENT_SQL)).collect()}
    spark.createDataFrame(rows, EVENT_SQL).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = start(traced(spark.readStream.schema(EVENT_SQL).parquet(str(tmp_path / "in"))), str(tmp_path / "state"), lambda d, k: d.write.mode("overwrite").parquet(str(tmp_path / f"out/trigger={k}")))
    q.awaitTermination()
    assert got == {(x.sandbox, x.seq): x.is_preinstall for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == sum(x[2] < REGISTER for x in rows)


def test_stream_batches(spark, tmp_path):
    """Full batches come as soon as they are full, whatever the triggers; the generator as a stream has the same rows."""
    from tessera.sources.events import mock_stream

    traces = policy.classify(policy.taint(mock(spark, 80))).orderBy("seq").collect()
    schema = policy.classify(policy.taint(mock(spark, 1))).schema
    for at in range(0, 160, 50):
        spark.createDataFrame(traces[at : at + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(batched(source), str(tmp_path / "state"), lambda d, k: d.write.mode("overwrite").parquet(str(tmp_path / f"out/trigger={k}"))).awaitTermination()
    assert sorted(tuple(x)[:4] for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0, 64, 0), (0, 1, 64, 0)]
    made = mock_stream(spark)
    assert made.isStreaming and made.columns == mock(spark, 1).columns


def test_packed_events(spark, tmp_path):
    from tessera.sources.events import PACKED, read_packed

    assert PACKED.itemsize == 328
    rows = np.zeros(5, PACKED)
    rows["event_type"], rows["pid"], rows["ip"], rows["port"] = [1, 2, 3, 4, 5], (1 << 64) - 1, (1 << 32) - 1, 65535
    rows["comm"], rows["arg"] = b"node\x00junk", [b"", b"a" * 256, b"/x\x00y", b"\xff", "é".encode()]
    (tmp_path / "a.bin").write_bytes(rows.tobytes())
    got = read_packed(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(x.seq, x.event_type, x.pid, x.comm, x.ip, x.port) for x in got] == [(i, i + 1, -1, "node", (1 << 32) - 1, 65535) for i in range(5)]
    assert [x.arg for x in got] == ["", "a" * 256, "/x", "\ufffd", "é"]
