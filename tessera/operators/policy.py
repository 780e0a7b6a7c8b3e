"""The security-event policy as batch operators.

Events: sandbox, seq (order of arrival), event_type, pid, ppid, comm, arg, ip, port.
A null sandbox is a sandbox of its own.  Events of one sandbox and seq arrive
together: neither is before the other.  No event is lost or repeated, whatever is
null.  Work on one sandbox or process is cut into stretches of ``STRETCH`` seqs, so
a sandbox or a pid with most of all events is not one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dotted_quad, is_interpreter, is_sensitive
from tessera.plans import ir
from tessera.plans.lineage import cut
from tessera.plans.lower import Lowering
from tessera.plans.schema import Field, Schema

#: fixed values: event types of the stream
EXEC, OPEN, CONNECT, TRAP, STATE = 1, 2, 3, 4, 5
SYSTEM, STOPPED = "system", "Virtual Machine Terminated (Security Kill Switch)"
REGISTER, UNREGISTER = 101, 102  # control events: set a process's flag (ip 0 or 1), forget a process
BATCH = 64
STRETCH_BITS = 16

TRACE = Schema("syscall_trace", tuple(Field(n, 8 * i, least=0, most=1 << 32) for i, n in enumerate(("pid", "ppid", "event_type", "is_preinstall", "is_sensitive", "is_unauthorized"))), 64)


def violation_expression() -> ir.Node:
    """is_preinstall and (a sensitive open or an unauthorized connection)"""
    flag = lambda name: ir.eq(ir.load(name), ir.const(1))
    kind = lambda k: ir.eq(ir.load("event_type"), ir.const(k))
    return ir.and_(flag("is_preinstall"), ir.or_(ir.and_(kind(OPEN), flag("is_sensitive")), ir.and_(kind(CONNECT), flag("is_unauthorized"))))


def violates() -> Column:
    return Lowering(TRACE).mask(violation_expression())


def classify(events: DataFrame) -> DataFrame:
    """Adds is_sensitive (opens of sensitive paths) and is_unauthorized (every connection), 0 or 1."""
    kind = F.col("event_type")
    return events.withColumns({"is_sensitive": F.coalesce((kind == OPEN) & is_sensitive(F.col("arg")), F.lit(False)).cast("bigint"), "is_unauthorized": F.coalesce(kind == CONNECT, F.lit(False)).cast("bigint")})


def own_rule(events: DataFrame) -> Column:
    """An interpreter started by a process other than the first."""
    return is_interpreter(F.col("comm")) & (F.col("ppid") > 1)


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on equal ``names``, nulls equal too, that keeps the left ones; ``right`` has them as ``_k0`` .."""
    on = [F.col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(names)]
    return left.join(right, on, how).drop(*[f"_k{i}" for i in range(len(names))])


def _keys(*names: str) -> list[Column]:
    return [F.col(n).alias(f"_k{i}") for i, n in enumerate(names)]


def _is(*kinds: int) -> Column:
    return F.coalesce(F.col("event_type").isin(*kinds), F.lit(False))


def _latest(asks: DataFrame, marks: DataFrame, key: str, out: str) -> DataFrame:
    """As-of join: ``asks`` with ``out``, the seq of the last mark before each row of the process named by ``key``.

    Both sides are put in one order for each process and stretch; the last mark before a
    row is a running maximum there, or the last one of an earlier stretch.
    """
    kept = F.struct(*[F.col(c) for c in asks.columns])
    none = F.lit(None).cast(asks.select(kept.alias("x")).schema["x"].dataType)
    # keys that are never null, so that the windows and the join below share one shuffle
    keys = ["_box", "_p", "_nulls", "_s"]
    named = lambda k: [F.coalesce("sandbox", F.lit(0)).alias("_box"), F.coalesce(k, F.lit(0)).alias("_p"), (F.col("sandbox").isNull().cast("int") + 2 * F.col(k).isNull().cast("int")).alias("_nulls"), F.shiftright("seq", STRETCH_BITS).alias("_s"), "seq"]
    both = marks.select(*named("pid"), F.col("seq").alias("_mark"), none.alias("_row")).union(asks.select(*named(key), F.lit(None).cast("bigint"), kept))
    ends = both.groupBy(*keys).agg(F.max("_mark").alias("_end"))
    order = Window.partitionBy(*keys[:3]).orderBy("_s")  # a row a stretch
    carried = ends.withColumn("_before", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("_before is not null").drop("_end")
    here = Window.partitionBy(*keys).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_here", F.max("_mark").over(here)).where("_row is not null").join(carried, keys, "left")
    return found.select("_row.*", F.when(F.col("_nulls") < 2, F.coalesce("_here", "_before")).alias(out))


def taint(events: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Adds is_preinstall: whether the process descends from an install hook when the event arrives.

    An EXEC is tainted by its own rule or by its parent's state before it; a later EXEC
    of a pid replaces the earlier.  Another event takes the state of its process, else of
    its parent, else 0.  Control events set and forget a process and are not returned.
    ``seeds`` (sandbox, pid, flag) are processes that are known beforehand.  Ancestors
    are followed by pointer jumping: each round doubles the distance, so a chain of n
    processes takes log2(n) rounds, and only rows that are still undecided take part.
    """
    kind = F.col("event_type")
    mark = [F.max(F.when(kind == EXEC, own_rule(events).cast("int")).when(kind == REGISTER, (F.col("ip") != 0).cast("int"))).alias("flag"), F.max(F.when(kind == EXEC, F.col("ppid"))).alias("ppid")]
    marks = events.where(_is(EXEC, REGISTER, UNREGISTER) & F.col("pid").isNotNull()).groupBy("sandbox", "pid", "seq").agg(*mark)
    if seeds is not None:
        known = seeds.groupBy("sandbox", "pid").agg(F.max("flag").cast("int").alias("flag"))
        marks = marks.unionByName(known.select("sandbox", "pid", F.lit(-1 << 62).cast("bigint").alias("seq"), "flag", F.lit(None).cast("bigint").alias("ppid")))
    marks = cut(marks)
    # flag: null where the process is forgotten; up: the mark of the parent that decides a flag of 0
    found = _latest(marks, marks, "ppid", "up").withColumn("up", F.when(F.col("flag") == 0, F.col("up")))
    undecided, decided = cut(found.where("up is not null")), cut(found.where("up is null"))
    while not undecided.isEmpty():
        above = decided.union(undecided).select(*_keys("sandbox", "pid", "seq"), F.col("flag").alias("_flag"), F.col("ppid").alias("_ppid"), F.col("up").alias("_up"))
        stepped = undecided.join(above, [F.col("sandbox").eqNullSafe(F.col("_k0")), F.col("ppid") == F.col("_k1"), F.col("up") == F.col("_k2")], "left")
        flag = F.greatest("flag", F.coalesce("_flag", F.lit(0)))
        stepped = cut(stepped.select("sandbox", "pid", "seq", flag.alias("flag"), F.col("_ppid").alias("ppid"), F.when(flag == 0, F.col("_up")).alias("up")))
        undecided, decided = stepped.where("up is not null"), decided.union(stepped.where("up is null"))
    flags = decided.select("sandbox", "pid", "seq", F.col("flag").cast("bigint").alias("_state"))
    started = events.where(_is(EXEC))
    started = _same(started, flags.select(*_keys("sandbox", "pid", "seq"), "_state"), ["sandbox", "pid", "seq"], "left").withColumn("is_preinstall", F.coalesce("_state", own_rule(events).cast("bigint"))).drop("_state")
    others = events.where(~_is(EXEC, REGISTER, UNREGISTER))
    for key, out in (("pid", "_own"), ("ppid", "_parents")):
        others = _latest(others, marks, key, "_at")
        others = _same(others, flags.select(*_keys("sandbox", "pid", "seq"), F.col("_state").alias(out)), ["sandbox", key, "_at"], "left").drop("_at")
    rest = others.withColumn("is_preinstall", F.coalesce("_own", "_parents", F.lit(0).cast("bigint"))).drop("_own", "_parents")
    return started.unionByName(rest)


def batches(traces: DataFrame, size: int = BATCH) -> DataFrame:
    """(sandbox, batch_id, n_rows, violations, complete): batches of ``size`` in order of arrival; a short one at the end is not complete."""
    rows = traces.select("sandbox", "seq", violates().alias("_bad")).withColumn("_s", F.shiftright("seq", STRETCH_BITS))
    counts = rows.groupBy("sandbox", "_s").count()
    before = Window.partitionBy("sandbox").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    bases = counts.select(*_keys("sandbox", "_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("sandbox", "_s").orderBy("seq")) - 1
    at = _same(rows.withColumn("_place", place), bases, ["sandbox", "_s"]).withColumn("batch_id", F.floor((F.col("_place") + F.col("_base")) / size).cast("bigint"))
    return at.groupBy("sandbox", "batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_bad").alias("violations")).withColumn("complete", F.col("n_rows") == size)


def kill_switch(traces: DataFrame) -> DataFrame:
    """Events up to the first violation of their sandbox, that one included."""
    first = traces.where(violates()).groupBy("sandbox").agg(F.min("seq").alias("_stop"))
    return _same(traces, first.select(*_keys("sandbox"), "_stop"), ["sandbox"], "left").where("_stop is null or seq <= _stop").drop("_stop")


def published(traces: DataFrame) -> DataFrame:
    """What the immediate path publishes for each sandbox: its first violation as it was, then the stop as a change of state.

    (sandbox, position, seq, event_type, pid, comm, arg, vm_running); of violations with one seq, one is named.
    """
    bad = traces.where(violates())
    first = bad.groupBy("sandbox").agg(F.min_by(F.struct("seq", "event_type", "pid", "comm", "arg"), F.struct("seq", F.coalesce("pid", F.lit(-1)), F.coalesce("arg", F.lit("")))).alias("e"))
    alert = first.select("sandbox", F.lit(0).alias("position"), "e.*", F.lit(1).alias("vm_running"))
    stop = first.select("sandbox", F.lit(1).alias("position"), "e.seq", F.lit(STATE).alias("event_type"), F.lit(0).cast("bigint").alias("pid"), F.lit(SYSTEM).alias("comm"), F.lit(STOPPED).alias("arg"), F.lit(0).alias("vm_running"))
    return alert.unionByName(stop)


def counters(traces: DataFrame) -> DataFrame:
    """(sandbox, execs, opens, connects, violations)"""
    kind = F.col("event_type")
    return traces.groupBy("sandbox").agg(F.count_if(kind == EXEC).alias("execs"), F.count_if(kind == OPEN).alias("opens"), F.count_if(kind == CONNECT).alias("connects"), F.count_if(violates()).alias("violations"))


def status(traces: DataFrame) -> DataFrame:
    """(sandbox, traps, vm_status): the hardware traps, and what the last change of state said (null without one)."""
    kind = F.col("event_type")
    return traces.groupBy("sandbox").agg(F.count_if(kind == TRAP).alias("traps"), F.max_by(F.when(kind == STATE, F.col("arg")), F.when(kind == STATE, F.col("seq"))).alias("vm_status"))


def model(traces: DataFrame) -> DataFrame:
    """The monitor's model, a row a sandbox: counters, processes, roots of the tree, and status.

    A change of state has its text in arg, and another port than 0 while the machine runs.
    The status is what the last one says; where the machine does not run it is
    KILLED after a violation or a stop by the kill switch, WAITING before any event, else OFFLINE.
    Changes of state count as nothing else.
    """
    seen = traces.where(~_is(STATE))
    kind, text = F.col("event_type"), F.coalesce("vm_status", F.lit(""))
    counted = seen.groupBy("sandbox").agg(F.count_if(kind == EXEC).alias("execs"), F.count_if(kind == OPEN).alias("opens"), F.count_if(kind == CONNECT).alias("connects"), F.count_if(kind == TRAP).alias("traps"), F.count_if(violates()).alias("violations"))
    state = traces.where(_is(STATE)).groupBy("sandbox").agg(F.max_by("arg", "seq").alias("vm_status"), F.max_by(F.coalesce(F.col("port"), F.lit(0)) != 0, "seq").alias("running"))
    sizes = process_tree(traces).groupBy("sandbox").agg(F.count(F.lit(1)).alias("processes"), F.count_if(F.col("depth") == 0).alias("roots"))
    boxes = traces.select("sandbox").distinct()
    for part in (counted, state, sizes):
        boxes = _same(boxes, part.withColumnRenamed("sandbox", "_k0"), ["sandbox"], "left")
    boxes = boxes.na.fill(0, ["execs", "opens", "connects", "traps", "violations", "processes", "roots"])
    down = F.when((F.col("violations") > 0) | text.contains("Kill Switch"), "KILLED").when(sum(F.col(c) for c in ("execs", "opens", "connects", "traps")) == 0, "WAITING").otherwise("OFFLINE")
    return boxes.withColumn("status", F.when(F.coalesce("running", F.lit(False)), "RUNNING").otherwise(down)).drop("running")


def log_line() -> Column:
    """An event as the report shows it."""
    kind, comm, arg = F.col("event_type"), F.substring(F.coalesce("comm", F.lit("")), 1, 15), F.coalesce("arg", F.lit(""))
    target = F.when(arg.isin("", "other_connect"), dotted_quad(F.col("ip"))).otherwise(arg)
    pid = F.concat(F.lit("PID "), F.lpad(F.col("pid").cast("string"), 5, " "), F.lit(" "), F.rpad(comm, 15, " "))
    bad = F.coalesce("is_preinstall", F.lit(0)) == 1
    return (
        F.when(kind == TRAP, F.concat(F.lit("[MTE TRAP] "), comm, F.lit(" violated hardware tags at "), arg))
        .when((kind == OPEN) & bad & (F.col("is_sensitive") == 1), F.concat(F.lit("[BLOCKED OPEN] preinstall "), comm, F.lit(" tried to read: "), arg))
        .when((kind == CONNECT) & bad & (F.col("is_unauthorized") == 1), F.concat(F.lit("[BLOCKED CONN] preinstall "), comm, F.lit(" exfil attempt: "), target, F.lit(":"), F.col("port").cast("string")))
        .when(kind == EXEC, F.concat(F.lit("[EXEC] "), pid, F.lit(" -> "), arg))
        .when(kind == OPEN, F.concat(F.lit("[OPEN] "), pid, F.lit(" path: "), arg))
        .when(kind == CONNECT, F.concat(F.lit("[CONNECT] "), pid, F.lit(" -> "), target, F.lit(":"), F.col("port").cast("string")))
    )


def last_events(traces: DataFrame, n: int = 12) -> DataFrame:
    """The report of the last ``n`` events; changes of state are not listed."""
    return traces.where(~_is(STATE)).orderBy(F.desc("seq")).limit(n)


def log(traces: DataFrame, n: int = 12) -> DataFrame:
    """(seq, sandbox, line): the last events as the report shows them."""
    return last_events(traces, n).select("seq", "sandbox", log_line().alias("line"))


def process_tree(events: DataFrame) -> DataFrame:
    """(sandbox, pid, depth, path): each process under its first EXEC, the path by order of arrival, so sorting by it draws the tree.

    A process is under its parent if that is not 0 and started before it, else it is a root.
    Ancestors are followed by pointer jumping to the root, however far it is.
    """
    first = events.where(_is(EXEC) & F.col("pid").isNotNull()).groupBy("sandbox", "pid").agg(F.min("seq").alias("seq"), F.min_by("ppid", F.struct("seq", "ppid")).alias("ppid"))
    parents = first.select(*_keys("sandbox", "pid"), F.col("seq").alias("_seq"))
    found = _same(first, parents, ["sandbox", "ppid"], "left")
    # path: the process and its ancestors below ``up``; labels have room for any number
    label = F.lpad(F.col("seq").cast("string"), 20, "0")
    state = cut(found.select("sandbox", "pid", F.when((F.col("_seq") < F.col("seq")) & (F.col("ppid") != 0), F.col("ppid")).alias("up"), label.alias("path"), F.lit(0).alias("depth")))
    while not state.where("up is not null").isEmpty():
        above = state.select(*_keys("sandbox", "pid"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        step = _same(state, above, ["sandbox", "up"], "left")
        linked = (F.col("up").isNotNull() & F.col("_path").isNotNull()).cast("int")
        state = cut(step.select("sandbox", "pid", F.col("_up").alias("up"), F.concat_ws("/", "_path", "path").alias("path"), (F.col("depth") + F.coalesce("_depth", F.lit(0)) + linked).alias("depth")))
    return state.select("sandbox", "pid", "depth", "path")


def tree_lines(events: DataFrame) -> DataFrame:
    """(sandbox, path, line): the tree as text, to be sorted by path."""
    first = events.where(_is(EXEC) & F.col("pid").isNotNull()).groupBy("sandbox", "pid").agg(F.min_by(F.struct("comm", "arg"), "seq").alias("e"))
    rows = _same(process_tree(events), first.select(*_keys("sandbox", "pid"), "e"), ["sandbox", "pid"])
    arg = F.when(F.coalesce("e.arg", F.lit("")) != "", F.concat(F.lit(" ["), F.col("e.arg"), F.lit("]"))).otherwise("")
    line = F.concat(F.expr("repeat('  ', depth)"), F.coalesce("e.comm", F.lit("")), F.lit(" (PID: "), F.col("pid").cast("string"), F.lit(")"), arg)
    return rows.select("sandbox", "path", line.alias("line"))
