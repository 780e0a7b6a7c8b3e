"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SENSITIVE, dotted_quad, is_install_command, is_package_manager, swap_port
from tessera.operators import planes as P
from tessera.operators import policy
from tessera.plans import ir
from tessera.plans.engine import Engine
from tessera.plans.ir import Node, add, and_, const, eq, ge, gt, inference_count, le, load, lsl, lsr, lt, mul, not_, or_, popcnt, select, set_weight, sub, sum_
from tessera.plans.schema import Field, Schema
from tessera.sources import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: the fixed-point view of lineitem: bounds come from the table's definition
LINEITEM = Schema(
    "lineitem",
    (
        Field("orderkey", 0, "int64", least=0, most=1 << 40, stored="l_orderkey"), Field("partkey", 8, "int64", least=0, most=1 << 40, stored="l_partkey"),
        Field("suppkey", 16, "int64", least=0, most=1 << 40, stored="l_suppkey"), Field("linenumber", 24, "int64", least=0, most=100, stored="l_linenumber"),
        Field("ship_date", 32, "int64", least=0, most=99991231, stored="l_shipdate", dated=True), Field("discount", 40, "float64", 10000, 0, 10000, "l_discount"),
        Field("quantity", 48, "float64", 1, 0, 1 << 20, "l_quantity"), Field("price", 56, "float64", 100, 0, 1 << 40, "l_extendedprice"),
    ),
    64,
)
#: the same columns without bounds: every 64-bit pattern may occur, so all operators take their wrapping forms
WIDE = Schema("wide", tuple(replace(f, type=f.type if f.type == "float64" else "uint64", least=None, most=None) for f in LINEITEM.fields), 64)

_VIEW = """(SELECT CAST(l_orderkey AS BIGINT) AS orderkey, CAST(l_partkey AS BIGINT) AS partkey, CAST(l_suppkey AS BIGINT) AS suppkey, CAST(l_linenumber AS BIGINT) AS linenumber,
 CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS ship_date, CAST(round(l_discount * 10000) AS BIGINT) AS discount, CAST(round(l_quantity) AS BIGINT) AS quantity,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem) v"""


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def engine(schema: Schema, expression: Node) -> Engine:
    e = Engine()
    e.register_schema(schema)
    e.set_expression(schema.name, expression)
    return e


def _scalar(name: str, expression: Node, sql: str, out: str = "result", schema: Schema = LINEITEM) -> None:
    """A query of one row; sums come as long, as their totals here are small."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(schema, expression)
        frame = e.execute_frame(schema.name, e.source(schema.name, lineitem(spark, sf_dir)), out)
        return frame.select(F.col(out).cast("bigint").alias(out))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT CAST({sql} AS BIGINT) AS {out} FROM {_VIEW}"


def _count(name: str, expression: Node, where: str, schema: Schema = LINEITEM) -> None:
    _scalar(name, expression, f"count(*) FILTER (WHERE {where})", "matches", schema)


def _vector(name: str, expression: Node, sql: str, precision: int = 1, schema: Schema = LINEITEM) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(schema, expression).execute_vector(schema.name, schema.view(lineitem(spark, sf_dir)), ["orderkey", "linenumber", "partkey"], precision)

    QUERIES[name] = query
    ORACLES[name] = f"SELECT orderkey, linenumber, partkey, CAST({sql} AS DOUBLE) / {precision}.0 AS prediction FROM {_VIEW}"


def q6_predicate() -> Node:
    return ir.conjunction(ge(load("ship_date"), const(19960101)), lt(load("ship_date"), const(19970101)), ge(load("discount"), const(500)), le(load("discount"), const(700)), lt(load("quantity"), const(24)))


def q6_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and revenue in cents."""
    e = engine(LINEITEM, q6_predicate())
    rows = e.matching("lineitem", e.source("lineitem", lineitem(spark, sf_dir)))
    return rows.agg(F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum(F.expr("(price * discount) div 10000")), F.lit(0)).alias("revenue"))


QUERIES["q6_revenue"] = q6_revenue
ORACLES["q6_revenue"] = f"""SELECT count(*) AS matches, CAST(coalesce(sum((price * discount) // 10000), 0) AS BIGINT) AS revenue FROM {_VIEW}
WHERE ship_date >= 19960101 AND ship_date < 19970101 AND discount >= 500 AND discount <= 700 AND quantity < 24"""

_price, _qty, _disc, _part, _supp = (load(x) for x in ("price", "quantity", "discount", "partkey", "suppkey"))

# comparisons, field against constant and field against field
_count("threshold_count", ir.exceeds("price", 2_500_000), "price > 2500000")
_count("cmp_gt", gt(_qty, const(30)), "quantity > 30")
_count("cmp_lt", lt(_qty, const(30)), "quantity < 30")
_count("cmp_ge", ge(_qty, const(30)), "quantity >= 30")
_count("cmp_le", le(_qty, const(30)), "quantity <= 30")
_count("cmp_eq", eq(_qty, const(30)), "quantity = 30")
_count("cmp_field_field", gt(_part, mul(_supp, const(20))), "partkey > suppkey * 20")
_count("cmp_unsigned_negative_constant", lt(_qty, const(-1)), "true", WIDE)
_count("cmp_gt_wide", gt(_qty, const(30)), "quantity > 30", WIDE)
_count("cmp_le_fields_wide", le(_part, _supp), "partkey <= suppkey", WIDE)
# logic
_count("logic_and", and_(gt(_qty, const(10)), lt(_disc, const(500))), "quantity > 10 AND discount < 500")
_count("logic_or", or_(gt(_qty, const(45)), lt(_disc, const(100))), "quantity > 45 OR discount < 100")
_count("logic_not", not_(gt(_qty, const(10))), "NOT quantity > 10")
_count("logic_and_or_not", or_(and_(gt(_qty, const(10)), not_(eq(_disc, const(500)))), ge(_price, const(5_000_000))), "(quantity > 10 AND NOT discount = 500) OR price >= 5000000")
# arithmetic
_count("arith_add_gt", ir.sum_of_two_exceeds("quantity", "discount", "partkey"), "quantity + discount > partkey")
_count("arith_sub_lt", lt(sub(const(1000), _qty), const(970)), "1000 - quantity < 970")
_count("arith_sub_wrap", lt(sub(_qty, const(25)), const(5)), "quantity - 25 >= 0 AND quantity - 25 < 5")
_count("arith_sub_wrap_fields", lt(sub(_part, _supp), const(1000)), "partkey - suppkey >= 0 AND partkey - suppkey < 1000", WIDE)
_scalar("arith_add_sum", add(_qty, _disc), "sum(quantity + discount)")
_scalar("arith_mul", mul(_qty, _price), "sum(quantity * price)")
_count("arith_mul_wrap", gt(mul(mul(_price, _price), mul(_price, const(1_000_003))), const(1 << 62)), "(CAST(price AS HUGEINT) * price * price % 18446744073709551616) * 1000003 % 18446744073709551616 > 4611686018427387904", WIDE)
_scalar("shift_left", lsl(_qty, 3), "sum(quantity * 8)")
_scalar("shift_right", lsr(_price, 5), "sum(price >> 5)")
_scalar("shift_out", add(lsl(_qty, 64), lsr(_price, 64)), "sum(0)")
_scalar("popcnt_bits", popcnt(_price), "sum(bit_count(price))")
_scalar("popcnt_mask", popcnt(and_(gt(_qty, const(25)), lt(_disc, const(500)))), "count(*) FILTER (WHERE quantity > 25 AND discount < 500)")
_scalar("inference_count", inference_count(gt(_qty, const(25))), "count(*) FILTER (WHERE quantity > 25)")
_scalar("select_value", select(gt(_qty, const(25)), _price, const(7)), "sum(CASE WHEN quantity > 25 THEN price ELSE 7 END)")


# forests
def _tree(field: str, t: int, a: int, b: int) -> Node:
    return select(gt(load(field), const(t)), const(a), const(b))


def _tree_sql(field: str, t: int, a: int, b: int) -> str:
    return f"CASE WHEN {field} > {t} THEN {a} ELSE {b} END"


_FOREST = [(("quantity", "discount", "linenumber", "suppkey")[i % 4], (10 + i % 30, 100 + 10 * (i % 80), 1 + i % 6, 5 + i)[i % 4], 100 + i, i) for i in range(100)]
FOREST_100 = sum_(*[_tree(*t) for t in _FOREST])
_FOREST_SQL = " + ".join(_tree_sql(*t) for t in _FOREST)
_NESTED = select(gt(_qty, const(20)), select(lt(_disc, const(300)), const(11), const(22)), select(gt(_price, const(1_000_000)), const(33), _qty))
_NESTED_SQL = "CASE WHEN quantity > 20 THEN CASE WHEN discount < 300 THEN 11 ELSE 22 END ELSE CASE WHEN price > 1000000 THEN 33 ELSE quantity END END"
_MASKS = [set_weight(gt(_qty, const(10)), 5), set_weight(and_(lt(_disc, const(500)), gt(_qty, const(30))), 7), set_weight(not_(eq(_disc, const(0))), 2)]
_MASKS_SQL = "CASE WHEN quantity > 10 THEN 5 ELSE 0 END + CASE WHEN discount < 500 AND quantity > 30 THEN 7 ELSE 0 END + CASE WHEN discount <> 0 THEN 2 ELSE 0 END"

_scalar("select_sum", sum_(_tree("quantity", 25, 50, 10)), f"sum({_tree_sql('quantity', 25, 50, 10)})")
_scalar("forest_sum", FOREST_100, f"sum({_FOREST_SQL})")
_scalar("forest_intercept", add(sum_(_tree("quantity", 25, 50, 10), _tree("discount", 300, 20, 5)), const(1000)), f"sum({_tree_sql('quantity', 25, 50, 10)} + {_tree_sql('discount', 300, 20, 5)} + 1000)")
_scalar("forest_weighted_masks", sum_(*_MASKS), f"sum({_MASKS_SQL})")
_scalar("forest_nested", sum_(_NESTED, _tree("quantity", 5, 3, 1)), f"sum({_NESTED_SQL} + {_tree_sql('quantity', 5, 3, 1)})")
_scalar("arithmetic_tree_root", add(_tree("quantity", 25, 50, 10), _tree("discount", 300, 20, 5)), f"sum({_tree_sql('quantity', 25, 50, 10)} + {_tree_sql('discount', 300, 20, 5)})")

# trees without bounds and without constant leaves
_GROWN = [select(gt(load(a), const(t)), add(load(b), const(t)), sub(load(b), load(a))) for a, b, t in (("quantity", "price", 10), ("discount", "price", 300), ("linenumber", "partkey", 3), ("suppkey", "price", 40), ("price", "quantity", 5), ("quantity", "partkey", 25), ("partkey", "suppkey", 900), ("suppkey", "partkey", 7), ("discount", "quantity", 700))]
_GROWN_SQL = " + ".join(f"CASE WHEN {a} > {t} THEN {b} + {t} ELSE {b} - {a} END" for a, b, t in (("quantity", "price", 10), ("discount", "price", 300), ("linenumber", "partkey", 3), ("suppkey", "price", 40), ("price", "quantity", 5), ("quantity", "partkey", 25), ("partkey", "suppkey", 900), ("suppkey", "partkey", 7), ("discount", "quantity", 700)))
_vector("vector_forest_wide", sum_(*_GROWN), _GROWN_SQL, 10, WIDE)

# a value for each row
_vector("vector_mask", gt(_qty, const(25)), "CASE WHEN quantity > 25 THEN 1 ELSE 0 END")
_vector("vector_forest", FOREST_100, _FOREST_SQL, 100)
_vector("vector_forest_intercept", add(sum_(*_MASKS), const(9)), f"{_MASKS_SQL} + 9", 10)
_vector("vector_arith", sub(_qty, const(25)), "quantity - 25", 4)
_vector("vector_arith_wide", sub(_part, _supp), "partkey - suppkey", 2, WIDE)


def exec_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and matches, as the engine's statistics count them (its seconds are not part of the query's rows)."""
    found = engine(LINEITEM, gt(_qty, const(25))).execute_stats("lineitem", LINEITEM.view(lineitem(spark, sf_dir)))
    return spark.range(1).select(F.lit(found["rows"]).cast("long").alias("n_rows"), F.lit(found["result"]).cast("long").alias("matches"))


QUERIES["exec_stats"] = exec_stats
ORACLES["exec_stats"] = f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE quantity > 25) AS matches FROM {_VIEW}"


def field_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LINEITEM.view(lineitem(spark, sf_dir).where("l_orderkey = 7")).select("orderkey", "linenumber", "price")


QUERIES["field_point_read"] = field_point_read
ORACLES["field_point_read"] = f"SELECT orderkey, linenumber, price FROM {_VIEW} WHERE orderkey = 7"


# bit-planes of part, whose keys number its rows from 0
def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("bigint").alias("position"), F.col("p_size").cast("bigint").alias("v"))


_PARTS = "(SELECT CAST(p_partkey AS BIGINT) AS position, CAST(p_size AS BIGINT) AS v FROM part) p"


def _words(n: int) -> str:
    return f"""SELECT block_id, bit, CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) AS plane FROM
(SELECT position // 64 AS block_id, b.bit AS bit, sum(CASE WHEN (v >> b.bit) & 1 = 1 THEN CAST(1 AS HUGEINT) << CAST(position % 64 AS INTEGER) ELSE 0 END) AS w
 FROM {_PARTS}, (SELECT CAST(range AS INTEGER) AS bit FROM range({n})) b GROUP BY 1, 2)"""



def slice_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.as_rows(P.slice_planes(_parts(spark, sf_dir), "position", "v"))


def slice_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.as_rows(P.slice_planes(_parts(spark, sf_dir), "position", "v", 4)).where("bit < 4")


def unslice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unslice(P.slice_planes(_parts(spark, sf_dir), "position", "v"))


def native_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.native_count(P.slice_planes(_parts(spark, sf_dir), "position", "v"), 25)


#: part in the native layout: sizes, prices in cents and keys as bit-planes of blocks of 64 rows
PART = Schema("part", (Field("size", 0), Field("cents", 8), Field("key", 16)), 24)
_PART_SQL = "(SELECT CAST(p_size AS BIGINT) AS size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, CAST(p_partkey AS BIGINT) AS key FROM part) p"


def part_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_partkey").cast("bigint").alias("key"), F.col("p_size").cast("bigint").alias("size"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"))
    return P.slice_fields(rows, "key", ["size", "cents", "key"])


def _native(name: str, expression: Node, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(PART, expression).execute_native("part", part_planes(spark, sf_dir)).select(F.col("result").cast("bigint").alias("result"))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT CAST({sql} AS BIGINT) AS result FROM {_PART_SQL}"


_size, _cents, _key = (load(x) for x in ("size", "cents", "key"))
_native("native_logic", and_(or_(gt(_size, const(25)), lt(add(_cents, _size), const(100_000))), not_(eq(lsr(_key, 1), lsl(_size, 1)))), "count(*) FILTER (WHERE (size > 25 OR cents + size < 100000) AND NOT key // 2 = size * 2)")
_native("native_sum", add(mul(_size, _cents), popcnt(sub(_cents, _size))), "sum(size * cents + bit_count(cents - size))")
_native("native_wrap", lt(sub(_size, const(25)), const(5)), "count(*) FILTER (WHERE size BETWEEN 25 AND 29)")
_native("native_forest", add(sum_(select(gt(_size, const(25)), const(50), const(10)), select(lt(_cents, const(120_000)), _size, const(7)), set_weight(ge(_key, const(100)), 3), inference_count(gt(_size, const(40)))), const(1000)), "sum(CASE WHEN size > 25 THEN 50 ELSE 10 END + CASE WHEN cents < 120000 THEN size ELSE 7 END + CASE WHEN key >= 100 THEN 3 ELSE 0 END + CASE WHEN size > 40 THEN 1 ELSE 0 END + 1000)")


QUERIES |= {"slice_planes": slice_planes, "slice_n": slice_n, "unslice_roundtrip": unslice_roundtrip, "native_count": native_count}
ORACLES |= {"slice_planes": _words(63) + f" UNION ALL SELECT DISTINCT position // 64, 63, CAST(0 AS BIGINT) FROM {_PARTS}", "slice_n": _words(4), "unslice_roundtrip": f"SELECT position, v AS value FROM {_PARTS}", "native_count": f"SELECT count(*) AS result FROM {_PARTS} WHERE v > 25"}


# the policy over events
def _traces(spark: SparkSession, sf_dir: str, view: str = E.FROM_TABLE) -> DataFrame:
    return policy.taint(policy.classify(E.from_table(spark, sf_dir, view)))


_SENSITIVE_SQL = "(" + " OR ".join(f"contains(arg, '{p}')" for p in SENSITIVE) + ")"
def _classified_sql(view: str) -> str:
    return f"""ev AS ({view}),
cl AS (SELECT *, CAST(CASE WHEN event_type = 2 AND {_SENSITIVE_SQL} THEN 1 ELSE 0 END AS BIGINT) AS is_sensitive, CAST(CASE WHEN event_type = 3 THEN 1 ELSE 0 END AS BIGINT) AS is_unauthorized FROM ev)"""


def _traces_sql(view: str) -> str:
    return f"""WITH RECURSIVE {_classified_sql(view)},
ex AS (SELECT sandbox, seq, pid, CASE WHEN event_type = 1 THEN ppid END AS ppid, CASE event_type WHEN 1 THEN CASE WHEN comm IN ('sh', 'bash', 'node', 'python') AND ppid > 1 THEN 1 ELSE 0 END WHEN 101 THEN CASE WHEN ip <> 0 THEN 1 ELSE 0 END END AS own
 FROM cl WHERE event_type IN (1, 101, 102)),
up AS (SELECT e.sandbox, e.seq, e.own, max(p.seq) AS parent FROM ex e LEFT JOIN ex p ON p.sandbox = e.sandbox AND p.pid = e.ppid AND p.seq < e.seq GROUP BY 1, 2, 3),
chain AS (SELECT sandbox, seq, own, parent FROM up UNION SELECT c.sandbox, c.seq, u.own, u.parent FROM chain c JOIN up u ON u.sandbox = c.sandbox AND u.seq = c.parent WHERE c.own = 0),
fl AS (SELECT sandbox, seq, max(own) AS flag FROM chain GROUP BY 1, 2),
a AS (SELECT o.sandbox, o.seq, max(p.seq) AS s FROM cl o JOIN ex p ON p.sandbox = o.sandbox AND p.pid = o.pid AND p.seq < o.seq WHERE o.event_type <> 1 GROUP BY 1, 2),
b AS (SELECT o.sandbox, o.seq, max(p.seq) AS s FROM cl o JOIN ex p ON p.sandbox = o.sandbox AND p.pid = o.ppid AND p.seq < o.seq WHERE o.event_type <> 1 GROUP BY 1, 2),
tr AS (SELECT cl.*, CAST(CASE WHEN event_type = 1 THEN own.flag ELSE coalesce(fa.flag, fb.flag, 0) END AS BIGINT) AS is_preinstall FROM cl
 LEFT JOIN fl own ON own.sandbox = cl.sandbox AND own.seq = cl.seq
 LEFT JOIN a ON a.sandbox = cl.sandbox AND a.seq = cl.seq LEFT JOIN fl fa ON fa.sandbox = a.sandbox AND fa.seq = a.s
 LEFT JOIN b ON b.sandbox = cl.sandbox AND b.seq = cl.seq LEFT JOIN fl fb ON fb.sandbox = b.sandbox AND fb.seq = b.s WHERE event_type NOT IN (101, 102))"""


_TRACES_SQL = _traces_sql(E.FROM_TABLE)
_VIOLATES_SQL = "(is_preinstall = 1 AND ((event_type = 2 AND is_sensitive = 1) OR (event_type = 3 AND is_unauthorized = 1)))"


_TREE_SQL = """fe AS (SELECT sandbox, pid, seq, ppid FROM ev WHERE event_type = 1 QUALIFY row_number() OVER (PARTITION BY sandbox, pid ORDER BY seq) = 1),
under AS (SELECT c.sandbox, c.pid, c.seq, p.pid AS above FROM fe c LEFT JOIN fe p ON p.sandbox = c.sandbox AND p.pid = c.ppid AND c.ppid <> 0 AND p.seq < c.seq),
tree AS (SELECT sandbox, pid, 0 AS depth, lpad(CAST(seq AS VARCHAR), 20, '0') AS path FROM under WHERE above IS NULL
 UNION ALL SELECT u.sandbox, u.pid, t.depth + 1, t.path || '/' || lpad(CAST(u.seq AS VARCHAR), 20, '0') FROM under u JOIN tree t ON t.sandbox = u.sandbox AND t.pid = u.above)"""


def policy_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.classify(E.from_table(spark, sf_dir)).select("sandbox", "seq", "event_type", "is_sensitive", "is_unauthorized")


def policy_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).select("sandbox", "seq", "pid", "is_preinstall")


def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).where(policy.violates()).select("sandbox", "seq", "event_type", "pid")


def policy_batches64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.batches(_traces(spark, sf_dir))


def policy_killswitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.kill_switch(_traces(spark, sf_dir)).select("sandbox", "seq")


def policy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.counters(_traces(spark, sf_dir))


def policy_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.last_events(_traces(spark, sf_dir)).select("seq", "sandbox", "event_type", "is_preinstall")


def policy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.status(E.from_table(spark, sf_dir))


def policy_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = E.from_table(spark, sf_dir).where("event_type = 1").groupBy("sandbox", "pid").agg(F.min("seq").alias("seq"), F.min_by("ppid", "seq").alias("ppid"), F.min_by("comm", "seq").alias("comm"))
    return first


def policy_process_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.process_tree(E.from_table(spark, sf_dir))


def policy_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taint with control events among the others."""
    return _traces(spark, sf_dir, E.WITH_CONTROL).select("sandbox", "seq", "pid", "is_preinstall")


def policy_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.published(_traces(spark, sf_dir)).select("sandbox", "position", "seq", "event_type", "pid", "arg", "vm_running")


def policy_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.model(_traces(spark, sf_dir, E.WITH_STATES))


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.log(_traces(spark, sf_dir, E.WITH_STATES))


def policy_tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.tree_lines(E.from_table(spark, sf_dir))


def policy_stream_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form of the taint, run over the whole table as one trigger."""
    from tessera.streaming.policy_stream import run_once

    return run_once(spark, E.from_table(spark, sf_dir)).select("sandbox", "seq", "pid", "is_preinstall")


QUERIES |= {"policy_classify": policy_classify, "policy_taint": policy_taint, "policy_violations": policy_violations, "policy_batches64": policy_batches64, "policy_killswitch": policy_killswitch, "policy_counters": policy_counters, "policy_last_events": policy_last_events, "policy_status": policy_status, "policy_processes": policy_processes, "policy_process_tree": policy_process_tree, "policy_stream_taint": policy_stream_taint, "policy_control": policy_control, "policy_published": policy_published, "policy_model": policy_model, "policy_log": policy_log, "policy_tree_lines": policy_tree_lines}
ORACLES |= {
    "policy_classify": f"WITH {_classified_sql(E.FROM_TABLE)} SELECT sandbox, seq, CAST(event_type AS INTEGER) AS event_type, is_sensitive, is_unauthorized FROM cl",
    "policy_taint": f"{_TRACES_SQL} SELECT sandbox, seq, pid, is_preinstall FROM tr",
    "policy_violations": f"{_TRACES_SQL} SELECT sandbox, seq, event_type, pid FROM tr WHERE {_VIOLATES_SQL}",
    "policy_batches64": f"{_TRACES_SQL}, nb AS (SELECT *, CAST((row_number() OVER (PARTITION BY sandbox ORDER BY seq) - 1) // 64 AS BIGINT) AS batch_id FROM tr) SELECT sandbox, batch_id, count(*) AS n_rows, count(*) FILTER (WHERE {_VIOLATES_SQL}) AS violations, count(*) = 64 AS complete FROM nb GROUP BY 1, 2",
    "policy_killswitch": f"{_TRACES_SQL}, st AS (SELECT sandbox, min(seq) AS stop FROM tr WHERE {_VIOLATES_SQL} GROUP BY 1) SELECT tr.sandbox, tr.seq FROM tr LEFT JOIN st ON st.sandbox = tr.sandbox WHERE stop IS NULL OR tr.seq <= stop",
    "policy_counters": f"{_TRACES_SQL} SELECT sandbox, count(*) FILTER (WHERE event_type = 1) AS execs, count(*) FILTER (WHERE event_type = 2) AS opens, count(*) FILTER (WHERE event_type = 3) AS connects, count(*) FILTER (WHERE {_VIOLATES_SQL}) AS violations FROM tr GROUP BY 1",
    "policy_last_events": f"{_TRACES_SQL} SELECT seq, sandbox, event_type, is_preinstall FROM tr ORDER BY seq DESC LIMIT 12",
    "policy_status": f"WITH ev AS ({E.FROM_TABLE}) SELECT sandbox, count(*) FILTER (WHERE event_type = 4) AS traps, arg_max(arg, seq) FILTER (WHERE event_type = 5) AS vm_status FROM ev GROUP BY 1",
    "policy_processes": f"WITH ev AS ({E.FROM_TABLE}) SELECT sandbox, pid, seq, ppid, comm FROM ev WHERE event_type = 1 QUALIFY row_number() OVER (PARTITION BY sandbox, pid ORDER BY seq) = 1",
    "policy_process_tree": f"WITH RECURSIVE ev AS ({E.FROM_TABLE}), {_TREE_SQL} SELECT sandbox, pid, CAST(depth AS INTEGER) AS depth, path FROM tree",
    "policy_tree_lines": f"""WITH RECURSIVE ev AS ({E.FROM_TABLE}), {_TREE_SQL}
SELECT t.sandbox, t.path, repeat('  ', t.depth) || e.comm || ' (PID: ' || t.pid || ')' || CASE WHEN coalesce(e.arg, '') <> '' THEN ' [' || e.arg || ']' ELSE '' END AS line
FROM tree t JOIN (SELECT * FROM ev WHERE event_type = 1 QUALIFY row_number() OVER (PARTITION BY sandbox, pid ORDER BY seq) = 1) e ON e.sandbox = t.sandbox AND e.pid = t.pid""",
    "policy_control": f"{_traces_sql(E.WITH_CONTROL)} SELECT sandbox, seq, pid, is_preinstall FROM tr",
    "policy_published": f"""{_TRACES_SQL}, fv AS (SELECT * FROM tr WHERE {_VIOLATES_SQL} QUALIFY row_number() OVER (PARTITION BY sandbox ORDER BY seq) = 1)
SELECT sandbox, 0 AS position, seq, CAST(event_type AS INTEGER) AS event_type, pid, arg, 1 AS vm_running FROM fv UNION ALL SELECT sandbox, 1, seq, 5, CAST(0 AS BIGINT), 'Virtual Machine Terminated (Security Kill Switch)', 0 FROM fv""",
    "policy_model": f"""{_traces_sql(E.WITH_STATES)}, {_TREE_SQL},
c AS (SELECT sandbox, count(*) FILTER (WHERE event_type = 1) AS execs, count(*) FILTER (WHERE event_type = 2) AS opens, count(*) FILTER (WHERE event_type = 3) AS connects, count(*) FILTER (WHERE event_type = 4) AS traps,
 count(*) FILTER (WHERE {_VIOLATES_SQL}) AS violations, arg_max(arg, seq) FILTER (WHERE event_type = 5) AS vm_status, arg_max(port, seq) FILTER (WHERE event_type = 5) AS running FROM tr GROUP BY 1),
p AS (SELECT sandbox, count(*) AS processes, count(*) FILTER (WHERE depth = 0) AS roots FROM tree GROUP BY 1)
SELECT c.sandbox, execs, opens, connects, traps, violations, vm_status, coalesce(processes, 0) AS processes, coalesce(roots, 0) AS roots,
 CASE WHEN coalesce(running, 0) <> 0 THEN 'RUNNING' WHEN violations > 0 OR contains(coalesce(vm_status, ''), 'Kill Switch') THEN 'KILLED' WHEN execs + opens + connects + traps = 0 THEN 'WAITING' ELSE 'OFFLINE' END AS status
FROM c LEFT JOIN p ON p.sandbox = c.sandbox""",
    "policy_log": f"""{_traces_sql(E.WITH_STATES)}, l AS (SELECT *, substr(coalesce(comm, ''), 1, 15) AS c, CASE WHEN coalesce(arg, '') IN ('', 'other_connect') THEN {' || chr(46) || '.join(f"CAST((ip >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))} ELSE arg END AS target,
 'PID ' || lpad(CAST(pid AS VARCHAR), 5, ' ') || ' ' || rpad(substr(coalesce(comm, ''), 1, 15), 15, ' ') AS who FROM tr WHERE event_type <> 5 ORDER BY seq DESC LIMIT 12)
SELECT seq, sandbox, CASE WHEN event_type = 4 THEN '[MTE TRAP] ' || c || ' violated hardware tags at ' || coalesce(arg, '') WHEN event_type = 2 AND is_preinstall = 1 AND is_sensitive = 1 THEN '[BLOCKED OPEN] preinstall ' || c || ' tried to read: ' || arg
 WHEN event_type = 3 AND is_preinstall = 1 THEN '[BLOCKED CONN] preinstall ' || c || ' exfil attempt: ' || target || ':' || port WHEN event_type = 1 THEN '[EXEC] ' || who || ' -> ' || coalesce(arg, '')
 WHEN event_type = 2 THEN '[OPEN] ' || who || ' path: ' || coalesce(arg, '') ELSE '[CONNECT] ' || who || ' -> ' || target || ':' || port END AS line FROM l""",
    "policy_stream_taint": f"{_TRACES_SQL} SELECT sandbox, seq, pid, is_preinstall FROM tr",
}


def ip_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.from_table(spark, sf_dir).select("seq", dotted_quad(F.col("ip")).alias("ip"), dotted_quad(F.col("ip"), network_order=True).alias("reversed_ip"))


def port_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.from_table(spark, sf_dir).select("seq", swap_port(F.col("port")).alias("port"))


def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("/bin/npm", "/opt/shield/npm", "/bin/ls", "/u/yarn.js", "/x/pnpm")]), (F.col("page_id") % 5 + 1).cast("int")), F.col("page_id").cast("string"))
    command = F.element_at(F.array(*[F.lit(x) for x in ("install", "i", "ci", "add", "run", "Install")]), (F.col("page_id") % 6 + 1).cast("int"))
    return rows.select("page_id", is_package_manager(path, "shield").alias("is_manager"), is_install_command(command).alias("is_install"))


QUERIES |= {"ip_dotted": ip_dotted, "port_swap": port_swap, "path_predicates": path_predicates}
_OCT = "CAST((ip >> {}) & 255 AS VARCHAR)"
ORACLES |= {
    "ip_dotted": f"SELECT seq, {' || chr(46) || '.join(_OCT.format(s) for s in (24, 16, 8, 0))} AS ip, {' || chr(46) || '.join(_OCT.format(s) for s in (0, 8, 16, 24))} AS reversed_ip FROM ({E.FROM_TABLE}) ev",
    "port_swap": f"SELECT seq, CAST((port & 255) * 256 + port // 256 AS BIGINT) AS port FROM ({E.FROM_TABLE}) ev",
    "path_predicates": "SELECT page_id, page_id % 5 IN (0, 3, 4) AS is_manager, page_id % 6 < 4 AS is_install FROM pages",
}
