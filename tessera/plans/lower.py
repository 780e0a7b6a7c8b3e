"""From expressions to Spark columns.

Values carry their bounds, found by interval arithmetic over exact integers.
Where no operation can leave 0 .. 2^63 - 1 the plain operators are used, which
Catalyst folds and pushes down; elsewhere the wrapping forms.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import unsigned as U
from tessera.plans.ir import MASK, ExpressionError, Node
from tessera.plans.schema import Schema

ANY = (0, U.WORD - 1)


@dataclass(frozen=True)
class Value:
    column: Column
    least: int = 0
    most: int = U.WORD - 1

    @property
    def plain(self) -> bool:
        return self.least >= 0 and self.most < U.HALF


class Lowering:
    """Columns of an expression.  With ``lets``, an operand that a wrapping form names several times gets a name of
    its own, and ``bind`` adds the names to the rows below; without, it is bound inside the expression, which
    needs no rows but is interpreted."""

    def __init__(self, schema: Schema, lets: bool = False):
        self.schema = schema
        self.lets: list[tuple[int, str, Column]] | None = [] if lets else None

    def bind(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the named operands, a projection for each level of nesting."""
        for level in sorted({x for x, _, _ in self.lets or ()}):
            rows = rows.withColumns({name: c for x, name, c in self.lets if x == level})
        return rows

    def _operand(self, n: Node) -> Value:
        """A value that may be named several times."""
        begin = len(self.lets or ())
        v = self.plane(n)
        if self.lets is None or n.kind in ("load", "const"):
            return v
        level = 1 + max((x for x, _, _ in self.lets[begin:]), default=0)
        name = f"__x{len(self.lets)}"
        self.lets.append((level, name, v.column))
        return replace(v, column=F.col(name))

    def mask(self, n: Node) -> Column:
        """A boolean; null where a field is null, which no filter or count takes for a match."""
        if n.result != MASK:
            raise ExpressionError(f"{n.kind} is no mask")
        k = n.kind
        if k == "and":
            return self.mask(n.args[0]) & self.mask(n.args[1])
        if k == "or":
            return self.mask(n.args[0]) | self.mask(n.args[1])
        if k == "not":
            return ~self.mask(n.args[0])
        return self._compare(k, *n.args)

    def _compare(self, kind: str, x: Node, y: Node) -> Column:
        if x.kind == "const" and y.kind != "const":
            return self._compare({"gt": "lt", "lt": "gt", "ge": "le", "le": "ge", "eq": "eq"}[kind], y, x)
        a, b = self._operand(x), self._operand(y)
        if kind == "eq":
            return a.column == b.column
        if a.plain and b.plain:
            return {"gt": a.column > b.column, "lt": a.column < b.column, "ge": a.column >= b.column, "le": a.column <= b.column}[kind]
        if y.kind == "const":
            if kind in ("gt", "ge"):
                return U.greater_than_constant(a.column, y.value, kind == "ge")
            return U.less_than_constant(a.column, y.value, kind == "le")
        if kind in ("gt", "le"):
            over = U.greater(a.column, b.column)
            return over if kind == "gt" else ~over
        under = U.greater(b.column, a.column)
        return under if kind == "lt" else ~under

    def plane(self, n: Node) -> Value:
        """Raw bits of an unsigned 64-bit number, and its bounds."""
        if n.result == MASK:
            raise ExpressionError(f"{n.kind} is a mask")
        return getattr(self, f"_{n.kind}")(n)

    def _load(self, n: Node) -> Value:
        return Value(F.col(f"`{n.name}`"), *self.schema.field(n.name).bounds())

    def _const(self, n: Node) -> Value:
        return Value(U.lit(n.value), n.value % U.WORD, n.value % U.WORD)

    def _wrapped(self, operation, n: Node, a: Value, b: Value) -> Column:
        named = self.lets is not None or all(x.kind in ("load", "const") for x in n.args)
        return operation(a.column, b.column) if named else U.bound(operation, a.column, b.column)

    def _add(self, n: Node) -> Value:
        a, b = self._operand(n.args[0]), self._operand(n.args[1])
        if a.plain and b.plain and a.most + b.most < U.HALF:
            return Value(a.column + b.column, a.least + b.least, a.most + b.most)
        return Value(self._wrapped(U.wrap_add, n, a, b), *ANY)

    def _sub(self, n: Node) -> Value:
        a, b = self._operand(n.args[0]), self._operand(n.args[1])
        if a.plain and b.plain:  # no overflow of signed numbers, and the same bits
            return Value(a.column - b.column, *((a.least - b.most, a.most - b.least) if a.least >= b.most else ANY))
        return Value(self._wrapped(U.wrap_sub, n, a, b), *ANY)

    def _mul(self, n: Node) -> Value:
        a, b = self._operand(n.args[0]), self._operand(n.args[1])
        if a.plain and b.plain and a.most * b.most < U.HALF:
            return Value(a.column * b.column, a.least * b.least, a.most * b.most)
        return Value(self._wrapped(U.wrap_mul, n, a, b), *ANY)

    def _lsl(self, n: Node) -> Value:
        a = self.plane(n.args[0])
        most = a.most << min(n.value, 64)
        return Value(U.shift_left(a.column, n.value), *((a.least << n.value, most) if most < U.WORD else ANY if n.value < 64 else (0, 0)))

    def _lsr(self, n: Node) -> Value:
        a = self.plane(n.args[0])
        return Value(U.shift_right(a.column, n.value), a.least >> n.value, a.most >> n.value)

    def _popcnt(self, n: Node) -> Value:
        if n.args[0].result == MASK:  # the votes of a mask: each row has one
            return self._inference_count(n)
        return Value(F.bit_count(self.plane(n.args[0]).column).cast("bigint"), 0, 64)

    def _inference_count(self, n: Node) -> Value:
        return Value(F.coalesce(self.mask(n.args[0]), F.lit(False)).cast("bigint"), 0, 1)

    def _select(self, n: Node) -> Value:
        a, b = self.plane(n.args[1]), self.plane(n.args[2])
        return Value(F.when(self.mask(n.args[0]), a.column).otherwise(b.column), min(a.least, b.least), max(a.most, b.most))

    # sums over trees

    def forest(self, n: Node) -> tuple[list[Node], int]:
        """The trees of a sum, and the constant that each row adds."""
        if n.kind == "sum":
            return list(n.args), 0
        for x, y in (n.args, n.args[::-1]):
            if x.kind == "sum" and y.kind == "const":
                return list(x.args), U.signed(y.value)
        raise ExpressionError("a sum over trees can only take a constant")

    def term(self, n: Node) -> Column:
        """What a tree adds to a row, as a signed number."""
        if n.result == MASK:
            return F.when(self.mask(n), U.lit(n.weight)).otherwise(U.lit(0))
        return self.plane(n).column

    def _steps(self, trees: list[Node], offset: bool = False) -> tuple[list, list[Node]]:
        """Trees with one threshold and constant leaves, as one step function for each field; and the other trees.

        All trees of a field together are constant between its thresholds, so a row is
        looked up by bisection instead of passing each tree.  With ``offset``, values are
        counted from the least one: (column, least value, greatest value from there).
        """
        jumps: dict[str, dict[int, int]] = {}
        lowest, absent, others = {}, {}, []
        for t in trees:
            test = t.args[0] if t.kind == "select" and t.args[1].kind == t.args[2].kind == "const" else None
            if test is None or test.kind not in ("gt", "ge", "lt", "le") or test.args[0].kind != "load" or test.args[1].kind != "const" or not self.plane(test.args[0]).plain or not 0 <= test.args[1].value < U.HALF - 1:
                others.append(t)
                continue
            f, yes, no = test.args[0].name, U.signed(t.args[1].value), U.signed(t.args[2].value)
            below, above = (no, yes) if test.kind in ("gt", "ge") else (yes, no)
            at = test.args[1].value + (test.kind in ("gt", "le"))
            found = jumps.setdefault(f, {})
            found[at] = found.get(at, 0) + above - below
            lowest[f], absent[f] = lowest.get(f, 0) + below, absent.get(f, 0) + no
        out = []
        for f, found in jumps.items():
            column, edges, values = self._load(Node("load", name=f)).column, sorted(found), [lowest[f]]
            for e in edges:
                values.append(values[-1] + found[e])
            none, least = absent[f], min(*values, absent[f])
            if offset:
                values, none = [v - least for v in values], none - least

            def bisect(low: int, high: int, column=column, edges=edges, values=values) -> Column:
                if low == high:
                    return U.lit(values[low])
                middle = (low + high) // 2
                return F.when(column >= U.lit(edges[middle]), bisect(middle + 1, high)).otherwise(bisect(low, middle))

            value = F.when(column.isNull(), U.lit(none)).otherwise(bisect(0, len(edges)))
            out.append((value, least, max(*values, none)) if offset else value)
        return out, others

    def _reach(self, trees: list[Node], constant: int) -> int:
        return abs(constant) + sum(abs(U.signed(t.weight)) if t.result == MASK else self.plane(t).most for t in trees)

    def row_sum(self, n: Node) -> Column:
        """The whole sum of a row.  Many terms are folded over an array: one deep sum would become one huge method."""
        trees, constant = self.forest(n)
        begin = len(self.lets or ())
        reach = self._reach(trees, constant)
        if self.lets is not None:
            del self.lets[begin:]  # the names of the first look
        steps, trees = self._steps(trees) if reach < U.HALF else ([], trees)
        terms = [*steps, *map(self.term, trees), *([U.lit(constant)] if constant else [])]
        if len(terms) <= 16:
            return U.balanced(terms) if reach < U.HALF else U.wrap_add_all(terms)
        return F.aggregate(F.array(*terms), U.lit(0), (lambda a, x: a + x) if reach < U.HALF else U.wrap_add)

    def total(self, n: Node) -> Column:
        """The sum over all rows mod 2^64, as an aggregate.

        Trees with one threshold and constant leaves are one step function for each
        field, whose values are summed.  Another tree with constant leaves is a count of
        matches times the difference of its leaves; what is left is summed as it is.
        """
        trees, constant = self.forest(n)
        base, parts = constant, []
        simple = [t for t in trees if t.result != MASK and t.kind == "select" and t.args[1].kind == t.args[2].kind == "const"]
        steps, counted = self._steps(simple, offset=True) if sum(abs(U.signed(a.value)) for t in simple for a in t.args[1:]) < U.HALF else ([], simple)
        for column, least, most in steps:
            base += least
            parts.append(U.exact_sum(column, most))
        for t in trees:
            if t.result == MASK:
                parts.append(F.count_if(self.mask(t)).cast("decimal(38,0)") * U.signed(t.weight))
            elif any(t is x for x in counted):
                high, low = U.signed(t.args[1].value), U.signed(t.args[2].value)
                base += low
                parts.append(F.count_if(self.mask(t.args[0])).cast("decimal(38,0)") * (high - low))
            elif not any(t is x for x in simple):
                v = self.plane(t)
                parts.append(U.exact_sum(v.column, v.most if v.plain else U.WORD - 1))
        every = F.count(F.lit(1)).cast("decimal(38,0)") * base
        return U.mod_word(reduce(lambda a, b: (a + b).cast("decimal(38,0)"), [every, *parts]))

    # what a predicate says about stored columns

    def implied(self, n: Node) -> Column | None:
        """A condition on the columns that fields are made from, which holds wherever the mask ``n`` does; None if there is none."""
        if n.kind in ("and", "or"):
            a, b = (self.implied(x) for x in n.args)
            if n.kind == "or":
                return None if a is None or b is None else a | b
            return b if a is None else a if b is None else a & b
        if n.kind not in ("gt", "ge", "lt", "le", "eq"):
            return None
        x, y, kind = *n.args, n.kind
        if x.kind == "const":
            x, y, kind = y, x, {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge", "eq": "eq"}[kind]
        if x.kind != "load" or y.kind != "const" or not self.plane(x).plain or not 0 <= y.value < U.HALF:
            return None
        return self.schema.field(x.name).stored_where(kind, y.value)


def is_forest(n: Node) -> bool:
    return n.kind == "sum" or (n.kind == "add" and any(a.kind == "sum" for a in n.args))
