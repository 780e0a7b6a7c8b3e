"""Expressions: immutable nodes, their builders, type checks and JSON form.

A node is a MASK (a boolean for each row) or a PLANE (an unsigned 64-bit number
for each row).  Builders check their operands, so an ill-typed tree cannot be built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

MASK, PLANE = "mask", "plane"

#: name of each kind: the types of its operands and of its result
KINDS: dict[str, tuple[tuple[str, ...], str]] = {
    "load": ((), PLANE), "const": ((), PLANE),
    "add": ((PLANE, PLANE), PLANE), "sub": ((PLANE, PLANE), PLANE), "mul": ((PLANE, PLANE), PLANE),
    "gt": ((PLANE, PLANE), MASK), "lt": ((PLANE, PLANE), MASK), "ge": ((PLANE, PLANE), MASK), "le": ((PLANE, PLANE), MASK), "eq": ((PLANE, PLANE), MASK),
    "and": ((MASK, MASK), MASK), "or": ((MASK, MASK), MASK), "not": ((MASK,), MASK),
    "select": ((MASK, PLANE, PLANE), PLANE),
    "popcnt": ((PLANE,), PLANE), "lsl": ((PLANE,), PLANE), "lsr": ((PLANE,), PLANE),
    "inference_count": ((MASK,), PLANE),
}


class ExpressionError(TypeError):
    """An expression that has no meaning."""


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple[Node, ...] = ()
    value: int | None = None
    name: str | None = None
    weight: int = 0

    @property
    def result(self) -> str:
        return PLANE if self.kind == "sum" else KINDS[self.kind][1]

    def fields(self) -> set[str]:
        own = {self.name} if self.kind == "load" else set()
        return own.union(*(a.fields() for a in self.args))

    def to_json(self) -> str:
        return json.dumps(_plain(self))


def _plain(n: Node) -> dict:
    out: dict = {"kind": n.kind}
    if n.args:
        out["args"] = [_plain(a) for a in n.args]
    return out | {k: v for k in ("value", "name") if (v := getattr(n, k)) is not None} | ({"weight": n.weight} if n.weight else {})


def from_json(text: str) -> Node:
    def build(x: dict) -> Node:
        args = tuple(build(a) for a in x.get("args", ()))
        node = sum_(*args) if x["kind"] == "sum" else _node(x["kind"], *args, value=x.get("value"), name=x.get("name"))
        return replace(node, weight=x.get("weight", 0))

    return build(json.loads(text))


def _node(kind: str, *args: Node, value: int | None = None, name: str | None = None) -> Node:
    if kind not in KINDS:
        raise ExpressionError(f"no such operator: {kind}")
    wanted = KINDS[kind][0]
    if kind == "popcnt" and len(args) == 1 and isinstance(args[0], Node) and args[0].result == MASK:
        wanted = (MASK,)  # the votes of a mask
    if len(args) != len(wanted) or any(not isinstance(a, Node) or a.result != t for a, t in zip(args, wanted, strict=True)):
        raise ExpressionError(f"{kind} takes {wanted}, not {tuple(getattr(a, 'result', type(a).__name__) for a in args)}")
    if any(a.kind == "sum" for a in args) and kind != "add":
        raise ExpressionError("a sum over trees can only take a constant")
    if kind in ("lsl", "lsr") and (value is None or value < 0):
        raise ExpressionError(f"{kind} takes a shift of 0 or more")
    return Node(kind, args, value, name)


def load(name: str) -> Node:
    if not name:
        raise ExpressionError("a field needs a name")
    return _node("load", name=name)


def const(value: int) -> Node:
    if not -(1 << 63) <= value < 1 << 64:
        raise ExpressionError(f"{value} has no 64-bit form")
    return _node("const", value=value)


def add(a: Node, b: Node) -> Node: return _node("add", a, b)  # noqa: E704
def sub(a: Node, b: Node) -> Node: return _node("sub", a, b)  # noqa: E704
def mul(a: Node, b: Node) -> Node: return _node("mul", a, b)  # noqa: E704
def gt(a: Node, b: Node) -> Node: return _node("gt", a, b)  # noqa: E704
def lt(a: Node, b: Node) -> Node: return _node("lt", a, b)  # noqa: E704
def ge(a: Node, b: Node) -> Node: return _node("ge", a, b)  # noqa: E704
def le(a: Node, b: Node) -> Node: return _node("le", a, b)  # noqa: E704
def eq(a: Node, b: Node) -> Node: return _node("eq", a, b)  # noqa: E704
def and_(a: Node, b: Node) -> Node: return _node("and", a, b)  # noqa: E704
def or_(a: Node, b: Node) -> Node: return _node("or", a, b)  # noqa: E704
def not_(m: Node) -> Node: return _node("not", m)  # noqa: E704
def select(m: Node, a: Node, b: Node) -> Node: return _node("select", m, a, b)  # noqa: E704
def popcnt(a: Node) -> Node: return _node("popcnt", a)  # noqa: E704
def lsl(a: Node, n: int) -> Node: return _node("lsl", a, value=n)  # noqa: E704
def lsr(a: Node, n: int) -> Node: return _node("lsr", a, value=n)  # noqa: E704
def inference_count(m: Node) -> Node: return _node("inference_count", m)  # noqa: E704


def sum_(*terms: Node) -> Node:
    """A sum over trees: planes count by their value, masks by their weight."""
    if not terms or any(not isinstance(t, Node) or t.kind == "sum" for t in terms):
        raise ExpressionError("sum takes one tree or more")
    return Node("sum", tuple(terms))


def set_weight(node: Node, weight: int) -> Node:
    return replace(node, weight=weight)


def conjunction(*masks: Node) -> Node:
    out = masks[0]
    for m in masks[1:]:
        out = and_(out, m)
    return out


def sum_of_two_exceeds(a: str, b: str, c: str) -> Node:
    """(a + b) > c"""
    return gt(add(load(a), load(b)), load(c))


def exceeds(field: str, threshold: int) -> Node:
    return gt(load(field), const(threshold))
