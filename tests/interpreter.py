"""Expressions over NumPy uint64, which wraps and compares unsigned by itself: an oracle for the lowering."""

import numpy as np

W = np.uint64


def plane(n, rows):
    k = n.kind
    if k == "load":
        return rows[n.name]
    size = len(next(iter(rows.values())))
    if k == "const":
        return np.full(size, n.value % (1 << 64), W)
    if k == "inference_count":
        return mask(n.args[0], rows).astype(W)
    if k == "select":
        return np.where(mask(n.args[0], rows), plane(n.args[1], rows), plane(n.args[2], rows))
    if k == "popcnt" and n.args[0].result == "mask":
        return mask(n.args[0], rows).astype(W)
    a = plane(n.args[0], rows)
    if k == "popcnt":
        return np.bitwise_count(a).astype(W)
    if k in ("lsl", "lsr"):
        if n.value >= 64:
            return np.zeros(size, W)
        return a << W(n.value) if k == "lsl" else a >> W(n.value)
    b = plane(n.args[1], rows)
    return {"add": a + b, "sub": a - b, "mul": a * b}[k]


def mask(n, rows):
    k = n.kind
    if k == "not":
        return ~mask(n.args[0], rows)
    if k in ("and", "or"):
        a, b = (mask(x, rows) for x in n.args)
        return a & b if k == "and" else a | b
    a, b = (plane(x, rows) for x in n.args)
    return {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b, "eq": a == b}[k]


def row_sum(n, rows):
    trees, constant = (n.args, 0) if n.kind == "sum" else (n.args[0].args, n.args[1].value)
    size = len(next(iter(rows.values())))
    total = np.full(size, constant % (1 << 64), W)
    for t in trees:
        total += np.where(mask(t, rows), W(t.weight % (1 << 64)), W(0)) if t.result == "mask" else plane(t, rows)
    return total


def total(n, rows):
    if n.result == "mask":
        return int(mask(n, rows).sum())
    values = row_sum(n, rows) if n.kind == "sum" or (n.args and n.args[0].kind == "sum") else plane(n, rows)
    return int(sum(map(int, values))) % (1 << 64)
