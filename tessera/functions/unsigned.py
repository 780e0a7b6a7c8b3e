"""Unsigned 64-bit arithmetic on ``bigint`` columns that carry the raw bits.

Nothing here can overflow under ANSI mode: sums are built from halves, products
from 16-bit limbs, and shifts drop what leaves the word.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 64
HALF = 1 << 63
_LOW = 0xFFFFFFFF


def signed(value: int) -> int:
    """The signed number that has the bits of ``value`` mod 2^64."""
    value %= WORD
    return value - WORD if value >= HALF else value


def lit(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def wrap_add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(_LOW) + b.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def wrap_sub(a: Column, b: Column) -> Column:
    return F.bitwise_not(wrap_add(F.bitwise_not(a), b))


def bound(operation: Callable[..., Column], *operands: Column) -> Column:
    """``operation`` on operands that are computed once: it names each several times, and nested trees would grow with each level."""
    named = F.struct(*[x.alias(f"x{i}") for i, x in enumerate(operands)])
    return F.get(F.transform(F.array(named), lambda s: operation(*[s[f"x{i}"] for i in range(len(operands))])), 0)


def wrap_add_all(terms: list[Column]) -> Column:
    """The sum of many terms: halves are summed apart, so each term is named twice, however many there are."""
    low = balanced([t.bitwiseAND(_LOW) for t in terms])
    high = balanced([F.shiftrightunsigned(t, 32) for t in terms]) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def balanced(terms: list[Column]) -> Column:
    """A tree of sums of logarithmic depth."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def wrap_mul(a: Column, b: Column) -> Column:
    """Products of a 32-bit half and a 16-bit limb have 48 bits, so no sum of a few leaves the word."""
    a0, a1 = a.bitwiseAND(_LOW), F.shiftrightunsigned(a, 32)
    limb = [F.shiftrightunsigned(b, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    p, q = a0 * limb[0], a0 * limb[1]
    low = p + F.shiftleft(q.bitwiseAND(_LOW), 16)
    crossed = a1 * limb[0] + a0 * limb[2] + F.shiftleft((a1 * limb[1] + a0 * limb[3]).bitwiseAND(0xFFFF), 16)
    high = F.shiftrightunsigned(low, 32) + F.shiftleft(F.shiftrightunsigned(q, 32), 16) + crossed
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n) if n < 64 else lit(0)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(a, n) if n < 64 else lit(0)


def greater(a: Column, b: Column) -> Column:
    """Unsigned a > b of two columns: order is that of the signed numbers with the top bit turned."""
    return a.bitwiseXOR(lit(HALF)) > b.bitwiseXOR(lit(HALF))


def greater_than_constant(a: Column, c: int, inclusive: bool) -> Column:
    """Unsigned a > c or a >= c as plain comparisons, which reach a Parquet scan."""
    s = signed(c)
    over = a >= s if inclusive else a > s
    return over | (a < 0) if s >= 0 else over & (a < 0)


def less_than_constant(a: Column, c: int, inclusive: bool) -> Column:
    s = signed(c)
    under = a <= s if inclusive else a < s
    return under & (a >= 0) if s >= 0 else under | (a >= 0)


#: 2^64 as a decimal literal
WORD_TEXT = Decimal(WORD)


def mod_word(x: Column) -> Column:
    """``x`` mod 2^64 as decimal(20,0)."""
    return F.pmod(x.cast("decimal(38,0)"), F.lit(WORD_TEXT).cast("decimal(38,0)")).cast("decimal(20,0)")


_LIMB = 22  # a sum of 2^41 limbs fits a long


def exact_sum(x: Column, most: int = WORD - 1) -> Column:
    """The sum of unsigned numbers of at most ``most`` as decimal(38,0), exact for up to 2^41 rows; 0 for no rows.

    Limbs are summed as longs, which is faster than decimals and cannot overflow as early.
    """
    limbs = range(0, max(1, most.bit_length()), _LIMB)
    one = len(limbs) == 1
    sums = [F.coalesce(F.sum(x if one else F.shiftrightunsigned(x, at).bitwiseAND((1 << _LIMB) - 1)), F.lit(0)).cast("decimal(38,0)") for at in limbs]
    out = sums[0]
    for at, part in zip(list(limbs)[1:], sums[1:], strict=True):
        out = (out + (part * F.lit(Decimal(1 << at)).cast("decimal(14,0)")).cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def sum_wrapped(x: Column, most: int = WORD - 1) -> Column:
    """Sum mod 2^64 as decimal(20,0); 0 for no rows."""
    return mod_word(exact_sum(x, most))
