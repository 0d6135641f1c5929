"""Column expressions for the ring of sign bits that each edge carries, as a BIGINT mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A ring must fit the sign-free bits of a BIGINT.
LONGEST = 63


def check_window(size: int) -> None:
    if size > LONGEST:
        raise ValueError(f"window_size must be at most {LONGEST}")


def set_bit(ring: Column, place: Column, bit: Column) -> Column:
    """ring with the bit at `place` (0-based) set to `bit` (0 or 1)."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
    return ring.bitwiseAND(F.bitwise_not(one)).bitwiseOR(F.when(bit == 1, one).otherwise(F.lit(0).cast("long")))


def positive(delta: Column) -> Column:
    """The sign bit: a delta of 0 counts as positive."""
    return (delta >= 0).cast("int")


def forced(delta: Column, ring: Column, bit: Column, step: Column, size: int, support: Column, rule: str = "compat") -> Column:
    """delta, or +2 / -2 once the ring is full and enough bits agree with the current one.

    rule "compat": a negative current bit also counts the *positive* bits of the ring; "symmetric": it counts the
    negative ones.
    """
    ones = F.bit_count(ring)
    negative = ones if rule == "compat" else F.lit(size) - ones
    full = step >= size - 1
    return (
        F.when(full & (bit == 1) & (ones > support), F.lit(2.0)).when(full & (bit == 0) & (negative > support), F.lit(-2.0)).otherwise(delta)
    )


def to_text(ring: Column, size: int) -> Column:
    """The ring as a string of 0 and 1, place 0 first."""
    return F.reverse(F.lpad(F.bin(ring), size, "0"))


def from_text(text: Column) -> Column:
    return F.conv(F.reverse(text), 2, 10).cast("long")
