"""How a step's delta changes an edge: the distributed and the single-machine rule, each one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.functions.windows import check_window, forced, positive, set_bit
from karstflow.operators.interactions import active

#: Below this a delta doesn't move an edge of the single-machine rule, and distances that near to 0 or 1 snap to them.
PRECISION = 1e-7
#: The single-machine rule's support: negative, so that a full ring always forces.
SINGLE_SUPPORT = -0.7


def step_distributed(edges: DataFrame, deltas: DataFrame, step: int, window: int, tau: float, rule: str = "compat") -> DataFrame:
    """edges with d and ring (`win`) after step number `step`: d + delta clamped to [0, 1].

    window <= 0 turns the ring off. The ring of an edge that isn't active is reset; at step 0 it starts from zeros.
    """
    check_window(window)
    rows = edges.join(deltas, "eid", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    zero = F.lit(0).cast("long")
    ring, delta = zero, F.col("delta")
    if window > 0:
        bit = positive(delta)
        ring = F.when(active(), set_bit(F.col("win") if step > 0 else zero, F.lit(step % window), bit)).otherwise(zero)
        delta = F.when(active(), forced(delta, ring, bit, F.lit(step), window, F.lit(tau * window), rule)).otherwise(delta)
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d") + delta))
    return rows.select(*[{"d": new, "win": ring}.get(c, F.col(c)).alias(c) for c in edges.columns])


def handed_over(edges: DataFrame, step: int) -> DataFrame:
    """edges of the distributed rule as the single-machine rule starts with them at step number `step`.

    Adds d_prev (0), in_s (true) and cnt (the step). At step 0 the ring is dropped.
    """
    ring = F.col("win") if step > 0 else F.lit(0).cast("long")
    return edges.withColumns({"win": ring, "d_prev": F.lit(0.0), "in_s": F.lit(True), "cnt": F.lit(step).cast("long"), "moved": F.lit(True)})


def step_single(edges: DataFrame, deltas: DataFrame, window: int, support: float = SINGLE_SUPPORT, rule: str = "compat") -> DataFrame:
    """edges after a step of the single-machine rule.

    An active edge with |delta| > PRECISION gets its ring advanced and its distance moved and snapped (`moved`). An
    active one with a smaller delta takes the distance it had two steps ago and stays out of the next step's weight
    sums (`in_s` false). Others keep their distance.
    """
    check_window(window)
    rows = edges.join(deltas, "eid", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    moves = active() & (F.abs("delta") > PRECISION)
    delta, ring, cnt = F.col("delta"), F.col("win"), F.col("cnt")
    if window > 0:
        bit = positive(delta)
        ring = set_bit(F.col("win"), F.pmod(F.col("cnt"), F.lit(window)), bit)
        delta = forced(delta, ring, bit, F.col("cnt"), window, F.lit(support * window), rule)
        ring, cnt = F.when(moves, ring).otherwise(F.col("win")), F.when(moves, F.col("cnt") + 1).otherwise(F.col("cnt"))
    new = F.col("d") + delta
    new = F.when(new > 1 - PRECISION, 1.0).when(new < PRECISION, 0.0).otherwise(new)
    changed = {
        "d": F.when(moves, new).when(active(), F.col("d_prev")).otherwise(F.col("d")),
        "d_prev": F.col("d"),
        "in_s": ~active() | moves,
        "moved": moves,
        "win": ring,
        "cnt": cnt,
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in edges.columns])
