"""The three interactions that move an edge's distance, over edges(eid, u, v, ku, kv, d) and wedges.

s = 1 - d; S(x) is the sum of s over x's edges; an edge is active if 0 < d < 1. All distances on the right-hand sides are
those before the step. Every function is one declarative plan; sums are grouped with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A theta this little below lam counts as lam: sums come in any order, and a true tie must not depend on it.
TIE = 1e-12


def active(d: str = "d") -> Column:
    return (F.col(d) > 0) & (F.col(d) < 1)


def weight_sums(edges: DataFrame, counted: Column | None = None) -> DataFrame:
    """id, s: the sum of 1 - d over a vertex's edges; with `counted`, of those edges only."""
    s = 1 - F.col("d") if counted is None else F.when(counted, 1 - F.col("d")).otherwise(0.0)
    return edges.select(F.explode(F.array("u", "v")).alias("id"), s.alias("x")).groupBy("id").agg(F.sum("x").alias("s"))


def direct(edges: DataFrame) -> DataFrame:
    """eid, x: -sin(s) (1/ku + 1/kv) of active edges."""
    return edges.where(active()).select("eid", (-F.sin(1 - F.col("d")) * (1 / F.col("ku") + 1 / F.col("kv"))).alias("x"))


def armed(wedges: DataFrame, edges: DataFrame) -> DataFrame:
    """wedges and the arms' d_ma and d_mb, the degrees k_mid, k_a, k_b, and act_ab (null if there is no such edge)."""
    arm = lambda e, end: edges.select(
        F.col("eid").alias(e), F.col("d").alias("d_" + e[2:]), F.struct("u", "ku", "kv").alias("_" + end)
    )
    k = lambda end, of: F.when(F.col(f"_{end}.u") == F.col(of), F.col(f"_{end}.ku")).otherwise(F.col(f"_{end}.kv"))
    third = edges.select(F.col("eid").alias("e_ab"), active().alias("act_ab"))
    rows = wedges.join(arm("e_ma", "x"), "e_ma").join(arm("e_mb", "y"), "e_mb").join(third, "e_ab", "left")
    return rows.select("mid", "a", "b", "e_ma", "e_mb", "e_ab", "d_ma", "d_mb", k("x", "mid").alias("k_mid"), k("x", "a").alias("k_a"), k("y", "b").alias("k_b"), "act_ab")


def common(arms: DataFrame) -> DataFrame:
    """eid, x: what the common neighbours add to active edges, one row for each triangle side."""
    sa, sb = 1 - F.col("d_ma"), 1 - F.col("d_mb")
    x = -(sb * F.sin(sa) / F.col("k_a") + sa * F.sin(sb) / F.col("k_b"))
    return arms.where("act_ab").select(F.col("e_ab").alias("eid"), x.alias("x"))


def similarities(arms: DataFrame, sums: DataFrame) -> DataFrame:
    """a, b, theta: of pairs that aren't neighbours but have common ones, of which an arm is active."""
    live = active("d_ma") | active("d_mb")
    pairs = arms.where("e_ab is null").groupBy("a", "b").agg(F.sum(2 - F.col("d_ma") - F.col("d_mb")).alias("n"), F.max(live).alias("live")).where("live")
    sa, sb = sums.select(F.col("id").alias("a"), F.col("s").alias("sa")), sums.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    total = F.col("sa") + F.col("sb")
    theta = F.when(total == 0, F.raise_error(F.lit("no weight on either end of a pair")).cast("double")).otherwise(F.col("n") / total)
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", theta.alias("theta"))


def influence(theta: Column, lam: float) -> Column:
    """theta if it is lam or more (but for TIE), otherwise theta - lam."""
    return F.when(theta >= lam - TIE, theta).otherwise(theta - lam)


def exclusive(arms: DataFrame, sums: DataFrame, lam: float) -> DataFrame:
    """eid, x: what the exclusive neighbours add to active edges, one row for each arm of an open wedge."""
    rho = similarities(arms, sums).select("a", "b", influence(F.col("theta"), lam).alias("rho"))
    rows = arms.where("e_ab is null").where(active("d_ma") | active("d_mb")).join(rho, ["a", "b"])
    part = lambda other: -F.col("rho") * F.sin(1 - F.col(other)) / F.col("k_mid")
    both = F.array(F.struct(F.col("e_mb").alias("eid"), part("d_ma").alias("x"), active("d_mb").alias("live")), F.struct(F.col("e_ma").alias("eid"), part("d_mb").alias("x"), active("d_ma").alias("live")))
    return rows.select(F.explode(both).alias("t")).where("t.live").select("t.eid", "t.x")


def summed(parts: DataFrame, name: str) -> DataFrame:
    return parts.groupBy("eid").agg(F.sum("x").alias(name))


def deltas(edges: DataFrame, wedges: DataFrame, lam: float, counted: Column | None = None) -> DataFrame:
    """eid, delta of active edges: direct + common + exclusive, in one grouped sum."""
    arms = armed(wedges, edges)
    return summed(direct(edges).union(common(arms)).union(exclusive(arms, weight_sums(edges, counted), lam)), "delta")
