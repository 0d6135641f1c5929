"""Community detection end to end: ingest, initial distances, iteration, components.

Two engines run the same steps. "plan": each step is one DataFrame plan over stored edges and wedges, written to the
shared folder; nothing but counts comes to the driver. "task": the graph's state lives in numpy arrays of one task, for
graphs whose edges and wedges, counted beforehand, are under TASK_EDGES and TASK_WEDGES. "auto" takes the task for those
and the plan for all others.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.functions.shared import stored
from karstflow.operators import graph, interactions, update
from karstflow.plans import kernel

#: The largest graph that one task holds, in about 1 GB: 500,000 edges with 4 million wedges were measured to take 450 MB.
TASK_EDGES, TASK_WEDGES = 1_000_000, 8_000_000


@dataclass
class Parameters:
    """lam: cohesion threshold. window: length of the ring of signs, <= 0 for none. tau: support of the distributed rule.
    gamma: the single-machine rule takes over when fewer edges are active. mode: "distributed" or "single".
    partitions: the class modulus, checked only (3 at least in distributed mode). rule: "compat" or "symmetric" ring.
    support: of the single-machine rule. max_iter: steps of either rule at most (None: no bound).
    """

    lam: float = 0.5
    window: int = 15
    tau: float = 0.7
    gamma: int = 0
    mode: str = "distributed"
    partitions: int = 8
    rule: str = "compat"
    support: float = update.SINGLE_SUPPORT
    max_iter: int | None = None
    engine: str = "auto"

    def __post_init__(self):
        if self.mode not in ("distributed", "single"):
            raise ValueError("mode is 'distributed' or 'single'")
        if self.engine not in ("auto", "plan", "task"):
            raise ValueError("engine is 'auto', 'plan' or 'task'")
        if self.rule not in ("compat", "symmetric"):
            raise ValueError("rule is 'compat' or 'symmetric'")
        if self.mode == "distributed" and self.partitions < 3:
            raise ValueError("partitions must be at least 3 in distributed mode")


@dataclass
class Result:
    """communities (id, comm), distances (u, v, d), degree (id, k), iterations (phase, step, active, total, seconds, ts), run
    (engine; time stamps: start, end, part_ts, when the first step began, and the ends of the steps of the distributed rule,
    update_ts, and of the single-machine rule, sm_ts)."""

    communities: DataFrame
    distances: DataFrame
    degree: DataFrame
    iterations: list[dict] = field(default_factory=list)
    run: dict = field(default_factory=dict)


def _prepared(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = graph.identified(graph.canonical(pairs, a, b))
    return edges, stored(graph.degrees(edges), "degrees"), graph.vertices(pairs, a, b)


def _wedge_count(degree: DataFrame) -> int:
    return degree.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0))).first()[0]


def detect(pairs: DataFrame, parameters: Parameters | None = None, a: str = "src", b: str = "dst") -> Result:
    """Runs the whole method on the pairs of a table. Loops and repeated or reversed pairs don't matter."""
    p = parameters or Parameters()
    began = time.time()
    edges, degree, ids = _prepared(pairs, a, b)
    engine = p.engine
    if engine == "auto":
        engine = "task" if edges.count() <= TASK_EDGES and _wedge_count(degree) <= TASK_WEDGES else "plan"
    log: list[dict] = []
    if engine == "task":
        alone = pairs.where(F.col(a) == F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
        rows = stored(kernel.settled(edges.select("u", "v").union(alone), p), "settled")
        log = [r["log"].asDict() for r in rows.where("log is not null").select("log").orderBy("log.n").collect()]
        distances = rows.where("d is not null")
        communities = rows.where("d is null and log is null").select(F.col("u").alias("id"), F.col("v").alias("comm"))
    else:
        distances = _iterated(edges, degree, p, log)
        found = graph.components(distances.where("d < 1").select("u", "v"), ids)
        communities = stored(graph.numbered_components(found), "communities")
    distances = distances.select("u", "v", "d")
    ends = {phase: [x["ts"] for x in log if x["phase"] == phase] for phase in ("distributed", "single")}
    first = log[0]["ts"] - log[0]["seconds"] if log else None
    return Result(communities, distances, degree, log, {"engine": engine, "start": began, "end": time.time(), "part_ts": first, "update_ts": ends["distributed"], "sm_ts": ends["single"]})


def _iterated(edges: DataFrame, degree: DataFrame, p: Parameters, log: list[dict]) -> DataFrame:
    """u, v, d once no edge is active (or max_iter steps were made): the driver's loop over step plans."""
    wedges = stored(graph.wedges(edges), "wedges")
    first = graph.with_degrees(graph.jaccard(edges), degree).withColumn("win", F.lit(0).cast("long"))
    state = stored(first.select("eid", "u", "v", "ku", "kv", "d", "win"), "state")
    total, step, live = state.count(), 0, None

    def noted(phase: str, n: int, count: int, since: float) -> None:
        log.append({"n": len(log), "phase": phase, "step": n, "active": count, "total": total, "seconds": time.time() - since, "ts": time.time()})

    while p.mode == "distributed" and (p.max_iter is None or step < p.max_iter):
        since = time.time()
        state = stored(update.step_distributed(state, interactions.deltas(state, wedges, p.lam), step, p.window, p.tau, p.rule), "state")
        live = state.where(interactions.active()).count()
        noted("distributed", step, live, since)
        if live == 0 or live < p.gamma:
            break
        step += 1
        wedges = _pruned(wedges, state, live, log)
    if p.mode == "single" or (live is not None and live < p.gamma):
        state = stored(update.handed_over(state, step), "state")
        n = 0
        while p.max_iter is None or n < p.max_iter:
            since = time.time()
            moved = interactions.deltas(state, wedges, p.lam, F.col("in_s"))
            state = stored(update.step_single(state, moved, p.window, p.support, p.rule), "state")
            some = state.where("moved").count()
            noted("single", n, some, since)
            n += 1
            if some == 0:
                break
    return state.select("u", "v", "d")


def _pruned(wedges: DataFrame, state: DataFrame, live: int, log: list[dict]) -> DataFrame:
    """wedges without those that can't count any more, each time the active edges have halved: a triangle side counts
    while its third edge is active, an open wedge while any wedge of its pair has an active arm."""
    last = next((x["active"] for x in reversed(log) if x.get("pruned")), log[0]["total"])
    if 2 * live > last:
        return wedges
    log[-1]["pruned"] = True
    on = state.where(interactions.active()).select("eid")
    sides = wedges.where("e_ab is not null").join(on.withColumnRenamed("eid", "e_ab"), "e_ab", "left_semi")
    open_ = wedges.where("e_ab is null")
    pairs = open_.join(on.withColumnRenamed("eid", "e_ma"), "e_ma", "left_semi").select("a", "b").union(open_.join(on.withColumnRenamed("eid", "e_mb"), "e_mb", "left_semi").select("a", "b")).distinct()
    return stored(sides.select(*wedges.columns).union(open_.join(pairs, ["a", "b"], "left_semi").select(*wedges.columns)), "wedges")
