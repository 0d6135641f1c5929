"""Fixture values, both engines against plain Python, and properties of the whole method."""

import math

import bench
import pytest
from pyspark.sql import functions as F
from reference_run import Plain

from karstflow.functions.shared import stored
from karstflow.operators import graph, interactions, update
from karstflow.plans import kernel, queries
from karstflow.plans.communities import Parameters, detect

#: The 16-edge sample graph.
SAMPLE = [(1, 5), (5, 9), (1, 9), (3, 7), (7, 11), (4, 8), (4, 12), (8, 12), (2, 6), (2, 10), (4, 9), (9, 12), (7, 9), (7, 10), (7, 12), (10, 12)]
#: Fixed values of its first step: distance, DI, CI, EI, delta, distance after.
FIRST = {
    (5, 1): (0, 0, 0, 0, 0, 0),
    (6, 2): (0.333333, -0.927555, 0, -0.107958, -1.035512, 0),
    (7, 3): (0.666667, -0.392634, 0, -0.027129, -0.419763, 0.246904),
    (8, 4): (0.25, -0.568032, -0.262870, -0.085932, -0.916834, 0),
    (9, 1): (0.5, -0.335598, -0.306253, 0.059829, -0.582022, 0),
    (9, 4): (0.571429, -0.221638, -0.166985, -0.131737, -0.520361, 0.051068),
    (9, 7): (0.666667, -0.130878, -0.095885, 0.040249, -0.186514, 0.480153),
    (10, 2): (0.6, -0.324515, 0, -0.102569, -0.427084, 0.172916),
    (12, 9): (0.5, -0.191770, -0.173094, -0.008793, -0.373657, 0.126343),
    (12, 10): (0.571429, -0.221638, -0.110356, 0.068019, -0.263975, 0.307454),
}


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def _state(spark, pairs):
    edges = graph.identified(graph.canonical(_pairs(spark, pairs)))
    return stored(graph.with_degrees(graph.jaccard(edges), graph.degrees(edges)).withColumn("win", F.lit(0).cast("long")), "state")


def test_first_step_of_the_sample(spark):
    state = _state(spark, SAMPLE)
    wedges = graph.wedges(state.select("eid", "u", "v"))
    assert wedges.count() == 40
    arms, sums = interactions.armed(wedges, state), interactions.weight_sums(state)
    parts = [interactions.summed(x, "x") for x in (interactions.direct(state), interactions.common(arms), interactions.exclusive(arms, sums, 0.5))]
    delta = interactions.deltas(state, wedges, 0.5)
    after = update.step_distributed(state, delta, 0, 15, 0.7).select("eid", F.col("d").alias("after"))
    rows = state
    for k, p in enumerate(parts):
        rows = rows.join(p.withColumnRenamed("x", f"p{k}"), "eid", "left")
    rows = rows.join(delta, "eid", "left").join(after, "eid").na.fill(0.0)
    found = {(r.u, r.v): (r.d, r.p0, r.p1, r.p2, r.delta, r.after) for r in rows.collect()}
    for e, values in FIRST.items():
        assert found[e] == pytest.approx(values, abs=1e-6), e
    # these totals are sums of values rounded to six digits
    assert sum(x[0] for x in found.values()) == pytest.approx(7.730954, abs=1e-5)
    assert [sum(x[k] for x in found.values()) for k in (1, 2, 3, 4)] == pytest.approx([-5.121294, -2.283817, -0.315244, -7.720355], abs=1e-5)


def _copart(spark, sf):
    return [(r.src, r.dst) for r in bench.returned(spark, sf).collect()]


CASES = [
    dict(lam=0.5, window=15, tau=0.7, gamma=0, mode="distributed"),
    dict(lam=0.5, window=4, tau=0.5, gamma=40, mode="distributed"),
    dict(lam=0.3, window=15, tau=0.7, gamma=10**9, mode="distributed"),
    dict(lam=0.6, window=5, tau=0.7, gamma=0, mode="single"),
    dict(lam=0.5, window=0, tau=0.7, gamma=0, mode="single"),
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_task_engine_is_the_plain_method(spark, sf, case):
    for pairs in (SAMPLE, _copart(spark, sf)):
        plain = Plain(pairs)
        want = plain.run(case["lam"], case["window"], case["tau"], case["gamma"], case["mode"] == "single")
        edges = graph.canonical(_pairs(spark, pairs))
        rows = kernel.settled(edges, Parameters(**case, max_iter=200)).where("log is null").collect()
        assert {(r.u, r.v): r.d for r in rows if r.d is not None} == pytest.approx(want, abs=1e-9)
        number = plain.communities(want)
        near = {x for e in plain.edges for x in e}
        kept = {c: k + 1 for k, c in enumerate(sorted({number[x] for x in near}))}
        assert {r.u: r.v for r in rows if r.d is None} == {x: kept[number[x]] for x in near}


@pytest.mark.parametrize("case", CASES[1:4], ids=str)
def test_plan_engine_is_the_plain_method(spark, case):
    plain = Plain(SAMPLE)
    want = plain.run(case["lam"], case["window"], case["tau"], case["gamma"], case["mode"] == "single")
    found = detect(_pairs(spark, SAMPLE), Parameters(**case, max_iter=200, engine="plan"))
    assert {(r.u, r.v): r.d for r in found.distances.collect()} == pytest.approx(want, abs=1e-9)
    assert {r.id: r.comm for r in found.communities.collect()} == plain.communities(want)
    assert found.run["engine"] == "plan" and found.iterations


def test_engines_agree_on_tables(spark, sf):
    out = [detect(queries.pairs(spark, sf), Parameters(max_iter=6, gamma=5, window=3, tau=0.5, engine=e)) for e in ("plan", "task")]
    a, b = ({(r.u, r.v): r.d for r in x.distances.collect()} for x in out)
    assert a == pytest.approx(b, abs=1e-9)
    assert [(x["phase"], x["step"], x["active"]) for x in out[0].iterations] == [(x["phase"], x["step"], x["active"]) for x in out[1].iterations]


def test_copies_loops_and_numbering_do_not_matter(spark):
    p = Parameters(max_iter=100)
    one = {r.id: r.comm for r in detect(_pairs(spark, SAMPLE), p).communities.collect()}
    twice = [(b, a) for a, b in SAMPLE] + SAMPLE + [(3, 3), (99, 99)]
    two = {r.id: r.comm for r in detect(_pairs(spark, twice), p).communities.collect()}
    assert two.pop(99) == max(one.values()) + 1 and one == two
    moved = {r.id: r.comm for r in detect(_pairs(spark, [(100 - a, 100 - b) for a, b in SAMPLE]), p).communities.collect()}
    assert len(set(moved.values())) == len(set(one.values()))
    assert all((one[a] == one[b]) == (moved[100 - a] == moved[100 - b]) for a in one for b in one)


def test_hubs_are_paired_in_blocks(spark, monkeypatch):
    pairs = [(1000, k) for k in range(60)] + [(k, k + 1) for k in range(0, 58, 3)] + [(2000, k) for k in range(20, 45)]
    edges = graph.identified(graph.canonical(_pairs(spark, pairs)))
    rows = lambda: sorted((r.mid, r.a, r.b, r.e_ma, r.e_mb, r.e_ab) for r in graph.wedges(edges).collect())
    want = rows()
    monkeypatch.setattr(graph, "BLOCK", 7)
    assert rows() == want and len(want) == sum(r.k * (r.k - 1) // 2 for r in graph.degrees(edges).collect())


def test_empty_graph(spark):
    for engine in ("plan", "task"):
        found = detect(_pairs(spark, []), Parameters(engine=engine, max_iter=3))
        assert found.communities.count() == 0 and found.distances.count() == 0


def test_parameters_are_checked():
    for bad in (dict(partitions=2), dict(mode="x"), dict(engine="x"), dict(rule="x")):
        with pytest.raises(ValueError):
            Parameters(**bad)
    Parameters(partitions=2, mode="single")
    with pytest.raises(ValueError):
        update.check_window(64)


def test_distances_stay_between_0_and_1(spark, sf):
    d = [r.d for r in detect(queries.pairs(spark, sf), Parameters(max_iter=50)).distances.collect()]
    assert all(0 <= x <= 1 and not math.isnan(x) for x in d)


def test_components_chain_and_hub(spark):
    rows = [(k, k + 1) for k in range(1, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(found[k] == 1 for k in range(1, 301)) and all(found[k] == 1000 for k in range(1000, 1400)) and 5000 not in found
