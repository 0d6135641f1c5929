"""Closed forms of the quality measures."""

import pytest

from karstflow.operators import metrics


def _tables(spark, predicted, truth):
    c = spark.createDataFrame([(x, k) for k, s in enumerate(predicted) for x in s], "id long, comm long")
    t = spark.createDataFrame([(k, x) for k, s in enumerate(truth) for x in s], "comm_id long, node long")
    return c, t


@pytest.mark.parametrize(
    ("predicted", "truth", "exact", "inclusion", "purity", "nmi", "ari"),
    [
        ([{1, 2}, {3, 4}], [{1, 2}, {3, 4}], 100, 100, 1, 1, 1),
        ([{1, 2, 3, 4}], [{1, 2}, {3, 4}], 0, 100, 0.5, 0, 0),
        ([{1}, {2}, {3}, {4}], [{1, 2}, {3, 4}], 0, 0, 1, 2 / 3, 0),
        ([{1, 2}], [{1, 2, 9}], 0, 0, 2 / 3, 1, 1),
        ([{1, 2}, {3}], [], 0, 0, 0, 1, 1),
    ],
)
def test_measures(spark, predicted, truth, exact, inclusion, purity, nmi, ari):
    c, t = _tables(spark, predicted, truth)
    row = metrics.summary(c, t, spark.createDataFrame([(1, 3), (2, 4)], "id long, k long")).first()
    found = (row.exact_accuracy, row.inclusion_accuracy, row.purity, row.nmi, row.ari, row.avg_degree)
    assert found == pytest.approx((exact, inclusion, purity, nmi, ari, 3.5), abs=1e-9)
    assert row.n_communities == len(predicted)


def test_overlapping_truth_takes_the_last_label(spark):
    c, t = _tables(spark, [{1, 2}, {3}], [{1, 2}, {2, 3}])
    assert {(r.node, r.label) for r in metrics.labels(t).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {r.comm_id: (r.exact, r.included) for r in metrics.matches(c, t).collect()} == {0: (True, True), 1: (False, False)}


def test_average_degree_of_nothing(spark):
    assert metrics.average_degree(spark.createDataFrame([], "id long, k long")).first()[0] == 0.0
