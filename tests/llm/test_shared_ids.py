"""Rows that share an id, or have none, are documents of their own."""

import brute

from karstflow.llm import decontaminate, near_dup

LEAK = "the quick brown fox jumps over the lazy dog and runs to the river"
CLEAN = "nothing of the benchmark is in this document however long one looks at it"


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _sorted(rows):
    return sorted(rows, key=repr)


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, made):
    items = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    rows = [(None, "so " + LEAK), (None, CLEAN), (None, None), (3, LEAK.upper()), (3, CLEAN), (3, CLEAN), (4, LEAK), (4, LEAK), (5, CLEAN)]
    want = [(i, t) for (i, t), x in zip(rows, brute.contamination(rows, [(1, LEAK)]), strict=True) if not x[2]]
    assert len(want) == 5
    assert _sorted(_pairs(decontaminate.keep_clean(made(rows).repartition(3), items))) == _sorted(want)


def test_one_row_of_each_group_stays_whatever_its_id(made):
    """Two texts that each resemble a row without an id aren't linked by that, and of exact copies one stays."""
    text = lambda name, *new: " ".join([*[f"{name}{k}" for k in range(60)], *new])
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, ""), (None, ""), (1, text("a", "x")), (2, text("b", "x")), (5, text("c")), (5, text("c").upper()), (5, text("d")), (5, text("d")), (6, text("e")), (7, text("f"))]
    docs = made(rows).repartition(3)
    kept = [(i, (t or "").lower()) for i, t in _pairs(near_dup.keep_one(docs))]
    assert _sorted(kept) == _sorted([(None, text("a")), (None, text("b")), (None, ""), (None, ""), (5, text("c")), (5, text("d")), (6, text("e")), (7, text("f"))])
    found = near_dup.near_duplicates(made([(None, text("g")), (3, text("a")), (3, text("b")), (1, text("a", "x")), (2, text("b", "x"))])).collect()
    assert _sorted((r.doc_id, r.component_id) for r in found) == _sorted([(None, None), (1, 1), (2, 2), (3, 1), (3, 2)])
