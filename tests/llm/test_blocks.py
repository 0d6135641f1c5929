"""Blocks of benchmark items are bounded whatever their ids and lengths."""

import brute

from karstflow.llm import decontaminate


def test_blocks_of_repeated_and_long_items(made, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 160)
    sizes, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (sizes.append(len(x[2]) // 8), broadcast(self, x))[1])
    long = " ".join(f"long{k}" for k in range(600))
    items = [(1, long), *[(2, " ".join(f"r{n}w{k}" for k in range(20))) for n in range(30)]]
    rows = [(1, long), (2, " ".join(f"long{k}" for k in range(5, 15))), (3, " ".join(f"long{k}" for k in range(5, 14))), (4, items[7][1]), (5, "no hit")]
    found = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(made(rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(found) == sorted(brute.contamination(rows, items))
    assert max(sizes) < 480 and sum(sizes) >= 1200
