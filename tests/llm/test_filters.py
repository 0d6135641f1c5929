"""Quality rules, line dedup, suffix dedup, near duplicates, decontamination, sharding: odd inputs against brute force."""

from collections import Counter

import brute
import compare
import numpy as np
import pytest


from karstflow.llm import common, decontaminate, line_dedup, near_dup, queries, quality_rules, sharding, suffix_dedup



def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def con(sf):
    return compare.connection(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, con, sf, name):
    assert compare.from_spark(queries.QUERIES[name](spark, sf)) == compare.from_duckdb(con, queries.ORACLES[name])


def test_quality_on_odd_texts(odd, nothing):
    found = [tuple(r)[:6] for r in quality_rules.quality(odd).collect()]
    assert _sorted(found) == _sorted((i, *brute.base_counts(t)) for i, t in _pairs(odd))
    rows = quality_rules.quality(odd).collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert all(not r.kept for r in rows if r.base_failed)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert quality_rules.quality(nothing).count() == 0


def test_measures_are_computed_once(odd):
    """However many rules name them, in the query and in the stage."""
    for df in (quality_rules.quality(odd), quality_rules.keep_good(odd)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 2 and plan.count("array_distinct(") <= 2


def test_quality_keeps_clean_and_rejects_junk(made):
    clean = "The river runs to the sea and it is wide. We go there with the children for the summer, as the days are long."
    junk = ["WORD!! " * 3 + " ".join(f"NOISE{k}!!" for k in range(60)), " ".join(f"w{k}###" for k in range(60)), " ".join(f"qzx{k}" for k in range(60))]
    found = {r.doc_id: r.kept for r in quality_rules.quality(made([(0, clean), *enumerate(junk, 1)])).collect()}
    assert found == {0: True, 1: False, 2: False, 3: False}


@pytest.mark.parametrize(("keep", "choose"), [("last", max), ("first", min)])
def test_lines_of_odd_texts(odd, nothing, keep, choose):
    done = line_dedup.dedup_lines(odd, keep=keep, bits=1 << 21)
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in done.collect()]
    assert _sorted(found) == _sorted(brute.line_dedup(_pairs(odd), keep=choose))
    assert sum(x[2] for x in found) > 0
    assert done.columns == [*[c for c in odd.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert {r.source for r in done.collect()} == {"s"}
    assert line_dedup.dedup_lines(nothing, bits=1 << 21).count() == 0


def test_lines_with_filters_too_small(spark, sf):
    """Full filters only send more to the exact count."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.union(docs.selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars")).union(docs.selectExpr("doc_id + 2000", "text", "lang", "source", "n_chars")).repartition(7)
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(rows, min_chars=1, bits=1 << 21).collect()]
    assert _sorted(found) == _sorted(brute.line_dedup(_pairs(rows), min_chars=1))


@pytest.mark.parametrize("size", [64, 100, 400])
def test_substrings_of_odd_texts(odd, nothing, size):
    found = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup_substrings(odd, size).collect()]
    want = brute.substrings([(i, t if i not in (13, 14) else None) for i, t in _pairs(odd)], size)
    assert _sorted(x for x in found if x[0] not in (13, 14)) == _sorted(x for x in want if x[0] not in (13, 14))
    long = {x[0]: x for x in found if x[0] in (13, 14)}
    assert long[13][2] == long[13][1] and long[14][1] - long[14][2] == 3
    assert suffix_dedup.dedup_substrings(nothing, size).count() == 0


def _mixed(seed, n, pieces=6):
    """Texts glued from few pieces, cut anywhere, with single changed characters: overlapping and shifted repeats."""
    draw = np.random.default_rng(seed)
    parts = ["".join(draw.choice(list("abcdé \n"), int(draw.integers(20, 300)))) for _ in range(pieces)]
    out = []
    for i in range(n):
        t = "".join(parts[int(draw.integers(pieces))][int(draw.integers(15)) :] for _ in range(int(draw.integers(1, 9))))
        if draw.random() < 0.5 and t:
            k = int(draw.integers(len(t)))
            t = t[:k] + "#" + t[k + 1 :]
        out.append((i, t))
    return out


@pytest.mark.parametrize(("seed", "shard"), [(1, None), (2, None), (3, 2), (4, 0)])
def test_substrings_of_mixed_texts(made, monkeypatch, seed, shard):
    """shard: contexts with more classes go the other way."""
    if shard is not None:
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rows = _mixed(seed, 60)
    found = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup_substrings(made(rows).repartition(4), 100).collect()]
    want = brute.substrings(rows, 100)
    assert _sorted(found) == _sorted(want) and 0 < sum(x[2] for x in want) < sum(x[1] for x in want)


@pytest.mark.parametrize("shards", [2, 4])
def test_merged_transforms_find_what_counting_finds(monkeypatch, shards):
    monkeypatch.setattr(suffix_dedup, "SHARDS", shards)
    draw = np.random.default_rng(0)
    n, width = 400, 12
    context, shard, weight = draw.integers(0, 5, n), draw.integers(0, shards, n), draw.choice([1, 1, 1, 1, 1, 2], n)
    part = lambda: [bytes(draw.integers(97, 99, int(draw.choice([width, width, width, 5]))).astype(np.uint8)) for _ in range(n)]
    before, after = part(), part()
    found = suffix_dedup.repeated(context, shard, weight, before, after, width)
    for k in range(width + 1):
        keys = [(s, b[:k], a[: width - k]) if len(b) >= k and len(a) >= width - k else None for s, b, a in zip(context, before, after, strict=True)]
        count = Counter()
        for x, w in zip(keys, weight, strict=True):
            count[x] += int(w)
        assert found[:, k].tolist() == [x is not None and count[x] > 1 for x in keys]


def test_merging_is_building():
    """The transform of two shards, merged, is that of all their strings; common prefixes are what comparing finds."""
    draw = np.random.default_rng(1)
    group, strings = np.sort(draw.integers(0, 7, 200)), draw.integers(97, 99, (200, 20)).astype(np.uint8)
    side = draw.random(200) < 0.4
    told = {}
    both = suffix_dedup.merged(*(suffix_dedup.Transform.of(group, strings, np.flatnonzero(x)) for x in (side, ~side)), lambda t, rows, prefix: told.update({t: (rows.copy(), prefix.copy())}))
    whole = suffix_dedup.Transform.of(group, strings, both.rows)
    assert (both.group == whole.group).all() and (both.columns == whole.columns).all()
    for t, (rows, prefix) in told.items():
        texts = [strings[r, :t][::-1].tobytes() for r in rows]
        assert [(group[r], x) for r, x in zip(rows, texts, strict=True)] == sorted((group[r], x) for r, x in zip(rows, texts, strict=True))
        for k in range(1, len(rows)):
            same = next((i for i, (x, y) in enumerate(zip(texts[k - 1], texts[k], strict=True)) if x != y), t)
            assert prefix[k] == (same if group[rows[k]] == group[rows[k - 1]] else -1)


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_of_odd_texts(odd, nothing, size, num):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd, size, num).collect()]
    assert _sorted(found) == _sorted(brute.near(_pairs(odd), size, num))
    assert near_dup.near_duplicates(nothing, size, num).count() == 0
    kept = near_dup.keep_one(odd, size, num)
    assert kept.columns == odd.columns


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_in_big_groups(made, monkeypatch, block):
    """Star-shaped and chained groups around the threshold, in one chunk and in many."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    draw, rows = np.random.default_rng(4), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        for i in range(25):
            w = list(base)
            for k in draw.choice(60, int(draw.integers(0, 5)), replace=False):
                w[k] = f"new{g}{i}{k}"
            rows.append((100 * g + i, " ".join(w)))
            base = w if g % 2 else base
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(made(rows).repartition(5), 3, 85).collect()]
    want = brute.near(rows, 3, 85)
    assert _sorted(found) == _sorted(want)
    assert 4 < len({c for _, _, c in want}) < len(rows)


def test_bands_and_agreement():
    for num in (80, 85, 90):
        bands, p = near_dup.bands_for(num, 100), (num / 100) ** near_dup.ROWS
        assert (1 - p) ** bands <= near_dup.MISS < (1 - p) ** (bands - 1)
        assert 0 < near_dup.least_agreement(bands * near_dup.ROWS, num, 100) < num / 100 * bands * near_dup.ROWS


ITEMS = [(1, "Quick BROWN fox, jumps over the lazy dog and runs to the river"), (2, "own line ten"), (3, None), (4, ""), (5, "?!"), (None, "the quick brown fox"), (6, "12345"), (7, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (7, "ÄÖ"), (8, "lazy fox")]


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_contamination_of_odd_texts(spark, odd, nothing, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, segment int")
    found = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(odd, items).collect()]
    want = brute.contamination(_pairs(odd), ITEMS)
    assert _sorted(found) == _sorted(want) and sum(x[2] for x in want) > 10
    clean = decontaminate.keep_clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == sum(x[2] == 0 for x in want)
    assert decontaminate.contamination(nothing, items).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(odd, items.where("false")).collect())


def test_proximity(made, spark):
    docs = made([(1, "fox a b c d lazy"), (2, "fox " + "a " * 30 + "lazy"), (3, "lazy old fox"), (4, "lazy lazy")])
    items = spark.createDataFrame([(8, "lazy fox")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    near = {r.doc_id: (len(r.hits), r["items"]) for r in decontaminate.near_matches(index, items, reach=5).collect()}
    assert {i for i, x in near.items() if x[0]} == {1, 3} and near[1][1] == ["8"]
    assert all(not r.hits for r in decontaminate.phrase_matches(index, items).collect())


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_proximity_is_the_document_s_own(made, spark, monkeypatch, parts):
    """However documents are dealt to segments, and whatever stands beside them."""
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 1 << (6 + parts))
    draw = np.random.default_rng(11)
    some = lambda n, m: " ".join(f"t{int(x)}" for x in draw.integers(0, m, n))
    rows = [*[(k, some(int(draw.integers(0, 60)), 12)) for k in range(40)], (50, None), (51, ""), (None, some(30, 8)), (None, some(30, 8))]
    items = [*[(k, some(int(draw.integers(1, 7)), 12)) for k in range(6)], (9, "t1 t1 t2"), (10, "none of these")]
    index = decontaminate.build_index(made(rows).repartition(parts))
    found = [(r.doc_id, r.n_words, list(r.hits), list(r["items"])) for r in decontaminate.near_matches(index, spark.createDataFrame(items, "item_id long, text string"), window=4, reach=7).collect()]
    want = brute.proximity(rows, items, 4, 7)
    assert _sorted(found) == _sorted(want) and sum(len(x[2]) for x in want) > 50


def test_index_does_not_join_documents(made, spark):
    docs = made([(1, "alpha beta"), (2, "gamma delta")])
    items = spark.createDataFrame([(1, "beta gamma"), (2, "gamma delta")], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.contamination(docs.coalesce(1), items).collect()} == {1: [], 2: ["2"]}


def _jump(key, shards):
    b, j, key = -1, 0, key % (1 << 64)
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_are_the_published_ones(spark):
    keys = [0, 1, 2, 10, -1, 256, 0xDEAD10CC, 2**63 - 1, -(2**63), *range(1000, 1100)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 1000):
        assert {r.k: r.s for r in rows.select("k", sharding.jump_shard(rows.k, n).alias("s")).collect()} == {k: _jump(k, n) for k in keys}
    with pytest.raises(ValueError):
        sharding.jump_shard(rows.k, 0)


def test_shards_of_odd_texts(odd, nothing):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count()
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows}[1] == (1, 0)
    assert sharding.shard(nothing, 4).count() == 0


def test_slots_of_hot_keys_and_copies(made, monkeypatch):
    """One key with many texts, keys with a common residue, and equal rows, some at a time."""
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [*[(5, f"text {k}") for k in range(200)], *[(None, "same")] * 50, *[(1024 * k, "x") for k in range(300)], (7, None), (7, None)]
    out = sharding.shard(made(rows).repartition(3), 3).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all((r.shard, r.grown_shard) == (_jump(-1 if r.doc_id is None else r.doc_id, 3), _jump(-1 if r.doc_id is None else r.doc_id, 4)) for r in out)


def test_word_hashes_meet_on_equal_words_only():
    texts = ["one two", "Two three", "", "three"]
    import pyarrow as pa

    data, ends = common.utf8(pa.array([*texts, None]))
    buffer, starts = common.spaced(data, ends, 0, 5, 32)
    hashes, firsts = common.words(buffer, starts, near_dup.IN_WORD)
    assert firsts.tolist() == [0, 2, 4, 4, 5, 5]
    assert hashes[1] == hashes[2] and hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3


def test_entry_lists_them():

    import __spark_entry__

    assert {"op1_quality_rules", "op10_sharding", "pipeline"} <= set(__spark_entry__.queries())
