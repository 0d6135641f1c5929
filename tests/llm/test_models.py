"""Token counts, language, packing, quality scores: brute force, round trips and held-out accuracy."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karstflow.llm import language_id, packing, quality_classifier, queries, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(RANKS)


def _all(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_edits_count_as_if_encoded_again(counter):
    draw = random.Random(7)
    some = ["a", "the ", " ", "  ", "\n", "'s", "'re", "7", "!!", "é", "\t", " x", "word", "'", "r", "e", "s", "中"]
    for _ in range(300):
        doc = token_counts.Document(counter, "".join(draw.choices(some, k=draw.choice([0, 1, 5, 50, 400, 1500]))))
        assert doc.tokens == _all(counter, doc.text)
        for _ in range(4):
            a = draw.randint(0, len(doc.text))
            doc.edit(a, min(len(doc.text), a + draw.choice([0, 0, 1, 3, 30, 300])), "".join(draw.choices(some, k=draw.choice([0, 1, 2, 20]))))
            assert doc.tokens == _all(counter, doc.text)
            assert sum(len(x) for x, _ in token_counts.Tree.leaves(doc.tree)) == doc.tree[0] == len(doc.text)


def test_edits_touch_little(counter):
    doc = token_counts.Document(counter, "The quick brown fox. " * 5000)
    doc.edit(50000, 50003, "XYZ")
    assert doc.encoded < 2000 and doc.tokens == _all(counter, doc.text)
    with pytest.raises(ValueError):
        doc.edit(5, 3, "")


def test_edits_in_groups_are_edits_in_turn(counter):
    draw = random.Random(8)
    for _ in range(200):
        text = "".join(draw.choices(["the ", "x", " ", "\n\n", "'re", "12", "é"], k=draw.choice([0, 3, 60, 900])))
        doc, todo, at = token_counts.Document(counter, text), [], draw.randint(0, len(text))
        for _ in range(draw.choice([1, 5, 40])):
            start = min(len(text), max(0, at + draw.choice([-300, -40, -3, 0, 2, 30, 500])))
            end, new = min(len(text), start + draw.choice([0, 1, 5, 50])), draw.choice(["", " ", "new", "a b c ", "\n"])
            todo.append((start, end, new))
            text, at = text[:start] + new + text[end:], start
        doc.edits(todo)
        assert doc.text == text and doc.tokens == _all(counter, text)


def test_many_edits_of_a_long_text(counter):
    """Cost follows the edits: 100,000 in one text, from the last to the first, and spread over it."""
    import time

    text = "Write to some.one@example.org or call, please. " * 100_000
    places = [k * 47 + 9 for k in range(100_000)][::-1]
    took = []
    for n in (25_000, 100_000):
        doc, began = token_counts.Document(counter, text), time.time()
        doc.edits((a, a + 20, "[EMAIL]") for a in places[:n])
        took.append(time.time() - began)
    assert doc.tokens == _all(counter, text.replace("some.one@example.org", "[EMAIL]"))
    assert took[1] < 12 * took[0] and took[1] < 120
    draw = random.Random(9)
    for _ in range(3000):
        a = draw.randrange(len(text) - 100)
        doc.edit(min(a, doc.tree[0]), min(a + 5, doc.tree[0]), "new ")
    assert doc.tokens == _all(counter, doc.text)


def test_token_counts_of_odd_texts(odd, nothing, counter):
    state = token_counts.count_tokens(odd, RANKS)
    assert sorted((r.n_tokens, sum(r.leaf_tokens), sum(r.leaf_chars)) for r in state.collect()) == sorted((n := _all(counter, r.text or ""), n, len(r.text or "")) for r in odd.collect())
    edits = token_counts.redactions(F.col("text"), "[a-z]*o[a-z]*", "<O>")
    done = token_counts.apply_edits(state, edits, RANKS).collect()
    assert all(r.n_tokens == _all(counter, r.text or "") for r in done) and any(r.n_encoded for r in done)
    want = odd.select(F.regexp_replace("text", "[a-z]*o[a-z]*", "<O>").alias("t")).collect()
    assert sorted(r.text or "" for r in done) == sorted(r.t or "" for r in want)
    assert token_counts.apply_edits(token_counts.count_tokens(nothing, RANKS), edits, RANKS).count() == 0


def test_op3_against_counting_again(spark, sf, counter):
    import re

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_token_counts(spark, sf).collect():
        assert (r.n_tokens_before, r.n_tokens) == (_all(counter, texts[r.doc_id]), _all(counter, re.sub(queries.EMAIL, "[EMAIL]", texts[r.doc_id])))


def test_encoder_is_the_tokenizer():
    own, draw = packing.Encoder(WORDS), random.Random(3)
    some = ["a", "B", "é", "É", " ", "\n", "'", "'s", "<|endoftext|>", "<|", "|>", "endoftext", "́", "e", "\x1c", "İ", "ß", "ſ", "7", "½", "Σ", "ς", "!!", "...", "_", "中", "ﬁ", "​", "K", "word" * 20]
    texts = ["".join(draw.choices(some, k=draw.choice([0, 1, 3, 10, 80]))) for _ in range(3000)]
    for text, ids in zip(texts, own.ids(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def _check_packing(texts, rows, length=2048):
    tokenizer = packing.Encoder(WORDS).tokenizer
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return sum(r.length for r in rows) / (length * len(sequences))


def test_packing_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert _check_packing(texts, queries.op6_packing(spark, sf).collect()) > 0.95


def test_packing_odd_texts(odd, nothing, made):
    rows = packing.pack(odd, WORDS, length=64, group=4).collect()
    twice = [r for r in rows if r.doc_id == 8]
    assert len(twice) % 2 == 0 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert [(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == 1] == [(0, 1, 1)]
    unique = odd.where("doc_id <> 8 or doc_id is null")
    _check_packing({r.doc_id: r.text for r in unique.collect()}, packing.pack(unique, WORDS, length=64, group=4).collect(), 64)
    assert packing.pack(nothing, WORDS).count() == 0


def test_first_fit_decreasing_is_the_plain_one():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 300):
        sizes = draw.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            b = next((b for b, r in enumerate(room) if r >= sizes[k]), len(room))
            room += [100] * (b == len(room))
            assert (bins[k], offsets[k]) == (b, 100 - room[b])
            room[b] -= sizes[k]


def test_language_held_out(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_scores_are_bayes(made):
    """The sparse sums against log-probabilities added up one by one."""
    import math

    from karstflow.llm import chargrams

    docs = made([(1, "the cat sat"), (2, "the dog"), (3, "der hund und")]).withColumn("lang", F.when(F.col("doc_id") == 3, "de").otherwise("en"))
    model = language_id.train(docs)
    texts = ["the hund", "A the-dog!", "zz", None, "", "123 !"]
    names, scores = language_id.scores(model, pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0.0)
            continue
        squeezed = np.array([ord(c) for c in __import__("re").sub(r"[^a-z]+", " ", text.lower())], np.uint32)
        total = model.log_prior.copy()
        for n in language_id.SIZES:
            for b in chargrams.grams(squeezed, np.zeros(len(squeezed), int), n, language_id.BITS, 1)[0]:
                total = total + model.log_given[b]
        odds = [math.exp(x - max(total)) for x in total]
        assert name == model.languages[int(np.argmax(total))] and score == pytest.approx(1 / sum(odds), rel=1e-5)


def test_language_of_odd_texts(odd, nothing):
    model = language_id.train(odd)
    rows = language_id.predict(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 17)} == {"und"}
    assert language_id.predict(nothing, model, {"doc_id": F.col("doc_id")}).count() == 0
    none = language_id.train(nothing)
    assert {r.lang_pred for r in language_id.predict(odd, none, {"doc_id": F.col("doc_id")}).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, good[r.doc_id]) for r in rows if r.held_out and good.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_votes_are_exact():
    draw = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rank, n = 8, 60
    model = quality_classifier.Model(
        np.ones(quality_classifier.BUCKETS, np.float32), draw.standard_normal((quality_classifier.BUCKETS, rank)).astype(np.float32), unit(draw.standard_normal((n, rank))).astype(np.float32),
        draw.integers(0, 2, n).astype(np.float32), draw.random(n).astype(np.float32), 0.3,
    )
    counts = draw.integers(0, 3, (5, quality_classifier.BUCKETS)).astype(np.float32)
    counts[4] = 0
    for row, score in zip(counts, quality_classifier.scored(model, counts), strict=True):
        x = np.log1p(row) @ model.directions
        if not row.any():
            assert score == 0.3
            continue
        near = model.vectors @ (x / np.linalg.norm(x))
        top = np.argsort(-near)[: quality_classifier.NEAREST]
        vote = np.maximum(near[top], 0) ** quality_classifier.POWER * model.weight[top]
        assert score == pytest.approx(float((vote * model.good[top]).sum() / vote.sum()), abs=1e-4)


def test_document_frequencies_cover_all_documents(odd, nothing):
    idf = quality_classifier.inverse_frequencies(odd)
    texts = [r.text for r in odd.select("text").collect()]
    n = np.zeros(quality_classifier.BUCKETS)
    for text in texts:
        for _, counts in quality_classifier._portions(pa.array([text], pa.string())):
            n += counts[0] > 0
    assert n.any()
    np.testing.assert_allclose(idf, np.log((1 + len(texts)) / (1 + n)) + 1, rtol=1e-6)
    np.testing.assert_allclose(quality_classifier.inverse_frequencies(odd.repartition(7)), idf)
    assert set(quality_classifier.inverse_frequencies(nothing)) == {1}


def test_quality_of_odd_texts(odd, nothing, spark):
    labels = spark.createDataFrame([(7, 1), (8, 1), (18, 0), (19, 0), (19, None), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(odd, labels)
    rows = quality_classifier.predict(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.predict(nothing, model, {"doc_id": F.col("doc_id")}).count() == 0
    none = quality_classifier.train(nothing, labels)
    assert {r.score for r in quality_classifier.predict(odd, none, {"doc_id": F.col("doc_id")}).collect()} == {0.5}
