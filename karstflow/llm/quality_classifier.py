"""Quality by nearest-neighbour voting in a latent semantic space.

Texts are hashed character trigrams (half of the buckets) and trigrams of character kinds (the other half), weighted by
log(1 + count) and inverse document frequency among all documents, labelled or not, the first half less (PLAIN), as kinds
tell quality in any language. A truncated singular value decomposition of a bounded labelled sample gives RANK directions; the sample's unit vectors
(SAMPLE of each label, about: 1 MiB in all) are broadcast with them.
Each document's cosine with every labelled vector is computed exactly, a block of documents at a time, and the NEAREST
ones vote with a power of their similarity. Votes are weighted so that the sampling of labels doesn't shift the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm import chargrams
from karstflow.llm.common import lean

BITS = 11  # of each half
BUCKETS = 2 << BITS
RANK = 48
PLAIN = 0.3
SAMPLE = 2000
NEAREST, POWER = 25, 8
#: Documents whose vectors are held at a time.
ROWS = 256


@dataclass
class Model:
    idf: np.ndarray
    directions: np.ndarray  # bucket x rank
    vectors: np.ndarray  # labelled x rank, unit rows
    good: np.ndarray  # label of each
    weight: np.ndarray  # vote of each
    prior: float


def _portions(column: pa.Array):
    """(first row, counts by row and bucket) of portions of up to ROWS texts."""
    for i, j, points, rows in chargrams.blocks(column, lower=False):
        plain, plain_row = chargrams.grams(points, rows, 3, BITS, 2)
        kind, kind_row = chargrams.grams(chargrams.kinds()[points], rows, 3, BITS, 3)
        for k in range(0, j - i, ROWS):
            size = min(ROWS, j - i - k)
            counts = np.zeros(size * BUCKETS, np.float32)
            for bucket, row in ((plain, plain_row), (kind + (1 << BITS), kind_row)):
                a, b = np.searchsorted(row, [k, k + size])
                counts += np.bincount((row[a:b] - k) * BUCKETS + bucket[a:b], minlength=size * BUCKETS)
            yield i + k, counts.reshape(size, BUCKETS)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@lean
def _featured(batches):
    for batch in batches:
        for i, counts in _portions(batch.column(0)):
            for k, row in enumerate(counts):
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i + k : i + k + 1], pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([row[at].astype(np.float32).tobytes()], pa.binary())], names=["good", "at", "n"]
                )


@lean
def _present(batches):
    """Of all texts of a task: in how many each bucket is, and at bucket -1 how many there are."""
    n, total = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        total += batch.num_rows
        for _, counts in _portions(batch.column(0)):
            n += np.count_nonzero(counts, axis=0)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], total))], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log((1 + documents) / (1 + those with the bucket)) + 1 for each bucket, over all rows of docs. Null and empty texts
    are documents without terms. Tasks send their sums, a row a bucket; BUCKETS + 1 rows come to the driver."""
    sums = docs.select(F.col(f"`{text}`")).mapInArrow(_present, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in sums.collect()}
    n = np.array([found.get(k, 0) for k in range(BUCKETS)], np.float64)
    return (np.log((1 + found.get(-1, 0)) / (1 + n)) + 1).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from about `sample` labelled documents of each of the labels 0 and 1. The labels must be one a document;
    of several the largest counts. Null labels and labels without a document don't count; null and empty texts have no
    terms. Without any labelled document every score is 0.5. Document frequencies are those of all rows of docs."""
    marks = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("good")).where("good in (0, 1)")
    marks = marks.groupBy("key").agg(F.max("good").alias("good"))
    total = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    chosen = F.broadcast(chargrams.sampled(marks, "good", F.col("key"), sample))  # about 2 * sample rows
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(chosen, "key").select("text", "good")
    found = rows.mapInArrow(_featured, "good int, at binary, n binary").collect()
    prior = total.get(1, 0) / max(1, sum(total.values()))
    if not found:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32), 0.5)
    found.sort(key=lambda r: (r["good"], bytes(r["at"]), bytes(r["n"])))  # the same model whatever the order of arrival
    x = np.zeros((len(found), BUCKETS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
    good = np.array([r["good"] for r in found], np.float32)
    idf = inverse_frequencies(docs, text)
    idf[: 1 << BITS] *= np.float32(PLAIN)
    x = _unit(np.log1p(x) * idf)
    # truncated singular value decomposition by subspace iteration
    rank = min(RANK, *x.shape)
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(5).standard_normal((BUCKETS, min(rank + 16, *x.shape))).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    directions = np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)
    share = {y: total[y] / max(1, (good == y).sum()) for y in total}
    weight = np.array([share[int(y)] for y in good], np.float32)
    return Model(idf, directions, _unit(x @ directions), good, weight / weight.max(), prior)


def scored(model: Model, counts: np.ndarray) -> np.ndarray:
    """The score of each row of bucket counts. A row without a similar neighbour gets the prior."""
    if not len(model.vectors):
        return np.full(len(counts), model.prior)
    x = _unit(_unit(np.log1p(counts) * model.idf) @ model.directions)
    near = x @ model.vectors.T
    k = min(NEAREST, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    vote = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** POWER * model.weight[top]
    both = vote.sum(axis=1, dtype=np.float64)
    return np.where(both > 0, (vote * model.good[top]).sum(axis=1, dtype=np.float64) / np.where(both > 0, both, 1), model.prior).clip(0, 1)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """For each row of docs the columns in `keep`, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    Texts that are null, empty or too short for a trigram get the share of label 1 among all labels. Repeated rows are
    scored each for itself; a text of any length is scored whole; an empty table gives an empty result; columns that aren't
    in `keep` are ignored. Where several neighbours are equally near at the last place (a tie), any of them votes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[c.alias(name) for name, c in keep.items()])
    kept = list(keep)

    @lean
    def run(batches):
        for batch in batches:
            score = [scored(shared.value, counts) for _, counts in _portions(batch.column(0))]
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = rows.drop("_text").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)
