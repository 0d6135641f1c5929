"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, 2**BITS buckets by languages (a float32 matrix of 64 MiB at the most, 256
languages), and is broadcast. Texts are lower-cased, each run of other characters than letters counts as one space.
Scoring takes a portion of texts at a time: the bucket numbers of all n-grams pick rows of the matrix, which are summed
up text by text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm import chargrams
from karstflow.llm.common import lean

BITS = 16
SIZES = (1, 2, 3)
#: Training documents of each language, about.
SAMPLE = 2000
SMOOTHING = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_given: np.ndarray  # bucket x language


def _letters(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with each run of other characters as one space, their rows, and the number of letters by row."""
    letter = chargrams.is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    n = np.bincount(rows[letter], minlength=int(rows[-1]) + 1 if len(rows) else 0)
    return np.where(letter, points, np.uint32(32))[keep], rows[keep], n


@lean
def _counted(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), object)
        for i, j, points, rows in chargrams.blocks(batch.column(0), lower=True):
            points, rows, _ = _letters(points, rows)
            for size in SIZES:
                bucket, row = chargrams.grams(points, rows, size, BITS, 1)
                for language in set(languages[i:j]):
                    own = bucket[(languages[i:j] == language)[row]]
                    totals[language] = totals.get(language, 0) + np.bincount(own, minlength=1 << BITS)
    for language, n in totals.items():
        yield pa.RecordBatch.from_pydict({"language": pa.array([language]), "n": pa.array([zlib.compress(n.astype(np.int64).tobytes(), 1)], pa.binary())})


def train(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the languages in docs, from about `sample` documents of each; rows with null text or language don't
    count. Without any, the model knows no language."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").cast("string").alias("language"), F.col(f"`{key}`").alias("key"))
    rows = rows.where("text is not null and language is not null")
    counts = chargrams.counted(rows, "language")
    chosen = chargrams.sampled(rows, "language", F.col("key"), sample, counts).select("text", "language")
    totals: dict[str, np.ndarray] = {}
    for name, n in chosen.repartition(8).mapInArrow(_counted, "language string, n binary").toLocalIterator():
        totals[name] = totals.get(name, 0) + np.frombuffer(zlib.decompress(n), np.int64)
    names = sorted(totals)
    if not names:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0), np.float32))
    n = np.stack([totals[x] for x in names], axis=1) + SMOOTHING
    prior = np.array([counts[x] for x in names], float)
    return Model(names, np.log(prior / prior.sum()), np.log(n / n.sum(axis=0)).astype(np.float32))


def scores(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its probability; UNKNOWN and 0 for texts without a letter."""
    names, probability = [], []
    for i, j, points, rows in chargrams.blocks(column, lower=True):
        points, rows, letters = _letters(points, rows)
        letters = np.pad(letters, (0, j - i - len(letters)))
        total = np.tile(model.log_prior, (j - i, 1))
        for size in SIZES if model.languages else ():
            bucket, row = chargrams.grams(points, rows, size, BITS, 1)
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[first]] += np.add.reduceat(model.log_given[bucket], first, axis=0, dtype=np.float64)
        if not model.languages:
            names += [UNKNOWN] * (j - i)
            probability.append(np.zeros(j - i))
            continue
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        names += [model.languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
        probability.append(np.where(letters > 0, 1 / odds.sum(axis=1), 0.0))
    return names, np.concatenate(probability) if probability else np.zeros(0)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """For each row of docs the columns in `keep`, lang_pred and score (0 to 1).

    A null text, or one without a letter, has `und` and 0. Of languages with one probability (a tie) the first by name
    wins. A text of any length is scored whole. Repeated rows are scored each for itself; an empty table gives an empty
    result; columns of docs that aren't in `keep` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[c.alias(name) for name, c in keep.items()])
    kept = list(keep)

    @lean
    def run(batches):
        for batch in batches:
            names, probability = scores(shared.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(probability)], names=[*kept, "lang_pred", "score"])

    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
