"""Hashed character n-grams of batches of texts, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import mixed

#: Characters that are handled at a time, unless one text has more.
BLOCK_CHARS = 1 << 20
_tables: dict[str, np.ndarray] = {}


def is_letter() -> np.ndarray:
    """By code point: whether it is a letter."""
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def kinds() -> np.ndarray:
    """By code point: itself below 128 if neither letter nor digit, else a class of letters, digits or others."""
    if "kind" not in _tables:
        table = np.full(0x110000, 1, np.uint32)
        letter = is_letter()
        table[letter] = 2
        table[[c for c in np.flatnonzero(letter).tolist() if chr(c).isupper()]] = 3
        table[[c for c in range(128) if not chr(c).isalnum()]] = [c + 16 for c in range(128) if not chr(c).isalnum()]
        table[48:58] = 4
        _tables["kind"] = table
    return _tables["kind"]


def blocks(column: pa.Array, lower: bool):
    """(first row, code points, row of each) of portions of a column; null texts are empty."""
    texts = [x or "" for x in column.to_pylist()]
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= BLOCK_CHARS):
            held += len(texts[j])
            j += 1
        part = [x.lower() for x in texts[i:j]] if lower else texts[i:j]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, points, np.repeat(np.arange(j - i), [len(x) for x in part])
        i = j


def grams(points: np.ndarray, rows: np.ndarray, n: int, bits: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams inside each row: hashes have `bits` bits."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), rows[:0]
    key = np.full(size, (salt * 8 + n) % (1 << 30), np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9FB21C651E98DF25) + points[k : k + size]
    inside = rows[:size] == rows[n - 1 :]
    return (mixed(key[inside]) >> np.uint64(64 - bits)).astype(np.int64), rows[:size][inside]


def counted(rows: DataFrame, label: str) -> dict:
    """The number of rows of each label; more than 256 labels are an error, so that these are a bounded number."""
    counts = rows.groupBy(label).count().limit(257).collect()
    if len(counts) > 256:
        raise ValueError("more than 256 labels")
    return {r[label]: r["count"] for r in counts}


def sampled(rows: DataFrame, label: str, key: Column, most: int, counts: dict | None = None) -> DataFrame:
    """About `most` rows of each label (all, if there are fewer), by a hash of the key: no sort, and no task holds a label.
    counts: what counted() gave for rows, if that is known."""
    share = F.lit(0)
    for own, n in (counted(rows, label) if counts is None else counts).items():
        share = F.when(F.col(label) == F.lit(own), F.lit(min(1 << 20, -(-most * (1 << 20) // n)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 20)) < share)
