"""What several operators share: addresses of rows, stored tables, filters and joins on hot keys, numpy views of texts."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.functions.shared import shared_dir, stored

__all__ = ["shared_dir", "stored"]

#: Bytes of text that a numpy block holds at most, unless one document alone has more.
BLOCK_BYTES = 1 << 20

#: Bits of a Bloom filter at most: 32 MiB, which is what is broadcast of one.
FILTER_BITS = 1 << 28
#: Bits of a filter that are merged at a time.
SEGMENT_BITS = 1 << 21

#: Keys with more than one in HOT of all rows are hot: there are fewer than HOT of them.
HOT = 2000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The inner join of rows with a table of one row a key, whose column n has the number of rows of the key.

    Rows of hot keys aren't shuffled: the table's rows for those, fewer than HOT of them, are broadcast.
    """
    hot = F.broadcast(table.where(F.col(n) > total // HOT))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= total // HOT), keys)
    return rows.join(hot, keys).unionByName(cold)


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is files with columns chosen and rows filtered: each of its rows is one row of a file."""
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation"):
            return False
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return True


def scanned(docs: DataFrame) -> DataFrame:
    """docs, if its rows come straight from Parquet files, so that their addresses are the same in every scan; else a stored copy."""
    if _is_scan(docs):
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
            return docs
        except AnalysisException:  # files of another format
            pass
    return stored(docs, "rows")


def addressed(docs: DataFrame, **columns: Column) -> DataFrame:
    """f, r and the given columns. (f, r), the hash of its file's path and its place in the file, tells a row from all
    others, whatever its id and text. Between calls it is the same if docs is scanned()."""
    if not _is_scan(docs):
        docs, columns = docs.select(*[c.alias(x) for x, c in columns.items()]), {x: F.col(x) for x in columns}
    docs = scanned(docs)
    at = docs.metadataColumn("_metadata")
    return docs.select(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("r"), *[c.alias(x) for x, c in columns.items()])


class Bits:
    """A bit set of fixed size with two places for each 64-bit hash."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.last = np.uint64(bits - 1)
        self.bytes = np.zeros(bits >> 3, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes & self.last, (hashes >> np.uint64(32)) & self.last

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.bytes[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1 == 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes)
        return self.at(a) & self.at(b)

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.bytes, (places >> np.uint64(3)).astype(np.int64), (1 << (places & np.uint64(7))).astype(np.uint8))


def _placed(bits: int):
    """(segment, places in it) of the bits of a column of hashes."""
    size = min(bits, SEGMENT_BITS)

    @lean
    def run(batches):
        own = Bits(bits, b"")
        for batch in batches:
            hashes = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            places = np.unique(np.concatenate(own.places(hashes)))
            segments, first = np.unique(places // np.uint64(size), return_index=True)
            parts = [(x % np.uint64(size)).astype(np.uint32).tobytes() for x in np.split(places, first[1:])] if len(places) else []
            yield pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int32)), pa.array(parts, pa.binary())], names=["segment", "places"])

    return run


def _joined_places(bits: int):
    """The bytes of each segment; rows come sorted by segment."""
    size = min(bits, SEGMENT_BITS)

    @lean
    def run(batches):
        now, flags = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["segment", "data"])

        for batch in batches:
            for segment, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != now:
                    if now is not None:
                        yield out()
                    now, flags = segment, np.zeros(size, np.uint8)
                flags[np.frombuffer(places, np.uint32)] = 1
        if now is not None:
            yield out()

    return run


def sieve(keys: DataFrame, *by: str):
    """A test for columns named like the given ones: false means that `keys` (stored; repeats don't matter) has no such
    row; true that it may have. A Bloom filter of about 16 bits a key, FILTER_BITS at most whatever the number of keys:
    a full one lets more rows through, so that a join has to follow.
    """
    spark = keys.sparkSession
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    size = min(bits, SEGMENT_BITS)
    hashed_ = F.xxhash64(*by)
    n = max(1, min(bits // size, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = keys.select(hashed_.alias("h")).mapInArrow(_placed(bits), "segment int, places binary")
    merged = placed.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(_joined_places(bits), "segment int, data binary")
    whole = np.zeros(bits >> 3, np.uint8)
    for segment, data in merged.toLocalIterator():  # FILTER_BITS / 8 bytes in all
        whole[segment * (size >> 3) : (segment + 1) * (size >> 3)] = np.frombuffer(data, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    @F.pandas_udf("boolean")
    def may_be(hashes: pd.Series) -> pd.Series:
        return pd.Series(Bits(bits, shared.value).has(hashes.to_numpy().view(np.uint64)))

    return may_be(hashed_)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (scanned) but for the rows with the addresses (f, r) in `gone`, a stored table. Only rows that pass a Bloom filter of
    the addresses are shuffled."""
    rows = addressed(docs, **{f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    may = sieve(gone, "f", "r")
    kept = rows.where(~may).unionByName(rows.where(may).join(gone.select("f", "r"), ["f", "r"], "left_anti"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def lean(run):
    """A function of batches that gives memory back when its task ends: workers wait for more tasks with what they hold."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def sliced(batches, rows: int = 1000):
    """The batches in slices of a few rows: what is made of the texts at a time stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end and the len+1 offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(ends: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges (i, j) of documents with at most `most` bytes together, one document at least."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spaced(data: np.ndarray, ends: np.ndarray, i: int, j: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of documents i to j-1, each followed by one `pad` byte, and their starts (and the end)."""
    starts = ends[i : j + 1] - ends[i] + np.arange(j - i + 1)
    out = np.full(int(starts[-1]), pad, np.uint8)
    for k in range(j - i):
        out[starts[k] : starts[k + 1] - 1] = data[ends[i + k] : ends[i + k + 1]]
    return out, starts


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n-1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered(buffer: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[buffer]


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings data[begin:end]."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[data] * _power(_BASE, len(data)), out=total[1:])
    return mixed((total[end] - total[begin]) * _power(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))


def words(buffer: np.ndarray, starts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a spaced() buffer after A-Z is lower-cased, and the first word of each document
    (and the end). in_word: 256 booleans, by byte of the lower-cased text; the buffer's pad byte must not be in a word.
    """
    low = lowered(buffer)
    inside = in_word[low]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        flips = np.concatenate([[0], flips])
    begin, end = flips[::2], flips[1::2]
    return hashed(low, begin, end), np.searchsorted(begin, starts)


def shingled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n]
    for k in range(1, size):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n])
    return out
