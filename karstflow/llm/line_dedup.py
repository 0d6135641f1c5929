"""Line dedup with two Bloom filters.

Scan 1 puts the 64-bit hash of every line key into a pair of Bloom filters, `once` (seen) and `twice` (seen when its
bits in `once` were set already). Each task fills a pair of its own; the pairs are merged by segment, where the bits
that two tasks share also go to `twice`. A key of two documents is always in `twice`; a key of one is there by chance
only. Scan 2 tests every key against `twice`, and only what passes is shuffled, as 16-byte digests of whole keys, for
the exact count of documents and the choice of the one that keeps its lines. Scan 3 takes the lines out; of the texts only
those that lose lines are shuffled, as far as a Bloom filter of their rows' addresses holds.

The filters' size is fixed (FILTER_BITS, 32 MiB each at 2**28 bits) whatever the input, so that what is broadcast has a
proven bound. With more keys than it is made for (about 10**8 distinct ones for a tenth of chance hits), more keys that
stand alone are shuffled, up to all of them: results never change.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karstflow.llm.common import FILTER_BITS, SEGMENT_BITS, Bits, addressed, joined, lean, sieve, sliced, stored

_SPACE = b" \t\n\x0b\x0c\r"
_LEAST = -(1 << 63)


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line without white space at both ends, A-Z lower-cased; None if it has under min_chars code points."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key.lower()


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if len(line) >= min_chars and (k := _key(line, min_chars)) is not None}


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def _filled(min_chars: int, bits: int):
    """Scan 1: a partition's pair of filters, as the non-empty segments' set bits."""

    @lean
    def run(batches):
        once, twice = Bits(bits), Bits(bits)
        for batch in sliced(batches):
            found = [xxhash.xxh3_64_intdigest(k) for t in _texts(batch, "text") for k in _keys(t, min_chars)]
            hashes, times = np.unique(np.array(found, np.uint64), return_counts=True)
            again = (times > 1) | once.has(hashes)
            for at in once.places(hashes):
                once.add(at)
                twice.add(at[again])
        for kind, one in ((0, once), (1, twice)):
            whole = one.bytes.reshape(-1, SEGMENT_BITS >> 3)
            for k in np.flatnonzero(whole.any(axis=1)):
                at = np.flatnonzero(np.unpackbits(whole[k], bitorder="little")).astype(np.uint32)
                dense = 4 * len(at) > SEGMENT_BITS >> 3
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array([int(k)], pa.int32()), "kind": pa.array([kind + 2 * dense], pa.int32()), "data": pa.array([whole[k].tobytes() if dense else at.tobytes()], pa.binary())}
                )

    return run


@lean
def _merged(batches):
    """The `twice` bits of each segment; rows come sorted by segment."""
    now, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "data": pa.array([twice.tobytes()], pa.binary())})

    for batch in batches:
        for segment, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if segment != now:
                if now is not None and twice.any():
                    yield out()
                now, once, twice = segment, np.zeros(SEGMENT_BITS >> 3, np.uint8), np.zeros(SEGMENT_BITS >> 3, np.uint8)
            if kind >= 2:
                part = np.frombuffer(data, np.uint8)
            else:
                flags = np.zeros(SEGMENT_BITS, np.uint8)
                flags[np.frombuffer(data, np.uint32)] = 1
                part = np.packbits(flags, bitorder="little")
            if kind & 1:
                twice |= part
            else:
                twice |= once & part
                once |= part
    if now is not None and twice.any():
        yield out()


def _suspected(min_chars: int, bits: int, shared):
    """Scan 2: (f, r, id, digest of the key) of every key of a row that `twice` has."""

    @lean
    def run(batches):
        twice = Bits(bits, shared.value)
        for batch in sliced(batches):
            rows, keys = [], []
            for i, text in enumerate(_texts(batch, "text")):
                found = _keys(text, min_chars)
                rows += [i] * len(found)
                keys += found
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            for part in np.array_split(np.flatnonzero(twice.has(hashes)), max(1, len(keys) >> 16)):
                take = pa.array([rows[k] for k in part], pa.int64())
                digests = pa.array([hashlib.blake2b(keys[k], digest_size=16).digest() for k in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), digests], names=["f", "r", "id", "key"])

    return run


def _dropped(min_chars: int):
    """Takes the lines out whose keys are in `drop`."""

    @lean
    def run(batches):
        for batch in sliced(batches):
            texts, n_lines, n_dropped = [], [], []
            column = batch.column(batch.schema.get_field_index("text"))
            drops = batch.column(batch.schema.get_field_index("drop")).to_pylist()
            for text, null, drop in zip(_texts(batch, "text"), column.is_null().to_pylist(), drops, strict=True):
                n = text.count(b"\n") + 1
                gone = 0
                if drop:
                    drop = set(drop)
                    stay = [x for x in text.split(b"\n") if (k := _key(x, min_chars)) is None or hashlib.blake2b(k, digest_size=16).digest() not in drop]
                    gone = n - len(stay)
                    text = b"\n".join(stay)
                texts.append(None if null else text)
                n_lines.append(n)
                n_dropped.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["row", "text", "n_lines", "n_dropped"],
            )

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "last", key: str = "doc_id", text: str = "text", bits: int = FILTER_BITS, counts: bool = True) -> DataFrame:
    """docs with repeated lines taken out of the text, and, with `counts`, n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least min_chars code points
    in at least min_docs documents lose all their lines but those of the document with the largest key column
    (keep="last") or the smallest (keep="first"). Other lines stay, joined by newlines.

    A null or empty text is one empty line and stays as it is. Rows with the same doc_id are one document, all of whose
    lines of a key stay or go; null ids are one document that comes before all others. A text of any length is read whole; of
    a row only its own lines are ever held. An empty table gives an empty result. Other columns pass through; if docs
    has columns n_lines or n_dropped, the counts stand in their stead.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    spark = docs.sparkSession
    if bits % SEGMENT_BITS or bits & (bits - 1):
        raise ValueError("bits must be a power of two and a multiple of SEGMENT_BITS")
    new = ["n_lines", "n_dropped"] if counts else []
    others = [c for c in docs.columns if c not in (text, *new)]
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = addressed(docs, id=F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LEAST)), text=F.col(f"`{text}`"), row=row)
    parts = rows.select("text").mapInArrow(_filled(min_chars, bits), "segment int, kind int, data binary")
    n = max(1, min(bits // SEGMENT_BITS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = parts.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, data binary")
    whole = np.zeros(bits >> 3, np.uint8)
    for segment, data in merged.toLocalIterator():  # FILTER_BITS / 8 bytes in all
        whole[segment * (SEGMENT_BITS >> 3) : (segment + 1) * (SEGMENT_BITS >> 3)] = np.frombuffer(data, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    suspects = stored(rows.select("f", "r", "id", "text").mapInArrow(_suspected(min_chars, bits, shared), "f long, r long, id long, key binary"), "suspects")
    chosen = F.max("id") if keep == "last" else F.min("id")
    by_doc = suspects.groupBy("key", "id").agg(F.count(F.lit(1)).alias("rows"))
    confirmed = by_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("n"), chosen.alias("keeper")).where(F.col("docs") >= min_docs).drop("docs")
    confirmed = stored(confirmed, "confirmed")
    drops = joined(suspects, confirmed, ["key"], "n", suspects.count()).where("id <> keeper").groupBy("f", "r").agg(F.collect_set("key").alias("drop"))
    drops = stored(drops, "drops")
    may = sieve(drops, "f", "r")
    out = rows.where(may).join(drops.hint("shuffle_hash"), ["f", "r"], "left").select("row", "text", "drop").mapInArrow(
        _dropped(min_chars), T.StructType().add("row", rows.schema["row"].dataType).add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    )
    lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) + 1
    out = out.unionByName(rows.where(~may).select("row", "text", lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))
    back = {c: F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(others)}
    kept = [F.col("text").alias(c) if c == text else back[c] for c in docs.columns if c == text or c in back]
    return out.select(*kept, *new)
