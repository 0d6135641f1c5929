"""Exact substring dedup: every byte covered by a string of min_bytes bytes that starts anywhere else too.

Anchors. Of every WINDOW consecutive positions the one with the least hash of its GRAM-byte string is an anchor (the
last one, if several are). A string of min_bytes bytes contains a whole window in its middle, so it has a middle anchor
that depends on its own bytes alone: wherever the string occurs, the anchor stands at the same place in it, with the same
bytes from `left` before to `right` after it (its context). So only anchors whose context occurs twice matter, and a
string that starts at p can only equal strings with the same context and the same offset between p and the anchor. This
is an exact filter in front of the merge, and it lines the suffixes up: of each occurrence of a context, the suffixes
that begin 0 to WINDOW-1 bytes before it.

Transforms. Occurrences with equal surroundings are one run of that many equal suffixes, with one representative. Runs
are dealt to SHARDS shards, and each shard has a Burrows-Wheeler transform of its own: for every column, from the last
byte of the surroundings to the first, the byte before each suffix, in the order of the suffixes.

Merging. Two transforms are merged by refining their interleave: it starts with one shard's suffixes of a context before
the other's, and each step reads the next byte of every suffix from the transforms and parts the interleave by it, in a
stable way. That is the order of the suffixes one byte longer. The last merge derives common prefixes on the way: two
neighbours' is one more than the least one between them a step before. Neighbours whose common prefix reaches min_bytes
and runs of two or more are the repeated intervals. No suffix is sorted again.

Hot contexts. A context with more than SHARD runs is parted: its strings with the smaller half of the offsets share more
bytes behind the context, those with the larger half more bytes before it, and with these as a longer context they are
merged like all others, parted again where needed. After seven halvings one offset is left, all of whose equal strings
are one run. So no task holds more than SHARD runs of a context, and every repeat comes from a merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm import common
from karstflow.llm.common import addressed, lean, mixed, sieve, sliced, stored

GRAM = 16
WINDOW = 128
#: Runs of a context that one task merges at most.
SHARD = 1 << 16
#: Transforms that are merged with each other, two at a time.
SHARDS = 4
#: Runs that are merged at a time, at least.
TOGETHER = 1 << 15
_PAD = 0xFF  # never a byte of UTF-8
_POSITION = np.uint64((1 << 28) - 1)
_RUNS = "context long, class long, weight long, before binary, after binary, low int, width int"


class Shape:
    """Lengths that follow from min_bytes."""

    def __init__(self, min_bytes: int):
        if min_bytes < 64:
            raise ValueError("min_bytes must be at least 64")
        self.size = min_bytes
        self.window = min(WINDOW, min_bytes // 3)
        self.left = (min_bytes - self.window - GRAM + 1) // 2
        self.right = min_bytes - self.left - self.window + 1
        #: bytes on either side of the context that strings with that anchor can reach
        self.reach = self.window - 1


def _grams(buffer: np.ndarray) -> np.ndarray:
    """Of every position a number that orders by the hash of its gram, then from the last position to the first."""
    n = len(buffer) - GRAM + 1
    word = np.ndarray((n + 8,), np.uint64, np.ascontiguousarray(buffer), 0, (1,)).copy()
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (word[8:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h & ~_POSITION) | (_POSITION - (np.arange(n, dtype=np.uint64) & _POSITION))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive ones."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _anchors(data: np.ndarray, ends: np.ndarray, shape: Shape) -> np.ndarray:
    """The positions, in `data`, of the middle anchors of all strings of shape.size bytes inside one document."""
    n = np.diff(ends) - shape.size + 1
    if not (n > 0).any():
        return np.zeros(0, np.int64)
    least = _least(_grams(data), shape.window)
    wanted = np.zeros(len(data) + 1, np.int32)
    first = ends[:-1][n > 0] + shape.left
    np.add.at(wanted, first, 1)
    np.add.at(wanted, first + n[n > 0], -1)
    start = np.flatnonzero(np.cumsum(wanted)[: len(least)])
    found = (_POSITION - (least[start] & _POSITION)).astype(np.int64)
    found += start & ~np.int64(_POSITION)  # positions are kept modulo 2 ** 28
    found = np.where(found < start, found + int(_POSITION) + 1, found)
    return found[np.flatnonzero(np.diff(found, prepend=-1))]


def _listed(shape: Shape):
    """(context, class, f, r, at): the anchors of each document with the hashes of their surroundings."""

    @lean
    def run(batches):
        for batch in batches:
            data, ends = common.utf8(batch.column(2))
            for i, j in common.blocks(ends):
                own, edges = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                at = _anchors(own, edges, shape)
                if not len(at):
                    continue
                doc = np.searchsorted(edges, at, "right") - 1
                low, high = at - shape.left, at + shape.right
                around = (np.maximum(edges[doc], low - shape.reach), np.minimum(edges[doc + 1], high + shape.reach))
                context = common.hashed(own, low, high)
                kind = mixed(common.hashed(own, *around) ^ mixed((low - around[0]).astype(np.uint64) * np.uint64(131) + (around[1] - high).astype(np.uint64)))
                for k in range(0, len(at), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    take = pa.array(doc[part] + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(context[part].view(np.int64)), pa.array(kind[part].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((at - edges[doc])[part])],
                        names=["context", "class", "f", "r", "at"],
                    )

    return run


def _surrounded(shape: Shape):
    """Runs with the bytes around the context of each representative, outwards."""

    @lean
    def run(batches):
        for batch in sliced(batches):
            for text, reps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, reps = text.encode(), reps.values
                at = reps.field("at").to_numpy()
                low, high = (at - shape.left).tolist(), (at + shape.right).tolist()
                before = [text[max(0, x - shape.reach) : x][::-1] for x in low]
                after = [text[x : x + shape.reach] for x in high]
                for k in range(0, len(at), 1 << 14):
                    part = slice(k, k + (1 << 14))
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(reps.field(x)[part] for x in ("context", "class", "weight")),
                            pa.array(before[part], pa.binary()),
                            pa.array(after[part], pa.binary()),
                            pa.array(np.zeros(n, np.int32)),
                            pa.array(np.full(n, shape.reach, np.int32)),
                        ],
                        names=["context", "class", "weight", "before", "after", "low", "width"],
                    )

    return run


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(x.ljust(width, bytes([_PAD])) for x in parts), np.uint8).reshape(len(parts), width)
    return rows, np.fromiter(map(len, parts), np.int64, len(parts))


class Transform:
    """A shard's transform. group: the context of each place, ascending; the suffixes of a context stand together in every
    column. columns[t]: the byte before each suffix, in the order of the suffixes of t bytes. rows: whose suffix stands
    where in the first column."""

    def __init__(self, group: np.ndarray, columns: np.ndarray, rows: np.ndarray):
        self.group, self.columns, self.rows = group, columns, rows

    @staticmethod
    def of(group: np.ndarray, strings: np.ndarray, rows: np.ndarray) -> Transform:
        """Of the strings of `rows`: strings[row, t] is the byte that is taken at step t."""
        group, order = group[rows].astype(np.int64), rows
        columns = np.empty((strings.shape[1], len(rows)), np.uint8)
        for t, column in enumerate(columns):
            column[:] = strings[order, t]
            order = order[np.argsort((group << 8) + column, kind="stable")]
        return Transform(group, columns, rows)


def merged(a: Transform, b: Transform, each=None) -> Transform:
    """The transform of both shards, by refinement of their interleave. each(t, rows, prefix), if given, is told for every
    t the suffixes of t bytes in order, and the common prefix of each with the one before it (-1 where a context begins, and
    at the end)."""
    group = np.concatenate([a.group, b.group])
    start = np.argsort(group, kind="stable")
    group, second = group[start], start >= len(a.group)
    columns = np.empty((len(a.columns), len(group)), np.uint8)
    rows = first = np.concatenate([a.rows, b.rows])[start]
    prefix = edge = -np.concatenate([[1], group[1:] != group[:-1], [1]]).astype(np.int32)[-len(group) - 1 :]
    for t, column in enumerate(columns):
        if each:
            each(t, rows, prefix)
        column[~second], column[second] = a.columns[t], b.columns[t]
        key = (group << 8) + column
        move = np.argsort(key, kind="stable")
        if each:
            key = key[move]
            joined = np.flatnonzero(key[1:] == key[:-1])
            new = edge.copy()
            if len(joined):
                spans = np.stack([move[joined] + 1, move[joined + 1] + 1], axis=1).ravel()
                new[joined + 1] = 1 + np.minimum.reduceat(prefix, spans)[::2]
            rows, prefix = rows[move], new
        second = second[move]
    if each:
        each(len(columns), rows, prefix)
    return Transform(group, columns, first)


def repeated(context: np.ndarray, shard: np.ndarray, weight: np.ndarray, before: list[bytes], after: list[bytes], width: int) -> np.ndarray:
    """len(context) x (width + 1) booleans: whether the string that takes k bytes of `before` and width - k of `after` besides
    the common context occurs again: in another run of the context, or in the run's own weight."""
    back, n_back = _padded(before, width)
    ahead, n_ahead = _padded(after, width)
    strings = np.concatenate([ahead[:, ::-1], back], axis=1)
    group = np.unique(context, return_inverse=True)[1]
    up = np.argsort(group, kind="stable")
    parts = [Transform.of(group, strings, up[shard[up] == s]) for s in range(SHARDS)]
    while len(parts) > 2:
        parts = [merged(*parts[k : k + 2]) for k in range(0, len(parts), 2)]
    out = np.zeros((len(group), width + 1), bool)

    def each(t: int, rows: np.ndarray, prefix: np.ndarray) -> None:
        k = t - width
        if k >= 0:
            out[rows, k] = (np.maximum(prefix[:-1], prefix[1:]) >= width) | (weight[rows] > 1)

    merged(*parts, each)
    steps = np.arange(width + 1)
    return out & (steps <= n_back[:, None]) & (width - steps <= n_ahead[:, None])


def _merged(shape: Shape):
    """Takes runs sorted by width and context; gives (context, class, low, high): as 128 bits, the offsets at which
    repeated strings start."""

    def done(rows, width):
        context, kind, weight, before, after, low = zip(*rows, strict=True)
        kinds = np.array(kind, np.int64)
        found = repeated(np.array(context, np.int64), kinds.view(np.uint64) % np.uint64(SHARDS), np.array(weight), list(before), list(after), width)
        bits, low = np.zeros((len(rows), 128), bool), np.array(low)
        for at in np.unique(low):
            bits[low == at, at : at + width + 1] = found[low == at]
        masks = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        some = np.flatnonzero(found.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(context, np.int64)[some], kinds[some], masks[some, 0], masks[some, 1])], names=["context", "class", "low", "high"])

    @lean
    def run(batches):
        rows, width = [], None
        for batch in batches:
            for *row, w in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if rows and (w != width or len(rows) >= TOGETHER and row[0] != rows[-1][0]):
                    yield from done(rows, width)
                    rows = []
                rows.append(row)
                width = w
        if rows:
            yield from done(rows, width)

    return run


@lean
def _halved(batches):
    """Of runs of hot contexts, those of the smaller and of the larger half of the offsets, under longer contexts."""
    number = lambda data, seed: int.from_bytes(xxhash.xxh3_64_digest(data, seed & (1 << 64) - 1), "big", signed=True)
    for batch in sliced(batches):
        out = []
        for context, kind, weight, before, after, low, width in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            half = width // 2
            if len(after) >= width - half:
                more, b, a = b"a" + after[: width - half], before[:half], after[width - half : width]
                out.append((context, kind, number(more, context), weight, b, a, low, half))
            if len(before) > half:
                more, b, a = b"b" + before[: half + 1], before[half + 1 : width], after[: width - half - 1]
                out.append((context, kind, number(more, context), weight, b, a, low + half + 1, width - half - 1))
        columns = list(zip(*out, strict=True)) or [()] * 8
        columns.insert(3, [number(bytes([len(b)]) + b + a, 0) for b, a in zip(columns[4], columns[5], strict=True)])
        kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int32(), pa.int32())
        names = ("above", "member", "context", "class", "weight", "before", "after", "low", "width")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _masks(runs: DataFrame, shape: Shape) -> DataFrame:
    """(context, class, low, high) of the runs (stored) that have repeated strings."""
    spark = runs.sparkSession
    hot = stored(runs.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, SHARD)).select("context"), "hot")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = runs.join(F.broadcast(hot), "context", "left_anti")  # one in SHARD of the runs at most
    cold = cold.repartition(n, "context").sortWithinPartitions("width", "context").select("context", "class", "weight", "before", "after", "low", "width")
    found = cold.mapInArrow(_merged(shape), "context long, class long, low long, high long")
    if not hot.head(1):
        return found
    parted = runs.join(F.broadcast(hot), "context").select("context", "class", "weight", "before", "after", "low", "width")
    parted = stored(parted.mapInArrow(_halved, f"above long, member long, {_RUNS}"), "parted")
    first = [F.first(x).alias(x) for x in ("before", "after", "low", "width")]
    below = stored(parted.groupBy("context", "class").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("members"), *first), "below")
    masks = below.select("context", "class", "members").join(_masks(below.drop("members"), shape), ["context", "class"])
    up = common.joined(parted.select("above", "member", "context", "class"), stored(masks, "masks"), ["context", "class"], "members", parted.count())
    return found.union(up.groupBy("above", "member").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high")))


def _cleared(shape: Shape):
    """Removes what the repeated strings cover."""

    @lean
    def run(batches):
        for batch in sliced(batches):
            out = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}

            def done():
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))

            held = 0
            for id_, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text, marks = (text or "").encode(), marks.values
                spans, kept, gone = [], text, 0
                if marks is not None and len(marks):
                    masks = np.stack([marks.field("low").to_numpy(), marks.field("high").to_numpy()], axis=1)
                    row, k = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
                    starts = np.zeros(len(text) + 1, np.int64)
                    starts[marks.field("at").to_numpy()[row] - shape.left - k] = 1
                    so_far = np.cumsum(starts)
                    covered = (so_far - np.concatenate([np.zeros(shape.size, np.int64), so_far])[: len(so_far)])[:-1] > 0
                    flips = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
                    spans = [{"start": int(x), "end": int(y)} for x, y in flips.reshape(-1, 2)]
                    gone = int(covered.sum())
                    kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                for name, x in zip(out, (id_, len(text), gone, spans, kept), strict=True):
                    out[name].append(x)
                held += len(text)
                if held > common.BLOCK_BYTES:
                    yield done()
                    held = 0
                    for x in out.values():
                        x.clear()
            if out["id"]:
                yield done()

    return run


def dedup_substrings(docs: DataFrame, min_bytes: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs of bytes, maximal), kept (the remaining bytes) for each row.

    A byte goes if a string of min_bytes bytes that covers it also starts anywhere else in the table, the same document
    included, overlaps counted, judged on the input; strings lie inside one document. A null text is empty, and nothing
    goes from a text under min_bytes bytes. Each row is a document of its own, so that equal rows repeat each other;
    null and repeated ids are kept; an empty table gives an empty result; other columns are ignored. Texts of any length
    are read whole, a block of documents at a time, one document at least. Which of equal strings stands for the others
    (a tie) doesn't matter: all of them go.

    Of the texts only those with a representative and those that lose something are shuffled, as far as the Bloom filters
    of their addresses hold (see common.sieve()).
    """
    shape = Shape(min_bytes)
    rows = addressed(docs, id=F.col(f"`{key}`").cast("long"), text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    anchors = stored(rows.select("f", "r", "text").mapInArrow(_listed(shape), "context long, class long, f long, r long, at long"), "anchors")
    twice = stored(anchors.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    found = stored(common.joined(anchors.where(sieve(twice, "context")), twice, ["context"], "n", anchors.count()).drop("n"), "repeated")

    classes = found.groupBy("context", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("f", "r", "at")).alias("rep"))
    classes = stored(classes, "classes")
    one = F.struct("context", "class", F.col("n").alias("weight"), F.col("rep.at").alias("at"))
    reps = stored(classes.groupBy(F.col("rep.f").alias("f"), F.col("rep.r").alias("r")).agg(F.collect_list(one).alias("reps")), "reps")
    around = rows.where(sieve(reps, "f", "r")).join(reps.hint("shuffle_hash"), ["f", "r"]).select("text", "reps")
    masks = _masks(stored(around.mapInArrow(_surrounded(shape), _RUNS), "around"), shape)

    verdicts = stored(classes.select("context", "class", "n").join(masks, ["context", "class"]), "verdicts")
    marks = common.joined(found, verdicts, ["context", "class"], "n", found.count()).groupBy("f", "r").agg(F.collect_list(F.struct("at", "low", "high")).alias("marks"))
    marks = stored(marks, "marks")
    may = sieve(marks, "f", "r")
    cut = rows.where(may).join(marks.hint("shuffle_hash"), ["f", "r"], "left").select("id", "text", "marks")
    cut = cut.mapInArrow(_cleared(shape), "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    none = F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")
    whole = rows.where(~may).select("id", F.octet_length("text").cast("long").alias("n_bytes"), *none, F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole).withColumnRenamed("id", "doc_id")
