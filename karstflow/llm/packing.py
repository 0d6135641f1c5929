"""Packing of tokenised documents into sequences: first-fit decreasing on a tournament tree, in randomised groups.

A document's ids are those of its text and one end id. They are cut every `length` ids; full pieces are sequences of
their own, and the rests are packed. Documents are dealt to groups of about GROUP documents by a hash of their key and
checksums, equal ones COPIES at a time, and each group is packed alone: longest first, each into the first open sequence
with room, which a tournament tree over the sequences' room finds in logarithmic time.

Tokenising happens once, where the text is read; only (key, lengths, checksums) is shuffled.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm import common
from karstflow.llm.common import lean

#: Documents of a group, about.
GROUP = 16384
#: Equal documents that go to one group together, at most.
COPIES = 4096
#: Chunks of text that a task remembers, about; 30 bytes each.
REMEMBERED = 1_000_000
#: Latin letters, or ASCII punctuation: one piece for the tokenizer. The capital I with dot has a longer lower case.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+|[!-/:-@\\[-`{-~]+")
#: A mark of tokens that end a word, in vocabularies that have one.
_END = "</w>"
#: What special tokens begin with.
_SPECIAL = b"<|"

# Classes of bytes: white space that chunks end at, ASCII letters, ASCII punctuation, others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 2


def _edges(ends: bool, split: bool) -> np.ndarray:
    """By class before * 4 + class after: whether a chunk begins (or ends) between. split: also between letter and punctuation."""
    cut = lambda p, c: split and (p, c) == (1, 2)
    return np.array([(p != 0 and (c == 0 or cut(p, c))) if ends else (c != 0 and (p == 0 or cut(p, c))) for p in range(4) for c in range(4)])


class Encoder:
    """Ids of texts, for a tokenizer that lower-cases, drops white space, splits at it and between letters and punctuation,
    and marks the last token of each piece.

    Texts are cut into chunks at such places, on bytes and many texts at once. Each new chunk is encoded once; known ones
    are found by 64-bit hash in sorted arrays, and their ids are gathered from one pool.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for x, n in vocabulary.items() if x.endswith(_END)]] = True
        self.forget()

    def forget(self) -> None:
        """Gives back what was remembered."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.first, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> np.ndarray:
        """The slots of new chunks. Those that are one piece are encoded many at once, and parted where a token ends a word."""
        ids, sizes = [], np.zeros(len(chunks), np.int64)
        plain = [k for k, c in enumerate(chunks) if (c.isascii() and c.isalpha()) or _PLAIN.fullmatch(c)]
        rest = np.ones(len(chunks), bool)
        order = []
        for k in range(0, len(plain), 500):
            part = plain[k : k + 500]
            found = np.array(self._encoded([" ".join([chunks[x] for x in part])])[0], np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(found):
                sizes[part] = np.diff(cuts, prepend=0)
                rest[part] = False
                ids.append(found)
                order += part
        other = np.flatnonzero(rest).tolist()
        for k, found in zip(other, self._encoded([chunks[k] for k in other]), strict=True):
            sizes[k] = len(found)
            ids.append(np.array(found, np.uint32))
        order += other
        first = np.zeros(len(chunks), np.int64)
        first[order] = len(self.pool) + np.cumsum(sizes[order]) - sizes[order]
        self.pool = np.concatenate([self.pool, *ids])
        slots = len(self.first) + np.arange(len(chunks))
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, sizes])
        up = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[up])
        self.keys, self.slots = np.insert(self.keys, at, keys[up]), np.insert(self.slots, at, slots[up])
        return slots

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        up = np.argsort(keys)  # a search in ascending order stays in the cache
        at = np.empty(len(keys), np.int64)
        at[up] = np.minimum(np.searchsorted(self.keys, keys[up]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def ids(self, column: pa.Array):
        """The ids of each text as little-endian 32-bit bytes. A null text has none."""
        data, ends = common.utf8(column)
        for i, j in common.blocks(ends):
            buffer, starts = common.spaced(data, ends, i, j, 32)
            if len(self.keys) > REMEMBERED:
                self.forget()
            special = _SPECIAL in buffer.tobytes()  # such a block is cut at white space only, and keeps its case
            low = buffer if special else common.lowered(buffer)
            kind = _CLASS[buffer]
            pair = np.empty(len(kind), np.uint8)
            pair[0], pair[1:] = kind[0], kind[:-1] * 4 + kind[1:]
            begin, end = np.flatnonzero(_edges(False, not special)[pair]), np.flatnonzero(_edges(True, not special)[pair])
            code, keys = pd.factorize(common.hashed(low, begin, end))
            slots = self._found(keys)
            new = np.flatnonzero(slots < 0)
            if len(new):
                where = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))[new]
                slots[new] = self._learn(keys[new], [low[a:b].tobytes().decode() for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
            slots = slots[code]
            size = self.length[slots]
            total = np.concatenate([[0], np.cumsum(size)])
            found = self.pool[np.repeat(self.first[slots] - total[:-1], size) + np.arange(total[-1])].astype("<u4").tobytes()
            cuts = (4 * total[np.searchsorted(begin, starts)]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield found[a:b]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(path: str, end_id: int, length: int):
    end = np.array([end_id], "<u4").tobytes()

    @lean
    def run(batches):
        own = encoder(path)
        for batch in batches:
            keys, total, sums = batch.column(0), [], []
            for ids in own.ids(batch.column(1)):
                ids += end
                total.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[k : k + 4 * length]) for k in range(0, len(ids), 4 * length)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(total, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "sums"])
        own.forget()  # workers wait for other tasks with what they hold

    return run


class Tournament:
    """Bins with room, and the first of them with at least some room. Bins are opened as needed."""

    def __init__(self, most: int, room: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.best = [room] * (2 * self.size)

    def take(self, need: int) -> int:
        """The first bin with room for `need`, whose room shrinks by it."""
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        bin_, best[at] = at - self.size, best[at] - need
        while at > 1:
            at >>= 1
            best[at] = max(best[2 * at], best[2 * at + 1])
        return bin_


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size, at most `room` each; the longest first, equal ones in the order given."""
    tree, filled = Tournament(max(1, len(sizes)), room), {}
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[k])
        b = tree.take(need)
        bins[k], offsets[k] = b, filled.get(b, 0)
        filled[b] = int(offsets[k]) + need
    return bins, offsets


def _packed(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = int(group["group"].iloc[0]) << 40
        group = group.loc[group.index.repeat(group["copies"])]
        rests = group[group["length"] < length].sort_values(["doc_id", "doc_tokens", "ids_crc32"], kind="stable")
        whole = group[group["length"] == length].sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(rests["length"].to_numpy(), length)
        open_ = int(bins.max()) + 1 if len(bins) else 0
        rests = rests.assign(sequence_id=first + bins, offset=offsets)
        whole = whole.assign(sequence_id=first + open_ + np.arange(len(whole)), offset=0)
        return pd.concat([rests, whole])[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document.

    tokenizer: the path of a `tokenizers` file, the same on every machine, of a kind that drops white space. Each id
    lies in one piece; sequences hold at most `length` ids, gapless from offset 0. A null text is empty, and an empty
    one has its end id alone. Repeated rows are packed each for itself; null keys are kept; an empty table gives an empty
    result; other columns are ignored. A document of n ids costs n / length rows, whatever its length; a group holds
    about `group` documents, however many there are, have one key or are equal. Rests of one length (a tie) go by key.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    groups = max(1, -(-rows.count() // group))
    cut = rows.mapInArrow(_cut(tokenizer, end_id, length), "doc_id long, doc_tokens long, sums array<long>")
    kinds = cut.groupBy("doc_id", "doc_tokens", "sums").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    pieces = kinds.select(
        "doc_id",
        "doc_tokens",
        F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("long").alias("copies"),
        F.pmod(F.xxhash64("doc_id", "doc_tokens", "sums", "part", F.lit(3)), F.lit(groups)).alias("group"),
        F.posexplode("sums").alias("k", "ids_crc32"),
    )
    pieces = pieces.select(
        "doc_id",
        "doc_tokens",
        "copies",
        "group",
        "ids_crc32",
        (F.col("k") * F.lit(length).cast("long")).alias("start"),
        F.least(F.lit(length).cast("long"), F.col("doc_tokens") - F.col("k") * F.lit(length)).alias("length"),
    )
    return pieces.groupBy("group").applyInPandas(_packed(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
