"""Benchmark decontamination with a distributed positional inverted index.

build_index() stores the postings of every word of the training documents. The index is cut by document: a segment is
one row that holds some megabytes of documents as a sorted list of terms (64-bit word hashes) with their positions, so
that building needs no shuffle and a query runs on all segments at once. The test items come in blocks of a proven size
(BLOCK_WORDS), each broadcast for a pass of its own over the stored index.

A window's postings are intersected from its rarest term in the segment on: the list of that term, shifted by the term's
place in the window, gives the candidate starts; the next rarest term's list thins them out, and so on to the last. What
is left is an exact phrase match. near_matches() asks instead that all terms of a window lie in one span of some words:
there rarity only chooses where to look, as each such span holds the rarest term too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm import common
from karstflow.llm.common import addressed, lean, scanned, stored, without

#: Words of test items that are broadcast at a time: 8 bytes each.
BLOCK_WORDS = 1 << 20
#: Bytes of text in a segment, unless one document has more.
SEGMENT_BYTES = 4 << 20
#: Candidate starts that are held at a time.
CANDIDATES = 1 << 20

#: Bytes of a word after A-Z is lower-cased: digits, a-z, and all bytes of other than ASCII characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

INDEX = "segment long, ids array<long>, fs array<long>, rs array<long>, starts binary, terms binary, lists binary, positions binary"


@lean
def _indexed(batches):
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, ends = common.utf8(batch.column(1))
        own = [batch.column(c) for c in (0, 2, 3)]
        for i, j in common.blocks(ends, SEGMENT_BYTES):
            hashes, firsts = common.words(*common.spaced(data, ends, i, j, 32), IN_WORD)
            order = np.argsort(hashes, kind="stable")
            terms, lists = np.unique(hashes[order], return_index=True)
            parts = (firsts.astype(np.int64), terms, np.append(lists, len(order)).astype(np.int64), order.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + k], pa.int64()), *[pa.array([x[i:j].to_pylist()], pa.list_(pa.int64())) for x in own], *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
                names=["segment", "ids", "fs", "rs", "starts", "terms", "lists", "positions"],
            )
            k += 1


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of every word of every document: a row for each segment. Null texts have no words. Each document
    is listed with its id and its row's address (f, r), as ids may be null or repeated."""
    rows = addressed(docs, id=F.col(f"`{key}`").cast("long"), text=F.col(f"`{text}`"))
    return stored(rows.select("id", "text", "f", "r").mapInArrow(_indexed, INDEX), "postings")


class _Segment:
    """A row of the index."""

    def __init__(self, starts: bytes, terms: bytes, lists: bytes, positions: bytes):
        self.starts = np.frombuffer(starts, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.lists = np.frombuffer(lists, np.int64)
        self.positions = np.frombuffer(positions, np.int32)
        #: (term number, position) of every posting as one sorted number
        self.postings = (np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.lists)) << 32) + self.positions

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Of the words' terms; -1 where the segment hasn't got the word."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def first(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first position of the term from the given one on; a very large number if there is none."""
        want = (term << 32) + np.maximum(position, 0)
        at = np.searchsorted(self.postings, want)
        found = self.postings[np.minimum(at, len(self.postings) - 1)]
        return np.where((at < len(self.postings)) & (found >> 32 == term), found & 0xFFFFFFFF, 1 << 40)


def _windows(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and item of every window of the items whose words begin at `firsts`."""
    n = np.diff(firsts)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), count)
    start = firsts[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    return start, np.minimum(n, size)[item], item


def _candidates(segment: _Segment, words: np.ndarray, start: np.ndarray, length: np.ndarray, size: int):
    """For windows all of whose words the segment has, in portions: the windows, their words' places by rarity, term
    numbers, and a candidate (window, position of its rarest word) for every posting of that word."""
    number = segment.numbers(words)
    often = np.where(number >= 0, np.diff(segment.lists)[np.maximum(number, 0)] if len(segment.terms) else 0, 0)
    place = np.arange(size)
    at = start[:, None] + np.minimum(place, length[:, None] - 1)  # a short window repeats its last word
    order = np.argsort(often[at], axis=1, kind="stable")
    at = np.take_along_axis(at, order, axis=1)
    rarest = often[at[:, 0]] if len(at) else np.zeros(0, np.int64)
    live = np.flatnonzero(rarest > 0)
    cuts = np.searchsorted(np.cumsum(rarest[live]), np.arange(CANDIDATES, rarest[live].sum() + CANDIDATES, CANDIDATES), "right")
    low = 0
    for high in [*dict.fromkeys(cuts.tolist()), len(live)]:
        high = max(high, low + 1)
        part = live[low:high]
        low = high
        if not len(part):
            break
        n = rarest[part]
        which = np.repeat(np.arange(len(part)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        position = segment.positions[segment.lists[number[at[part, 0]]][which] + nth].astype(np.int64)
        yield part, at[part], number, which, position


def _phrases(segment: _Segment, words: np.ndarray, start: np.ndarray, length: np.ndarray, size: int):
    """(windows, first positions) of all exact phrase matches inside one document."""
    for part, at, number, which, position in _candidates(segment, words, start, length, size):
        begin = position - (at[which, 0] - start[part][which])
        for r in range(1, size):
            where = at[which, r]
            want = begin + where - start[part][which]
            stay = (begin >= 0) & (segment.first(number[where], want) == want)
            which, begin = which[stay], begin[stay]
        doc = np.searchsorted(segment.starts, begin, "right") - 1
        inside = begin + length[part][which] <= segment.starts[np.minimum(doc + 1, len(segment.starts) - 1)]
        yield part[which[inside]], begin[inside], doc[inside]


def _near(segment: _Segment, words: np.ndarray, start: np.ndarray, length: np.ndarray, size: int, reach: int):
    """(windows, positions) of the words of a window in spans of reach + 1 words, inside one document, that hold all its
    words. Every such span holds the window's rarest word, so that only its surroundings are looked at."""
    for part, at, number, which, position in _candidates(segment, words, start, length, size):
        doc = np.searchsorted(segment.starts, position, "right") - 1
        low, high = np.maximum(segment.starts[doc], position - reach), np.minimum(segment.starts[doc + 1], position + reach + 1)
        for r in range(1, size):
            stay = segment.first(number[at[which, r]], low) < high
            which, doc, low, high = which[stay], doc[stay], low[stay], high[stay]
        found: dict[tuple[int, int], int] = {}
        for w, d, a, b in zip(which.tolist(), doc.tolist(), low.tolist(), high.tolist(), strict=True):
            terms = np.unique(number[at[w]])
            here = np.zeros((len(terms), b - a + 1), np.int64)  # how many of each term stand before a place
            for k, term in enumerate(terms):
                own = segment.positions[segment.lists[term] : segment.lists[term + 1]]
                here[k, own[np.searchsorted(own, a) : np.searchsorted(own, b)] - a + 1] = 1
            one = here[:, 1:].any(axis=0)
            here = here.cumsum(axis=1)
            span = min(reach + 1, b - a)
            whole = np.flatnonzero((here[:, span:] > here[:, : b - a - span + 1]).all(axis=0))
            edge = np.zeros(b - a + 1, np.int64)
            np.add.at(edge, whole, 1)
            np.add.at(edge, whole + span, -1)
            found.update({(w, a + x): d for x in np.flatnonzero((edge.cumsum()[:-1] > 0) & one).tolist()})
        if found:
            which, position = np.array(list(found), np.int64).T
            yield part[which], position, np.fromiter(found.values(), np.int64, len(found))


def _item_words(size: int, most: int):
    """Pieces of the items of about `most` words that hold each window of `size` words once."""

    @lean
    def run(batches):
        for batch in batches:
            data, ends = common.utf8(batch.column(1))
            for i, j in common.blocks(ends):
                hashes, firsts = common.words(*common.spaced(data, ends, i, j, 32), IN_WORD)
                row, own = [], []
                for k in range(j - i):
                    a, b = int(firsts[k]), int(firsts[k + 1])
                    for c in range(a, max(b - size + 1, a + 1), most):
                        row.append(i + k)
                        own.append(hashes[c : min(b, c + most + size - 1)].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(own, pa.binary())], names=["item", "words"])

    return run


def _query(shared, size: int, reach: int | None):
    @lean
    def run(batches):
        items, firsts, words = shared.value
        words, firsts = np.frombuffer(words, np.uint64), np.array(firsts)
        start, length, item = _windows(firsts, size)
        for batch in batches:
            for row in batch.to_pylist():
                segment = _Segment(row["starts"], row["terms"], row["lists"], row["positions"])
                found = list(_phrases(segment, words, start, length, size) if reach is None else _near(segment, words, start, length, size, reach))
                if not any(len(x[0]) for x in found):
                    continue
                window, begin, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(doc, kind="stable")
                window, begin, doc = window[order], begin[order], doc[order]
                docs, first = np.unique(doc, return_index=True)
                out = {"segment": [], "ord": [], "hits": [], "items": []}
                for d, low, high in zip(docs.tolist(), first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
                    long = length[window[low:high]] if reach is None else np.ones(high - low, np.int64)
                    edge = np.zeros(int((begin[low:high] + long).max() - segment.starts[d]) + 1, np.int64)
                    np.add.at(edge, begin[low:high] - segment.starts[d], 1)
                    np.add.at(edge, begin[low:high] + long - segment.starts[d], -1)
                    out["segment"].append(row["segment"])
                    out["ord"].append(d)
                    out["hits"].append(np.flatnonzero(np.cumsum(edge) > 0))
                    out["items"].append([items[k] for k in np.unique(item[window[low:high]]) if items[k] is not None])
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array(out["segment"], pa.int64()), "ord": pa.array(out["ord"], pa.int32()), "hits": pa.array(out["hits"], pa.list_(pa.int64())), "items": pa.array(out["items"], pa.list_(pa.string()))}
                )

    return run


def _dealt(items: DataFrame, size: int):
    """The items' (item, text) pieces in blocks of about BLOCK_WORDS words. Each piece is dealt by a number of its own, so
    that repeated ids spread, and has a sixteenth of a block at most, so that long items do."""
    own = stored(items.mapInArrow(_item_words(size, max(1, BLOCK_WORDS // 16)), "item string, words binary").withColumn("no", F.monotonically_increasing_id()), "items")
    total = own.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    n = max(1, -(-total // BLOCK_WORDS))
    for k in range(n):
        yield own.where(F.pmod(F.xxhash64("no"), F.lit(n)) == k).orderBy("item", "no").collect()


def _search(index: DataFrame, items: DataFrame, item_key: str, text: str, size: int, reach: int | None) -> DataFrame:
    """doc_id, f, r, n_words, hits (word numbers), items (ids as strings), for each document of the index."""
    spark = index.sparkSession
    own = items.select(F.col(f"`{item_key}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    found = None
    for rows in _dealt(own, size):
        firsts = np.cumsum([0, *[len(r["words"]) // 8 for r in rows]]).tolist()
        shared = spark.sparkContext.broadcast(([r["item"] for r in rows], firsts, b"".join(bytes(r["words"]) for r in rows)))
        one = index.select("segment", "starts", "terms", "lists", "positions").mapInArrow(_query(shared, size, reach), "segment long, ord int, hits array<long>, items array<string>")
        found = one if found is None else found.union(one)
    found = found.groupBy("segment", "ord").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    docs = index.select("segment", "ids", "fs", "rs", "starts").mapInArrow(_listed, "segment long, ord int, doc_id long, f long, r long, n_words long")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    return docs.join(found, ["segment", "ord"], "left").select("doc_id", "f", "r", "n_words", empty("hits", "long"), empty("items", "string"))


def _listed(batches):
    for batch in batches:
        for segment, ids, fs, rs, starts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, fs, rs, np.diff(np.frombuffer(starts, np.int64))))],
                names=["segment", "ord", "doc_id", "f", "r", "n_words"],
            )


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, hits, items for each indexed document: the numbers of its words that lie in an occurrence of
    `window` consecutive words of an item (of the whole item if it is shorter), and those items' ids as strings.

    Null and empty texts of either table have no words and match nothing; an item with a null id hits words like any
    other, but isn't listed; repeated rows are searched each for itself; empty tables give no hits. The hits of a document
    are at most its words, however long it and the items are.
    """
    return _search(index, items, item_key, text, window, None).drop("f", "r")


def near_matches(index: DataFrame, items: DataFrame, window: int = 10, reach: int = 20, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """As phrase_matches(), for proximity: hits are the words of a window that lie in a part of a document whose first and
    last words are at most `reach` places apart and which holds every word of the window, in any order. A word that the window
    has twice is asked for once. What a document has of hits depends on itself and the items alone."""
    return _search(index, items, item_key, text, window, reach).drop("f", "r")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated for each row of docs; see phrase_matches(), which
    says what null, empty, long and repeated rows give."""
    found = phrase_matches(build_index(docs, key, text), items, window, item_key, item_text)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("hits") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without a hit, with all their columns; see phrase_matches(). Rows are told apart by their address, so
    that rows that share an id, or have none, are judged each by its own text. An empty table gives an empty result."""
    docs = scanned(docs)
    hit = _search(build_index(docs, key, text), items, "item_id", "text", window, None).where(F.size("hits") > 0)
    return without(docs, stored(hit.select("f", "r"), "hit"))
