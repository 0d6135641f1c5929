"""Near-duplicate documents: MinHash bands, signature and full-set verification, star-wise components.

1. One scan gives each document its set of word shingles (64-bit hashes), a digest of the set, and the minima of many
   universal hashes a*x+b (the signature). Equal sets make one class with one representative; only those go on, under a
   number of their own, as ids may be null or repeated. Full sets are made of the texts of those with a possible partner.
2. Bands of ROWS minima are bucket keys. As many bands are used as make a pair at the threshold miss all of them with a
   chance under MISS. Each member of a bucket is noted with the bucket's smallest id, its leader: notes grow with rows, not
   with their square, and all members of a bucket share its leader.
3. A leader's group is cut into chunks of about BLOCK members. In a chunk, pairs whose signatures agree enough (again, a
   pair at the threshold fails with a chance under MISS) are compared on full sets, but only while they are in different
   components; what passes is a link. components() joins the links of all chunks.
4. Groups of several chunks that still hold several components are searched on: each member outside the leader's
   component meets, block by block, all members of other components. So nothing is left out, no task holds more than two
   blocks, and a chunk gives fewer links than it has members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm import common
from karstflow.llm.common import addressed, joined, lean, scanned, sieve, stored, without
from karstflow.operators.graph import components

ROWS = 4
MISS = 1e-9
BLOCK = 512
_LEAST = -(1 << 63)

#: Bytes of a word: all but the space and the control characters 9 to 13.
IN_WORD = np.ones(256, bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False


def bands_for(num: int, den: int) -> int:
    """Bands of ROWS minima that a pair of similarity num / den misses with a chance under MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(0.999999, num / den) ** ROWS)))


def least_agreement(hashes: int, num: int, den: int) -> int:
    """The number of equal minima, of `hashes`, under which a pair of similarity num / den falls with a chance under MISS."""
    p, tail, k = num / den, 0.0, 0
    while k <= hashes:
        tail += math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if tail > MISS:
            break
        k += 1
    return k


def _universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7919)
    a = draw.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, draw.integers(0, 1 << 32, hashes, dtype=np.uint32)


def _signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(least, (x[k : k + 4096, None] * a + b).min(axis=0), out=least)
    return least


def _sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text. Fewer than `size` words make one shingle, none make none."""
    data, ends = common.utf8(column)
    for i, j in common.blocks(ends):
        buffer, starts = common.spaced(data, ends, i, j, 32)
        hashes, firsts = common.words(buffer, starts, IN_WORD)
        for k in range(j - i):
            own = hashes[firsts[k] : firsts[k + 1]]
            yield np.unique(common.shingled(own, min(size, len(own)) or 1))


def _signed(size: int, hashes: int):
    a, b = _universal(hashes)

    @lean
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch[k : k + 2000]
                counts, classes, signs = [], [], []
                for found in _sets(part.column(1), size):
                    counts.append(len(found))
                    classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    signs.append(_signature(found, a, b).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(signs, pa.binary())], names=["id", "f", "r", "n", "class", "sig"]
                )

    return run


def _full(size: int, hashes: int):
    a, b = _universal(hashes)

    @lean
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch[k : k + 500]
                found = list(_sets(part.column(1), size))
                signs = pa.array([_signature(x, a, b).tobytes() if len(x) else None for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), signs, pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "sig", "set"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """The signatures of a batch, one a row."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint32).reshape(len(column), -1) if data else np.zeros((0, ROWS), np.uint32)


@lean
def _banded(batches):
    for batch in batches:
        sig = _matrix(batch.column(1)).astype(np.uint64)
        ids = batch.column(0)
        n, h = sig.shape
        for k in range(h // ROWS if n else 0):
            key = np.full(n, k, np.uint64)
            for r in range(ROWS):
                key = common.mixed(key * np.uint64(0x9FB21C651E98DF25) + sig[:, k * ROWS + r])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["band", "id"])


def _searched(least: int, num: int, den: int):
    """Links between the left and the right rows of a block that join components which the block doesn't know as one."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps = np.array(table["id"]), table["comp"].to_pylist()
        left, right = np.array(table["left"]), np.array(table["right"])
        both_sides, right = left & right, np.flatnonzero(right)
        sig = _matrix(table["sig"].combine_chunks())
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        lengths = np.array([len(x) for x in sets])
        words, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        mark = np.zeros(len(words), bool)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        a, b = [], []
        for k in np.flatnonzero(left).tolist():
            # a pair of rows that are both left and right is looked at once
            others = right[(right > k) | ~left[right]] if both_sides[k] else right
            others = others[(sig[others] == sig[k]).sum(axis=1) >= least]
            own = root(comps[k])
            others = [x for x in others.tolist() if root(comps[x]) != own]
            if not others:
                continue
            mark[codes[ends[k] : ends[k + 1]]] = True
            for x in others:
                there = root(comps[x])
                if there == root(own):
                    continue
                both = int(np.count_nonzero(mark[codes[ends[x] : ends[x + 1]]]))
                if den * both >= num * (int(lengths[k]) + int(lengths[x]) - both):
                    a.append(ids[k])
                    b.append(ids[x])
                    parent[there] = root(own)
            mark[codes[ends[k] : ends[k + 1]]] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _grouped(docs: DataFrame, shingle: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """id (_LEAST for a null one), (f, r) (the row's address), n, component (the smallest id of the component), one (whether
    the row is the one that stays of its component; true for empty sets) for each row of docs."""
    hashes = bands_for(num, den) * ROWS
    least = least_agreement(hashes, num, den)
    rows = addressed(docs, id=F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LEAST)), text=F.col(f"`{text}`"))
    signed = stored(rows.select("id", "text", "f", "r").mapInArrow(_signed(shingle, hashes), "id long, f long, r long, n long, class binary, sig binary"), "signed")
    classes = signed.where("n > 0").groupBy("class").agg(F.min(F.struct("id", "f", "r", "sig")).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("class", F.monotonically_increasing_id().alias("node"), F.col("x.id").alias("least"), "x.f", "x.r", "x.sig", "copies"), "reps")
    reps = classes.select(F.col("node").alias("id"), "sig")

    banded = reps.mapInArrow(_banded, "band long, id long")
    crowded = banded.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    noted = stored(banded.join(crowded, "band").where("id > a").select("a", "id").distinct(), "noted")
    heads = stored(noted.groupBy("a").agg((F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("chunks")), "heads")
    wanted = noted.select("id").union(noted.select("a")).distinct()
    wanted = stored(classes.join(wanted, classes["node"] == wanted["id"], "left_semi").select("node", "f", "r"), "wanted")
    texts = rows.where(sieve(wanted, "f", "r")).join(wanted.hint("shuffle_hash"), ["f", "r"]).select("node", "text")
    sets = stored(texts.mapInArrow(_full(shingle, hashes), "id long, sig binary, set binary"), "sets").where("sig is not null")

    members = noted.join(heads, "a").select("a", "id", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"))
    leaders = heads.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    sides = [F.lit(True).alias("left"), F.lit(True).alias("right")]
    placed = members.union(leaders).join(sets, "id").select("a", "chunk", "id", F.col("id").alias("comp"), "sig", "set", *sides)
    search = _searched(least, num, den)
    links = stored(placed.groupBy("a", "chunk").applyInArrow(search, "a long, b long"), "links")
    linked = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "linked")

    large = heads.where("chunks > 1").select("a")
    groups = stored(members.union(leaders).select("a", "id").distinct().join(large, "a"), "groups")
    split = _unsettled(groups, linked, sets, search)
    if split is not None:
        links = links.union(stored(split, "more"))
        linked = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = linked.join(classes.select(F.col("node").alias("id"), "least"), "id").select("id", "component", F.struct("least", F.col("id").alias("node")).alias("x"))
    tops = named.groupBy("component").agg(F.min("x").alias("top"))
    tops = named.join(tops, "component").select(F.col("id").alias("node"), "top")
    labels = classes.join(tops, "node", "left").select(
        "class", "copies", F.coalesce("top.least", "least").alias("component"), (F.coalesce("top.node", "node") == F.col("node")).alias("top"), F.col("f").alias("rep_f"), F.col("r").alias("rep_r")
    )
    labels = stored(labels, "labels")
    full = joined(signed.where("n > 0").select("id", "f", "r", "n", "class"), labels, ["class"], "copies", signed.count())
    full = full.select("id", "f", "r", "n", "component", (F.col("top") & (F.col("f") == F.col("rep_f")) & (F.col("r") == F.col("rep_r"))).alias("one"))
    return full.union(signed.where("n = 0").select("id", "f", "r", "n", F.col("id").alias("component"), F.lit(True).alias("one")))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Words are runs of other characters than the space and 9 to 13, A-Z lower-cased; a document's set is its distinct
    runs of `shingle` words, or its whole word sequence if shorter. Documents are linked if den * intersection >=
    num * union. component_id is the smallest doc_id reachable over links, kept tells whether that is the row's own.

    Empty and null texts have n_shingles 0 and are linked with nothing. Rows that share an id, or
    have none, are documents of their own, which may bear one component_id unlinked; equal rows come out as often as they
    came in. A null id counts as smaller than all others. An empty table gives an empty
    result; other columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    found = _grouped(docs, shingle, num, den, key, text)
    null = lambda x: F.nullif(F.col(x), F.lit(_LEAST))
    return found.select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _unsettled(groups: DataFrame, linked: DataFrame, sets: DataFrame, search) -> DataFrame | None:
    """Links (a, b) between the components that are left in each leader's group (a, id; the leader's own row included);
    None if no group holds several.

    Members outside the leader's component (minor) look, from their own block i, at every block j: the minor ones (0 to
    m-1), then those of the leader's component (m to m+l-1).
    """
    named = stored(groups.join(linked, "id", "left").select("a", "id", F.coalesce("component", "id").alias("comp")), "named")
    lead = named.where("id = a").select("a", F.col("comp").alias("lead"))
    rows = named.join(lead, "a").withColumn("minor", F.col("comp") != F.col("lead"))
    sizes = rows.groupBy("a").agg(F.count_if("minor").alias("m"), F.count_if(~F.col("minor")).alias("l")).where("m > 0")
    rows = stored(rows.join(sizes, "a").select("a", "id", "comp", "minor", "m", "l"), "unsettled")
    if not rows.head(1):
        return None
    cut = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), cut("m")).otherwise(cut("l"))).cast("int")
    placed = rows.select("a", "id", "comp", "minor", own.alias("own"), cut("m").alias("m"), cut("l").alias("l"))
    at = lambda i, j, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    me, m = F.col("own"), F.col("m")
    looks = F.transform(F.sequence(F.lit(0), m + F.col("l") - 1), lambda j: at(me, j, True, False))
    every = F.sequence(F.lit(0), m - 1)
    seen = F.when(F.col("minor"), F.concat(looks, F.transform(every, lambda i: at(i, me, False, True)))).otherwise(F.transform(every, lambda i: at(i, m + me, False, True)))
    spread = placed.select("a", "id", "comp", F.explode(seen).alias("s")).select("a", "id", "comp", "s.*")
    return spread.join(sets, "id").groupBy("a", "i", "j").applyInArrow(search, "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of linked documents one row, one with the
    smallest id (null the smallest; of several rows with that id any one, a tie), and all rows without words.

    Rows are told apart by their address, so that repeated rows and ids count each for itself. An empty table gives an
    empty result. Rows that go are shuffled with their texts to be left out, others only where a Bloom filter of those
    can't tell them apart.
    """
    docs = scanned(docs)
    gone = stored(_grouped(docs, shingle, num, den, key, text).where("not one").select("f", "r"), "gone")
    return without(docs, gone)
