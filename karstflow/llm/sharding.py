"""Sharding by jump consistent hashing (native: column expressions only).

jump_shard() is the published jump consistent hash of Lamping and Veach: a key's 64-bit linear congruential sequence
names the shard counts at which the key would move, and the last one below the shard count is its shard. There is no
ring table, and one more shard takes rows only into itself. Spark's checked arithmetic forbids a wrapping 64-bit
product, so the generator runs on four limbs of 16 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstflow.llm.quality_rules import let

#: The multiplier of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Rows of a shard are numbered within this many parts, by hash, so that no task numbers a whole shard.
PARTS = 1024
#: Equal rows that one row stands for when it is written out, at most.
COPIES = 1 << 16


def _limbs(x: int) -> list[int]:
    return [x >> s & 0xFFFF for s in (0, 16, 32, 48)]


def _next(limbs: list[Column]) -> list[Column]:
    """x -> x * MULTIPLIER + 1 modulo 2 ** 64, lowest limb first."""
    m, out, carry = _limbs(MULTIPLIER), [], F.lit(1).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + limbs[i] * F.lit(m[k - i]).cast("long")
        out.append(total.bitwiseAND(F.lit(0xFFFF).cast("long")))
        carry = F.shiftright(total, 16)
    return out


def _split(key: Column) -> list[Column]:
    return [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]


def _known(key: Column) -> Column:
    """A null key counts as -1."""
    return F.coalesce(key.cast("long"), F.lit(-1).cast("long"))


def _jumped(key: Column, shards: int) -> Column:
    """b, the shard, and j, the first number of shards at which the key leaves it."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(_split(_known(key)))], F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        limbs = _next([s[f"k{i}"] for i in range(4)])
        top = F.shiftleft(limbs[3], 15) + F.shiftright(limbs[2], 1) + F.lit(1)
        jumped = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / top.cast("double"))).cast("long")
        moved = F.struct(*[limbs[i].alias(f"k{i}") for i in range(4)], s["j"].alias("b"), jumped.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    # j grows with every step, so that `shards` steps always reach the end; about log(shards) are enough for most keys
    first = min(shards, 2 + 2 * shards.bit_length())
    steps = lambda s, a, b: F.aggregate(F.sequence(F.lit(a), F.lit(b)), s, step)
    if first == shards:
        return steps(start, 1, shards)
    return let(steps(start, 1, first), lambda s: F.when(s["j"] < shards, steps(s, first + 1, shards)).otherwise(s))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards-1, of a 64-bit key. A null key counts as -1."""
    return _jumped(key, shards)["b"].cast("int")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard by its key alone, its place in the shard, and its shard if there were one more.

    Returns doc_id (the key), size (UTF-8 bytes plus 1; a null text has none), text_crc32 (0 for a null text), law,
    shard, slot (0, 1, ... in each shard), grown_shard. Null keys count as -1, repeated keys go to one shard and get
    different slots, equal rows in any order (a tie); an empty table gives an empty result; of a text of any length
    only size and checksum go on; other columns are ignored.

    Slots go by part, key, checksum and size. A part is a hash of key and checksum modulo PARTS: keys with a common
    residue spread, and so do rows that share one key. Equal rows are counted first and written out last, COPIES at a time.
    The parts' counts, at most shards * PARTS rows and so safe to broadcast, are summed up to offsets.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    mixed = F.shiftright(_next(_split(_known(F.col("doc_id"))))[3], 6)
    kinds = kinds.withColumn("jump", _jumped(F.col("doc_id"), shards)).select(
        "doc_id",
        "size",
        "text_crc32",
        "n",
        F.col("jump.b").cast("int").alias("shard"),
        F.when(F.col("jump.j") == shards, F.lit(shards)).otherwise(F.col("jump.b")).cast("int").alias("grown_shard"),
        F.pmod(mixed + F.col("text_crc32"), F.lit(PARTS)).cast("int").alias("part"),
    )
    counts = kinds.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "part"])
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text_crc32", "chunk")
    own = F.sequence(F.col("chunk") * COPIES, F.least(F.col("n"), (F.col("chunk") + 1) * COPIES) - 1)
    return placed.withColumn("nth", F.explode(own)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at") + F.col("nth")).alias("slot"), "grown_shard"
    )
