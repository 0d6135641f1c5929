"""Undirected graphs as tables: edges(eid, u, v) with u > v, adjacency, degrees, wedges, triangles, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from karstflow.functions.shared import stored

#: Neighbours of a vertex that are paired with as many others in a task.
BLOCK = 1000


def canonical(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """u, v: the distinct edges with u > v. Self-loops go (their vertex stays, see vertices())."""
    return pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def vertices(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """id: every vertex that a pair names, those of self-loops included."""
    return pairs.select(F.explode(F.array(a, b)).alias("id")).distinct()


def identified(edges: DataFrame) -> DataFrame:
    """eid, u, v: edges with an id each, stored, so that the ids stay."""
    return stored(edges.select(F.monotonically_increasing_id().alias("eid"), "u", "v"), "edges")


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """src, dst and further columns: each edge in both directions."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), *more).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), *more))


def degrees(edges: DataFrame) -> DataFrame:
    """id, k: the number of neighbours."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))


def with_degrees(edges: DataFrame, deg: DataFrame) -> DataFrame:
    """edges and ku, kv."""
    ku, kv = deg.select(F.col("id").alias("u"), F.col("k").alias("ku")), deg.select(F.col("id").alias("v"), F.col("k").alias("kv"))
    return edges.join(ku, "u").join(kv, "v")


def stars(edges: DataFrame, deg: DataFrame) -> DataFrame:
    """center, neighbors (sorted array of id, d, degree), degree. edges: u, v, d."""
    rows = both_ways(edges, "d").join(deg.select(F.col("id").alias("dst"), "k"), "dst")
    star = rows.groupBy(F.col("src").alias("center")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("id"), "d", F.col("k").alias("degree")))).alias("neighbors"))
    return star.withColumn("degree", F.size("neighbors"))


def wedges(edges: DataFrame) -> DataFrame:
    """mid, a, b, e_ma, e_mb, e_ab: two edges that meet in `mid`, a < b; e_ab is null if a and b aren't neighbours.

    Each path of two edges comes once: the sum of k(k-1)/2 over vertices. A hub's neighbours are dealt to blocks of about
    BLOCK, and each two blocks meet under a key of their own, so that no key has more than BLOCK * BLOCK paths.
    """
    blocks = degrees(edges).select(F.col("id").alias("src"), F.ceil(F.col("k") / BLOCK).alias("n"))
    adj = both_ways(edges, "eid").join(blocks, "src").withColumn("own", F.pmod(F.xxhash64("dst"), "n"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    x = adj.select(F.col("src").alias("mid"), F.col("dst").alias("a"), F.col("eid").alias("e_ma"), F.col("own").alias("i"), every.alias("j"))
    y = adj.select(F.col("src").alias("mid"), F.col("dst").alias("b"), F.col("eid").alias("e_mb"), every.alias("i"), F.col("own").alias("j"))
    third = edges.select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("eid").alias("e_ab"))
    return x.join(y, ["mid", "i", "j"]).where("a < b").join(third, ["a", "b"], "left").select("mid", "a", "b", "e_ma", "e_mb", "e_ab")


def triangles(edges: DataFrame) -> DataFrame:
    """x < y < z, all neighbours, each once. Arms run from the end with fewer neighbours, so that a hub opens few."""
    deg = degrees(edges)
    e = with_degrees(edges.select("u", "v"), deg)
    low_first = (F.col("ku") < F.col("kv")) | ((F.col("ku") == F.col("kv")) & (F.col("u") < F.col("v")))
    arms = e.select(F.when(low_first, F.col("u")).otherwise(F.col("v")).alias("m"), F.when(low_first, F.col("v")).otherwise(F.col("u")).alias("t"))
    pairs = arms.select("m", F.col("t").alias("a")).join(arms.select("m", F.col("t").alias("b")), "m").where("a < b")
    closed = pairs.join(edges.select(F.col("v").alias("a"), F.col("u").alias("b")), ["a", "b"])
    s = F.sort_array(F.array("m", "a", "b"))
    return closed.select(s[0].alias("x"), s[1].alias("y"), s[2].alias("z"))


def jaccard(edges: DataFrame) -> DataFrame:
    """eid, u, v, d: d = 1 - common / all of the closed neighbourhoods, by common neighbours counted on wedges' ends.

    The closing edge is found by a join on both arms' ends, so that only triangles reach the count.
    """
    t = triangles(edges)
    sides = t.select(F.explode(F.array(F.struct(F.col("y").alias("u"), F.col("x").alias("v")), F.struct(F.col("z").alias("u"), F.col("x").alias("v")), F.struct(F.col("z").alias("u"), F.col("y").alias("v")))).alias("e"))
    shared = sides.groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("t"))
    rows = with_degrees(edges, degrees(edges)).join(shared, ["u", "v"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return rows.select(*edges.columns, (1 - (F.col("t") + 2) / (F.col("ku") + F.col("kv") - F.col("t"))).alias("d"))


def hash_class(id_: Column, parts: int) -> Column:
    """The class of a vertex modulo `parts`, never negative."""
    return F.pmod(id_, F.lit(parts))


def equal_classes(a: Column, b: Column, c: Column) -> Column:
    """How many of the three pairs of classes are equal: 0, 1 or 3."""
    return (a == b).cast("int") + (a == c).cast("int") + (b == c).cast("int")


def in_triple(x: Column, i: Column, j: Column, k: Column) -> Column:
    """Whether a class is in a triple of classes."""
    return (x == i) | (x == j) | (x == k)


def distances(pairs: DataFrame, edges: DataFrame, strict: bool = True) -> DataFrame:
    """a, b, d of pairs (a, b) in any order: 0 of a vertex to itself, else its edge's. A pair without an edge is an error;
    without `strict` it has null."""
    keyed = pairs.select("a", "b", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = keyed.join(edges.select("u", "v", "d"), ["u", "v"], "left")
    missing = F.raise_error(F.concat(F.lit("no edge "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return found.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).when(F.col("d").isNull(), missing).otherwise(F.col("d")).alias("d"))


def weights(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w of pairs: their edge's value, 0 if there is none or both are one vertex."""
    return distances(pairs, edges, strict=False).select("a", "b", F.coalesce("d", F.lit(0.0)).alias("w"))


def triples(edges: DataFrame, parts: int) -> DataFrame:
    """id, i, j, k: the sorted triples of classes, modulo parts >= 3, that a vertex's edges lie in."""
    if parts < 3:
        raise ValueError("parts must be at least 3")
    c = edges.select("u", "v", hash_class(F.col("u"), parts).alias("hu"), hash_class(F.col("v"), parts).alias("hv"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    one = F.flatten(F.transform(every, lambda a: F.transform(every, lambda b: F.when((a < b) & (a != F.col("hu")) & (b != F.col("hu")), F.array_sort(F.array(a, b, F.col("hu")))))))
    two = F.transform(every, lambda a: F.when((a != F.col("hu")) & (a != F.col("hv")), F.array_sort(F.array(a, F.col("hu"), F.col("hv")))))
    found = c.select("u", "v", F.explode(F.when(F.col("hu") == F.col("hv"), one).otherwise(two)).alias("t")).where("t is not null")
    return found.select(F.explode(F.array("u", "v")).alias("id"), "t").select("id", F.col("t")[0].alias("i"), F.col("t")[1].alias("j"), F.col("t")[2].alias("k")).distinct()


def replicas(edges: DataFrame, parts: int) -> DataFrame:
    """u, v, copies: the number of triples of classes that hold an edge."""
    same = hash_class(F.col("u"), parts) == hash_class(F.col("v"), parts)
    return edges.select("u", "v", F.when(same, F.lit((parts - 1) * (parts - 2) // 2)).otherwise(F.lit(parts - 2)).cast("long").alias("copies"))


def path_replicas(a: Column, b: Column, c: Column, parts: int) -> Column:
    """The number of triples of classes that hold three vertices: the triples with their one class, with their two, or theirs."""
    equal = equal_classes(*(hash_class(x, parts) for x in (a, b, c)))
    return F.when(equal == 3, F.lit((parts - 1) * (parts - 2) // 2)).when(equal == 1, F.lit(parts - 2)).otherwise(F.lit(1)).cast("long")


def components(edges: DataFrame, ids: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) of every id of the edges (u, v), and of `ids`, alone if no edge names it.

    Alternating large-star and small-star: each round is two grouped joins with partial aggregation before the shuffle,
    written to the shared folder. A vertex's neighbours are never gathered in a row.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    mark = None
    for _ in range(max_rounds):
        watch = Observation()  # counted while the round is written
        step = _small_star(_large_star(now)).observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
        now = stored(step, "star")
        seen = watch.get
        if seen == mark or not seen["n"]:
            break
        mark = seen
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    if ids is None:
        return found
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def dense(ids: DataFrame, column: str = "id", name: str = "new_id") -> DataFrame:
    """The distinct values of a column and their ranks 1, 2, ...

    A range-partitioned sort numbers each partition by itself; the partitions' counts, one number each, give the offsets,
    so that no task sees all rows.
    """
    spark = ids.sparkSession
    rows = stored(ids.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()), "ranks")
    counts = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    total, offsets = 0, []
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return rows.select(column, F.lit(0).cast("long").alias(name))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    table = spark.createDataFrame(offsets, "_p int, _offset long")
    return rows.join(F.broadcast(table), "_p").select(column, (F.col("_offset") + place).alias(name))


def numbered_components(found: DataFrame) -> DataFrame:
    """id, comm: components numbered 1, 2, ... by their smallest id."""
    ranks = dense(found.select("component"), "component", "comm")
    return found.join(ranks, "component").select("id", "comm")


def remapped(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """src, dst with both ids replaced by the mapping (id, new_id)."""
    a, b = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("s")), mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
    return pairs.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def remapped_communities(lines: DataFrame, mapping: DataFrame, number: str, line: str = "value") -> DataFrame:
    """comm_id, members (array, in the order given): lines of ids, numbered from 1 without blank ones, remapped. An id
    without a mapping is an error."""
    rows = lines.where(F.trim(line) != "").select(F.col(number).alias("_no"), F.split(F.trim(line), r"\s+").alias("_t"))
    ranks = dense(rows.select("_no"), "_no", "comm_id")
    parts = rows.join(ranks, "_no").select("comm_id", F.posexplode("_t").alias("pos", "_id")).withColumn("id", F.col("_id").cast("long"))
    found = parts.join(mapping, "id", "left")
    new = F.when(F.col("new_id").isNull(), F.raise_error(F.concat(F.lit("no such vertex: "), F.col("_id"))).cast("long")).otherwise(F.col("new_id"))
    return found.groupBy("comm_id").agg(F.sort_array(F.collect_list(F.struct("pos", new.alias("n")))).alias("m")).select("comm_id", F.transform("m", lambda x: x["n"]).alias("members"))


def size(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: n_vertices, n_edges, max_id."""
    return ids.agg(F.countDistinct("id").alias("n_vertices"), F.max("id").alias("max_id")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).select("n_vertices", "n_edges", "max_id")
