"""Quality of communities(id, comm) against ground truth(comm_id, node[, rank]); communities don't overlap, truth may."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(communities: DataFrame, truth: DataFrame) -> DataFrame:
    """comm_id, exact, included: whether a truth community is a community, or lies inside one.

    As communities don't overlap, one lies inside another exactly if all its members are known and in one community; it
    is that community if their sizes agree too.
    """
    sizes = communities.groupBy("comm").agg(F.count(F.lit(1)).alias("size"))
    rows = truth.select("comm_id", "node").distinct().join(communities, F.col("node") == F.col("id"), "left")
    one = rows.groupBy("comm_id").agg(F.count(F.lit(1)).alias("n"), F.count("comm").alias("known"), F.min("comm").alias("comm"), F.max("comm").alias("other"))
    inside = (F.col("n") == F.col("known")) & (F.col("comm") == F.col("other"))
    found = one.join(sizes, "comm", "left")
    return found.select("comm_id", F.coalesce(inside & (F.col("size") == F.col("n")), F.lit(False)).alias("exact"), F.coalesce(inside, F.lit(False)).alias("included"))


def accuracy(communities: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: total, exact_correct, exact_accuracy, inclusion_correct, inclusion_accuracy (percent; 0 without truth)."""
    rows = matches(communities, truth).agg(F.count(F.lit(1)).alias("total"), F.count_if("exact").alias("exact_correct"), F.count_if("included").alias("inclusion_correct"))
    percent = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0)
    return rows.select("total", "exact_correct", percent("exact_correct").alias("exact_accuracy"), "inclusion_correct", percent("inclusion_correct").alias("inclusion_accuracy"))


def labels(truth: DataFrame) -> DataFrame:
    """node, label: one truth community a node, the last one by rank (by comm_id if there is no rank)."""
    rank = "rank" if "rank" in truth.columns else "comm_id"
    return truth.groupBy("node").agg(F.max_by("comm_id", rank).alias("label"))


def contingency(communities: DataFrame, truth: DataFrame) -> DataFrame:
    """label, comm, n: nodes that have both."""
    rows = labels(truth).join(communities, F.col("node") == F.col("id"))
    return rows.groupBy("label", "comm").agg(F.count(F.lit(1)).alias("n"))


def purity(communities: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: purity, the largest label's share of each community, over all labelled nodes (those without a community
    included); 0 without any."""
    best = contingency(communities, truth).groupBy("comm").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hit"))
    total = truth.agg(F.countDistinct("node").alias("total"))
    return best.crossJoin(total).select(F.when(F.col("total") > 0, F.col("hit") / F.col("total")).otherwise(0.0).alias("purity"))


def _pairs(n) -> F.Column:
    return n.cast("double") * (n - 1) / 2


def agreement(communities: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: nmi (natural logarithm, normalised by the mean entropy) and ari (pair counts), over nodes with both a
    label and a community. Both are 1 if there is one cluster on either side, or no node."""
    table = contingency(communities, truth)
    n = F.col("n")
    rows = table.groupBy("label").agg(F.sum("n").alias("n"))
    columns = table.groupBy("comm").agg(F.sum("n").alias("n"))
    side = lambda t, name: t.agg(F.sum(n * F.log(n.cast("double"))).alias("l" + name), F.sum(_pairs(n)).alias("p" + name), F.count(F.lit(1)).alias("c" + name))
    cells = table.agg(F.sum("n").alias("t"), F.sum(n * F.log(n.cast("double"))).alias("l"), F.sum(_pairs(n)).alias("p"))
    x = cells.crossJoin(side(rows, "r")).crossJoin(side(columns, "c"))  # one row each
    t = F.col("t").cast("double")
    # entropies and mutual information from sums of n log n
    hr, hc = F.log(t) - F.col("lr") / t, F.log(t) - F.col("lc") / t
    mutual = F.greatest(F.lit(0.0), F.log(t) + (F.col("l") - F.col("lr") - F.col("lc")) / t)
    alone = F.coalesce((F.col("cr") <= 1) & (F.col("cc") <= 1), F.lit(True))
    nmi = F.when(alone | (t <= 1), 1.0).when((F.col("cr") == 1) | (F.col("cc") == 1), 0.0).otherwise(mutual / ((hr + hc) / 2))
    chance = F.col("pr") * F.col("pc") / _pairs(t)
    mean = (F.col("pr") + F.col("pc")) / 2
    ari = F.when(alone | (t <= 1), 1.0).when(mean == chance, 1.0).otherwise((F.col("p") - chance) / (mean - chance))
    return x.select(nmi.alias("nmi"), ari.alias("ari"))


def average_degree(degree: DataFrame) -> DataFrame:
    """One row: avg_degree, 0 for an empty table."""
    return degree.agg(F.coalesce(F.avg("k"), F.lit(0.0)).alias("avg_degree"))


def n_communities(communities: DataFrame) -> DataFrame:
    return communities.agg(F.countDistinct("comm").alias("n_communities"))


def summary(communities: DataFrame, truth: DataFrame, degree: DataFrame) -> DataFrame:
    """One row with all of the above."""
    parts = (accuracy(communities, truth), purity(communities, truth), agreement(communities, truth), average_degree(degree), n_communities(communities))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out
