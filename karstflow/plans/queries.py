"""The engine's operators as queries over the star-schema tables.

The tables hold no graph; customers who bought the same part from the same supplier make one (`cobuyers`), of all orders and
line items. Rounded values are compared to ten digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstflow.functions import windows
from karstflow.functions.shared import stored
from karstflow.operators import graph, interactions, metrics, reporting, update
from karstflow.plans.communities import Parameters, detect
from karstflow.sources import edges as sources

#: Distances are fractions that three decimals rarely meet; a vertex's component under FINER is part of the one under THRESHOLD.
THRESHOLD, FINER = 0.859, 0.839
LAMBDA = 0.5
#: A short ring, so that it is full at the third step.
SHORT, SUPPORT = 3, 0.5


def rounded(x: Column, digits: int = 10) -> Column:
    return F.round(x, digits) + F.lit(0.0)  # no negative zero; so many digits that no fraction ends between two values


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, both ways, with loops and copies: customers who bought the same part from the same supplier."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(orders, "l_orderkey").select("l_partkey", "l_suppkey", F.col("o_custkey").alias("src"))
    return bought.join(bought.withColumnRenamed("src", "dst"), ["l_partkey", "l_suppkey"]).select("src", "dst")


def cobuyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v: distinct edges, u > v. Halving the self-join before the distinct keeps loops and reversals out of it."""
    return pairs(spark, sf_dir).where("src > dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()


def _initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, u, v, ku, kv, d, win before the first step."""
    edges = graph.identified(cobuyers(spark, sf_dir))
    return stored(graph.with_degrees(graph.jaccard(edges), graph.degrees(edges)).withColumn("win", F.lit(0).cast("long")), "initial")


def _named(parts: DataFrame, state: DataFrame, name: str) -> DataFrame:
    """u, v, name of (eid, x) summed up."""
    total = interactions.summed(parts, "x")
    return state.join(total, "eid").select("u", "v", rounded(F.col("x")).alias(name))


def edges_canonical(spark, sf_dir):
    return graph.canonical(pairs(spark, sf_dir))


def edge_dedupe(spark, sf_dir):
    rows = pairs(spark, sf_dir).where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    return rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("copies"))


def vertices(spark, sf_dir):
    return graph.vertices(pairs(spark, sf_dir))


def degree(spark, sf_dir):
    return graph.degrees(cobuyers(spark, sf_dir))


def bidirectional(spark, sf_dir):
    return graph.both_ways(cobuyers(spark, sf_dir))


def star_graphs(spark, sf_dir):
    edges = cobuyers(spark, sf_dir)
    found = graph.stars(edges.withColumn("d", F.lit(0.5)), graph.degrees(edges))
    text = F.array_join(F.transform("neighbors", lambda n: F.concat(n["id"].cast("string"), F.lit(":"), n["degree"].cast("string"))), " ")
    return found.select("center", text.alias("neighbors"), F.col("degree").cast("long").alias("degree"))


def triangles(spark, sf_dir):
    return graph.triangles(cobuyers(spark, sf_dir))


def wedges(spark, sf_dir):
    found = graph.wedges(graph.identified(cobuyers(spark, sf_dir)))
    return found.select("mid", "a", "b", F.col("e_ab").isNotNull().alias("closed"))


def jaccard_init(spark, sf_dir):
    return graph.jaccard(cobuyers(spark, sf_dir)).select("u", "v", rounded(F.col("d")).alias("d"))


def vertex_weight_sum(spark, sf_dir):
    return interactions.weight_sums(graph.jaccard(cobuyers(spark, sf_dir))).select("id", rounded(F.col("s")).alias("s"))


def di(spark, sf_dir):
    state = _initial(spark, sf_dir)
    return _named(interactions.direct(state), state, "di")


def _arms(state: DataFrame) -> DataFrame:
    return interactions.armed(graph.wedges(state.select("eid", "u", "v")), state)


def ci(spark, sf_dir):
    state = _initial(spark, sf_dir)
    return _named(interactions.common(_arms(state)), state, "ci")


def theta(spark, sf_dir):
    state = _initial(spark, sf_dir)
    found = interactions.similarities(_arms(state), interactions.weight_sums(state))
    return found.select("a", "b", rounded(F.col("theta")).alias("theta"))


def rho(spark, sf_dir):
    state = _initial(spark, sf_dir)
    found = interactions.similarities(_arms(state), interactions.weight_sums(state))
    return found.select("a", "b", rounded(interactions.influence(F.col("theta"), LAMBDA)).alias("rho"))


def ei(spark, sf_dir):
    state = _initial(spark, sf_dir)
    return _named(interactions.exclusive(_arms(state), interactions.weight_sums(state), LAMBDA), state, "ei")


def delta(spark, sf_dir):
    state = _initial(spark, sf_dir)
    found = interactions.deltas(state, graph.wedges(state.select("eid", "u", "v")), LAMBDA)
    return state.join(found, "eid").select("u", "v", rounded(F.col("delta")).alias("delta"))


def hash_class(spark, sf_dir):
    return graph.vertices(pairs(spark, sf_dir)).select("id", graph.hash_class(F.col("id") - 1000, 7).alias("class"))


def equal_classes(spark, sf_dir):
    rows = cobuyers(spark, sf_dir).select("u", "v", *[graph.hash_class(x, 3).alias(n) for n, x in (("a", F.col("u")), ("b", F.col("v")), ("c", F.col("u") + F.col("v")))])
    return rows.select("u", "v", graph.equal_classes(F.col("a"), F.col("b"), F.col("c")).alias("equal"), graph.in_triple(F.col("a"), F.lit(0), F.col("b"), F.col("c")).alias("inside"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with an edge, given from the smaller end, and of a vertex with itself."""
    edges = cobuyers(spark, sf_dir)
    return edges.select(F.col("v").alias("a"), F.col("u").alias("b")).union(edges.select("u", "u")).distinct()


def distance_lookup(spark, sf_dir):
    return graph.distances(_asked(spark, sf_dir), graph.jaccard(cobuyers(spark, sf_dir))).select("a", "b", rounded(F.col("d")).alias("d"))


def weight_lookup(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("a", (F.col("b") + 1).alias("b"))
    return graph.weights(asked, graph.jaccard(cobuyers(spark, sf_dir))).select("a", "b", rounded(F.col("w")).alias("w"))


def triples_per_vertex(spark, sf_dir):
    return graph.triples(cobuyers(spark, sf_dir), 5)


def replica_normaliser(spark, sf_dir):
    return graph.replicas(cobuyers(spark, sf_dir), 8)


def replica_normaliser_common(spark, sf_dir):
    """Of each triangle."""
    return graph.triangles(cobuyers(spark, sf_dir)).select("x", "y", "z", graph.path_replicas(F.col("x"), F.col("y"), F.col("z"), 5).alias("copies"))


def replica_normaliser_exclusive(spark, sf_dir):
    """Of each open path of two edges."""
    found = graph.wedges(graph.identified(cobuyers(spark, sf_dir))).where("e_ab is null")
    return found.select("mid", "a", "b", graph.path_replicas(F.col("mid"), F.col("a"), F.col("b"), 5).alias("copies"))


def _grid(spark: SparkSession) -> DataFrame:
    """bits 0..7, bit 0/1, step 0..4."""
    return spark.range(80).select((F.col("id") % 8).alias("bits"), (F.floor(F.col("id") / 8) % 2).cast("int").alias("bit"), F.floor(F.col("id") / 16).cast("int").alias("step"))


def window_bit(spark, sf_dir):
    ring = windows.set_bit(F.col("bits"), F.col("step") % SHORT, F.col("bit"))
    return _grid(spark).select("bits", "bit", "step", ring.alias("ring"), windows.to_text(ring, SHORT).alias("text"), windows.from_text(windows.to_text(ring, SHORT)).alias("again"))


def window_rule_table(spark, sf_dir):
    rows = _grid(spark).withColumn("ring", windows.set_bit(F.col("bits"), F.col("step") % SHORT, F.col("bit")))
    rule = lambda name, support: windows.forced(F.lit(0.25), F.col("ring"), F.col("bit"), F.col("step"), SHORT, F.lit(support * SHORT), name)
    return rows.select("bits", "bit", "step", rule("compat", SUPPORT).alias("compat"), rule("symmetric", SUPPORT).alias("symmetric"), rule("compat", update.SINGLE_SUPPORT).alias("single"))


def _stepped(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    state = _initial(spark, sf_dir)
    arms = stored(graph.wedges(state.select("eid", "u", "v")), "wedges")
    for step in range(steps):
        state = stored(update.step_distributed(state, interactions.deltas(state, arms, LAMBDA), step, SHORT, SUPPORT), "state")
    return state


def update_step1(spark, sf_dir):
    return _stepped(spark, sf_dir, 1).select("u", "v", rounded(F.col("d")).alias("d"), "win")


def update_step3(spark, sf_dir):
    return _stepped(spark, sf_dir, 3).select("u", "v", rounded(F.col("d")).alias("d"), "win")


def active_count(spark, sf_dir):
    state = _stepped(spark, sf_dir, 1)
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if(interactions.active()).alias("active"))


def update_single_step1(spark, sf_dir):
    state = _initial(spark, sf_dir)
    found = interactions.deltas(state, graph.wedges(state.select("eid", "u", "v")), LAMBDA)
    done = update.step_single(update.handed_over(state, 0), found, SHORT)
    return done.select("u", "v", rounded(F.col("d")).alias("d"), "in_s", "moved", "win", "cnt")


def update_single_step2(spark, sf_dir):
    """The second step has weight sums without the edges that the first left where they were."""
    state = update.handed_over(_initial(spark, sf_dir), 0)
    arms = stored(graph.wedges(state.select("eid", "u", "v")), "wedges")
    for _ in range(2):
        state = stored(update.step_single(state, interactions.deltas(state, arms, LAMBDA, F.col("in_s")), SHORT), "state")
    return state.select("u", "v", rounded(F.col("d")).alias("d"), "in_s", "moved", "win", "cnt")


def _parts(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    """id, comm: components of the edges below a distance, numbered by their smallest vertex; all vertices."""
    edges = stored(graph.jaccard(cobuyers(spark, sf_dir)), "jaccard")
    ids = edges.select(F.explode(F.array("u", "v")).alias("id"))
    return stored(graph.numbered_components(graph.components(edges.where(F.col("d") < threshold), ids)), "parts")


def communities_threshold(spark, sf_dir):
    return _parts(spark, sf_dir, THRESHOLD)


def community_nodes(spark, sf_dir):
    found = sources.inverted(_parts(spark, sf_dir, THRESHOLD))
    return found.select("comm", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"))


def remap_ids(spark, sf_dir):
    edges = cobuyers(spark, sf_dir)
    mapping = graph.dense(edges.select(F.explode(F.array("u", "v")).alias("id")))
    return graph.remapped(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), mapping)


def remap_communities(spark, sf_dir):
    """Lines of parts by size, remapped to ranks over all parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    mapping = graph.dense(parts.select(F.col("p_partkey").alias("id")))
    lines = parts.groupBy("p_size").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string"))).alias("value"))
    found = graph.remapped_communities(lines, mapping, "p_size")
    return found.select("comm_id", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members"))


def graph_size(spark, sf_dir):
    edges = cobuyers(spark, sf_dir)
    return graph.size(edges, edges.select(F.explode(F.array("u", "v")).alias("id")))


def _finer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth that the components refine partly: those of a lower threshold."""
    return _parts(spark, sf_dir, FINER).select(F.col("comm").alias("comm_id"), F.col("id").alias("node"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("comm_id"), F.col("c_custkey").alias("node"))


def truth_matches(spark, sf_dir):
    return metrics.matches(_parts(spark, sf_dir, THRESHOLD), _finer(spark, sf_dir))


def accuracy(spark, sf_dir):
    found = metrics.accuracy(_parts(spark, sf_dir, THRESHOLD), _finer(spark, sf_dir))
    return found.select("total", "exact_correct", rounded(F.col("exact_accuracy")).alias("exact_accuracy"), "inclusion_correct", rounded(F.col("inclusion_accuracy")).alias("inclusion_accuracy"))


def purity(spark, sf_dir):
    return metrics.purity(_parts(spark, sf_dir, THRESHOLD), _nations(spark, sf_dir)).select(rounded(F.col("purity")).alias("purity"))


def nmi(spark, sf_dir):
    return metrics.agreement(_parts(spark, sf_dir, THRESHOLD), _nations(spark, sf_dir)).select(rounded(F.col("nmi")).alias("nmi"))


def ari(spark, sf_dir):
    return metrics.agreement(_parts(spark, sf_dir, THRESHOLD), _finer(spark, sf_dir)).select(rounded(F.col("ari")).alias("ari"))


def avg_degree(spark, sf_dir):
    return metrics.average_degree(graph.degrees(cobuyers(spark, sf_dir))).select(rounded(F.col("avg_degree")).alias("avg_degree"))


def n_communities(spark, sf_dir):
    return metrics.n_communities(_parts(spark, sf_dir, THRESHOLD))


def quality_summary(spark, sf_dir):
    edges = cobuyers(spark, sf_dir)
    found = metrics.summary(_parts(spark, sf_dir, THRESHOLD), _finer(spark, sf_dir), graph.degrees(edges))
    return found.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as resource samples: a run for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) + F.col("event_id") / 1000000.0
    share = lambda k: (F.col("event_id") * k % 1000 * 1048576).cast("long")
    return events.select(
        F.col("event_type").alias("run"),
        ts.cast("double").alias("ts"),
        (F.col("event_id") % 2 == 0).alias("single"),
        *[x for c, k in (("main", 7), ("java", 11), ("workers", 13)) for x in (share(k).alias(f"{c}_mem"), (F.col("event_id") * k % 101).cast("double").alias(f"{c}_cpu"))],
    )


def moving_average(spark, sf_dir):
    found = reporting.moving_average(_samples(spark, sf_dir), "main_cpu", "ts", ["run"])
    return found.select("run", rounded(F.col("ts"), 6).alias("ts"), rounded(F.col("smoothed")).alias("smoothed"))


def run_stats(spark, sf_dir):
    return reporting.run_statistics(_samples(spark, sf_dir), ["run"])


def resource_series(spark, sf_dir):
    found = reporting.resource_series(_samples(spark, sf_dir), ["run"], "single")
    return found.select("run", rounded(F.col("minute"), 6).alias("minute"), rounded(F.col("mem")).alias("mem"), rounded(F.col("cpu")).alias("cpu"))


def iteration_seconds(spark, sf_dir):
    found = reporting.iteration_seconds(_samples(spark, sf_dir).select("run", "ts"), ["run"])
    return found.select("run", rounded(F.col("ts"), 6).alias("ts"), F.round("seconds", 3).alias("seconds"))


def metrics_table(spark, sf_dir):
    """Markdown rows of the samples' runs, with made-up measures."""
    stats = reporting.run_statistics(_samples(spark, sf_dir), ["run"])
    title = reporting.test_title(F.col("run"), F.col("minutes") % 2 == 0, F.lit(5000), F.lit("0.5"), F.lit(8))
    rows = stats.select(title.alias("test"), "minutes", "mean_mem", "mean_cpu", F.length("run").alias("n_communities"), F.lit(84.14).alias("inclusion_accuracy"), *[F.lit(x).alias(c) for c, x in (("purity", 0.97751), ("nmi", 0.96), ("ari", 0.57984), ("avg_degree", 5.52994))])
    return reporting.markdown(rows)


def run_times(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.col("o_orderkey").cast("double")
    stamps = F.array(start + F.col("o_custkey"), start + 2 * F.col("o_custkey"))
    none = F.array().cast("array<double>")
    sm = F.col("o_custkey") % 2 == 0
    runs = orders.select(
        F.col("o_orderpriority").alias("dataset"), sm.alias("sm"), start.alias("start"), (start + F.col("o_totalprice")).alias("end"),
        F.when(sm, none).otherwise(stamps).alias("update_ts"), F.when(~sm, start + 1).alias("part_ts"), F.when(sm, stamps).otherwise(none).alias("sm_ts"),
    )
    found = reporting.run_times(runs)
    return found.select("dataset", "mode", rounded(F.col("total_minutes"), 6).alias("total_minutes"), rounded(F.col("first_minutes"), 6).alias("first_minutes"))


def folder_parse(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("ds_"), F.col("p_size").cast("string"), F.lit("_l0."), (F.col("p_partkey") % 10).cast("string"), F.lit("_w15_g5000_p"), F.col("p_size").cast("string"), F.lit("_sm"), F.when(F.col("p_partkey") % 2 == 0, "True").otherwise("False"))
    found = parts.select(F.col("p_partkey").alias("id"), sources.parse_folder(name).alias("x"))
    return found.select("id", "x.dataset", "x.l", "x.w", "x.g", "x.p", "x.sm")


def edge_list_parse(spark, sf_dir):
    """Lines of an edge list made of line items, with comments, blank and short lines among them."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey") % 7
    text = F.concat(F.col("l_partkey").cast("string"), F.when(k < 3, " ").otherwise("\t"), F.col("l_suppkey").cast("string"))
    line = F.when(k == 0, F.concat(F.lit("# "), text)).when(k == 1, F.lit("   ")).when(k == 2, F.col("l_partkey").cast("string")).when(k == 3, F.concat(F.lit("  "), text, F.lit(" 99 x"))).otherwise(text)
    return sources.parse_edges(items.select(line.alias("value"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("lines"))


def ground_truth_parse(spark, sf_dir):
    """Lines "brand part part ..." by size; of a brand's lines the last one counts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("brand", F.regexp_extract("p_brand", "([0-9]+)", 1))
    lines = parts.groupBy("brand", "p_size").agg(F.concat_ws("\t", F.col("brand"), F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), "\t")).alias("value"))
    return sources.parse_ground_truth(lines.withColumn("no", F.col("p_size") * 1000 + F.col("brand").cast("int")), "no").select("comm_id", "node")


def _run(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    found = detect(pairs(spark, sf_dir), Parameters(lam=LAMBDA, **more))
    return found.communities


def full_run(spark, sf_dir):
    return _run(spark, sf_dir)


def full_run_plan(spark, sf_dir):
    """The same by step plans, until no edge is active."""
    return _run(spark, sf_dir, engine="plan")


def full_run_gamma(spark, sf_dir):
    return _run(spark, sf_dir, gamma=100)


def full_run_single(spark, sf_dir):
    return _run(spark, sf_dir, mode="single")


def iteration_log(spark, sf_dir):
    found = detect(pairs(spark, sf_dir), Parameters(lam=LAMBDA, gamma=100))
    return spark.createDataFrame([(x["n"], x["phase"], x["step"], x["active"], x["total"]) for x in found.iterations], "n int, phase string, step int, active long, total long")


ALL = (
    edges_canonical, edge_dedupe, vertices, degree, bidirectional, star_graphs, triangles, wedges, jaccard_init, vertex_weight_sum, di, ci, theta, rho, ei, delta, hash_class, equal_classes, distance_lookup, weight_lookup, triples_per_vertex, replica_normaliser, replica_normaliser_common, replica_normaliser_exclusive, window_bit,
    window_rule_table, update_step1, update_step3, update_single_step1, update_single_step2, active_count, communities_threshold, community_nodes, remap_ids, remap_communities, graph_size, truth_matches, accuracy, purity, nmi, ari, avg_degree, n_communities, quality_summary,
    moving_average, run_stats, resource_series, iteration_seconds, run_times, metrics_table, folder_parse, edge_list_parse, ground_truth_parse, full_run, full_run_plan, full_run_gamma, full_run_single, iteration_log,
)
