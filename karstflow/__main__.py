"""python -m karstflow run | evaluate | remap | report | monitor"""

from __future__ import annotations

import argparse
import contextlib
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from karstflow.functions import monitor
from karstflow.functions.shipping import ship
from karstflow.operators import graph, metrics, reporting
from karstflow.plans.communities import Parameters, detect
from karstflow.sources import edges, sinks

log = logging.getLogger("karstflow")


def _run_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-g", "--graph-file", required=True, help="path of an edge list")
    p.add_argument("-o", "--output-folder", required=True, help="is replaced")
    p.add_argument("-l", "--lambda", dest="lam", type=float, required=True, help="cohesion threshold")
    p.add_argument("-w", "--window-size", type=int, required=True, help="length of the ring of signs; 0 or less for none")
    p.add_argument("-t", "--tau", type=float, required=True, help="support of the distributed rule")
    p.add_argument("-G", "--gamma", type=int, required=True, help="fewer active edges go to the single-machine rule")
    p.add_argument("-p", "--num-partitions", type=int, required=True, help="class modulus, 3 at least")
    p.add_argument("-sm", "--single-machine", action="store_true", help="skip the distributed rule")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="karstflow", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="find the communities of a graph")
    _run_arguments(run)
    run.add_argument("--max-iter", type=int, default=None)
    run.add_argument("--engine", choices=("auto", "plan", "task"), default="auto")
    evaluate = commands.add_parser("evaluate", help="hold a run's communities against ground truth")
    evaluate.add_argument("details")
    evaluate.add_argument("truth")
    remap = commands.add_parser("remap", help="number a graph's vertices from 1")
    remap.add_argument("graph")
    remap.add_argument("output")
    remap.add_argument("communities", nargs="?")
    report = commands.add_parser("report", help="the metrics table of the runs in a folder")
    report.add_argument("runs")
    report.add_argument("truth")
    report.add_argument("output")
    watch = commands.add_parser("monitor", help="run with the same arguments, sampled")
    _run_arguments(watch)
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("karstflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    p = Parameters(a.lam, a.window_size, a.tau, a.gamma, "single" if a.single_machine else "distributed", a.num_partitions, max_iter=a.max_iter, engine=a.engine)
    found = detect(edges.read_edges(spark, a.graph_file), p)
    for x in found.iterations:
        log.info("%s step %d: %d of %d active, %.2f s", x["phase"], x["step"], x["active"], x["total"], x["seconds"])
    sinks.write_communities(found.communities, f"{a.output_folder}/communities")
    sinks.write_details(found, f"{a.output_folder}/details")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    tables = edges.read_details(spark, a.details)
    row = metrics.summary(tables["communities"], edges.read_ground_truth(spark, a.truth), tables["degree"]).first()
    for name, value in row.asDict().items():
        print(f"{name}: {value}")


def remap(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = edges.read_edges(spark, a.graph, strict=True)
    mapping = graph.dense(graph.vertices(pairs))
    sinks.write_edges(graph.remapped(pairs, mapping), f"{a.output}/graph", edges.header_lines(spark, a.graph))
    if a.communities:
        lines = edges.numbered_lines(spark, a.communities)
        sinks.write_ground_truth(graph.remapped_communities(lines, mapping, "line_no"), f"{a.output}/communities")


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    """The metrics table, and beside it, as tables, the run times and the resource series of the runs. Folders that can't
    be read are logged and left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.runs)
    names = sorted(x.getPath().getName() for x in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop) if x.isDirectory())
    truth, rows, times, series = edges.read_ground_truth(spark, a.truth), None, None, None
    joined = lambda one, more: more if one is None else one.unionByName(more)
    for name in names:
        try:
            parts = spark.range(1).select(edges.parse_folder(F.lit(name)).alias("x")).select("x.*").first()
            tables = edges.read_details(spark, f"{a.runs}/{name}/details")
            summary = metrics.summary(tables["communities"], truth, tables["degree"])
            samples = spark.read.parquet(f"{a.runs}/{name}/resources")
        except Exception as e:  # noqa: BLE001  another folder's trouble isn't this report's
            log.warning("%s: %s", name, str(e).splitlines()[0])
            continue
        title = reporting.test_title(F.lit(parts["dataset"]), F.lit(parts["sm"]), F.lit(parts["g"]), F.lit(parts["l"]), F.lit(parts["p"]))
        minutes = tables["run"].select(reporting.minutes(F.col("start"), F.col("end")).alias("minutes"))
        use = reporting.run_statistics(samples.withColumn("run", F.lit(name)), ["run"]).select("mean_mem", "mean_cpu")
        row = summary.crossJoin(minutes).crossJoin(use).select(title.alias("test"), *[c for c in reporting.HEADINGS if c != "test"])  # one row each
        rows = joined(rows, row)
        stamps = tables["run"].withColumns({"dataset": F.lit(parts["dataset"]), "sm": F.lit(parts["sm"])})
        times = joined(times, reporting.run_times(stamps).withColumn("run", F.lit(name)))
        series = joined(series, reporting.resource_series(samples.withColumns({"run": F.lit(name), "sm": F.lit(parts["sm"])}), ["run"], "sm"))
    if rows is None:
        raise SystemExit(f"no run in {a.runs}")
    sinks.write_lines(reporting.markdown_head(), reporting.markdown(rows), a.output)
    times.write.mode("overwrite").parquet(f"{a.output}_run_times")
    series.write.mode("overwrite").parquet(f"{a.output}_resources")


def watch(a: argparse.Namespace, argv: list[str]) -> int:
    name = edges.folder_name(a.graph_file.rsplit("/", 1)[-1].split(".")[0], a.lam, a.window_size, a.gamma, a.num_partitions, a.single_machine)
    argv = [f"{a.output_folder}/{name}" if argv[k - 1] in ("-o", "--output-folder") else x for k, x in enumerate(argv)]
    code, samples = monitor.launched([sys.executable, "-m", "karstflow", "run", *argv])
    spark = _session()
    sinks.write_samples([s.row() for s in samples], spark, f"{a.output_folder}/{name}/resources")
    spark.stop()
    return code


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(name)s: %(message)s")
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    if a.command == "monitor":
        return watch(a, argv[1:])
    spark = _session()
    try:
        ship(spark)
        {"run": run, "evaluate": evaluate, "remap": remap, "report": report}[a.command](spark, a)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return 130
    finally:
        with contextlib.suppress(Exception):
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
