"""Reports on runs: statistics, smoothed series, run times, the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIB = 1024**3
#: The components of a resource sample.
COMPONENTS = ("main", "java", "workers")


def moving_average(rows: DataFrame, value: str, order: str, by: list[str], width: int = 5) -> DataFrame:
    """rows and `smoothed`: the mean of the last `width` values of each series, full frames only."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("_n", F.count(value).over(w)).withColumn("smoothed", F.avg(value).over(w)).where(F.col("_n") == width).drop("_n")


def minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two times in seconds, cut."""
    return ((end - start) / 60).cast("int")


def run_statistics(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, minutes, mean_mem (GiB), mean_cpu: of samples(ts, main_mem, main_cpu, java_mem, ...), all components added."""
    memory = sum((F.col(f"{c}_mem") for c in COMPONENTS[1:]), F.col("main_mem"))
    cpu = sum((F.col(f"{c}_cpu") for c in COMPONENTS[1:]), F.col("main_cpu"))
    return samples.groupBy(*by).agg(minutes(F.min("ts"), F.max("ts")).alias("minutes"), F.round(F.avg(memory / GIB), 2).alias("mean_mem"), F.round(F.avg(cpu), 2).alias("mean_cpu"))


def resource_series(samples: DataFrame, by: list[str], single: str, width: int = 5) -> DataFrame:
    """by, minute, mem (GiB), cpu (smoothed): what a resource chart shows. `single` names a boolean column: runs of the
    single-machine mode show the main process alone."""
    start = F.min("ts").over(Window.partitionBy(*by))
    total = lambda kind: F.when(F.col(single), F.col(f"main_{kind}")).otherwise(sum((F.col(f"{c}_{kind}") for c in COMPONENTS[1:]), F.col(f"main_{kind}")))
    rows = samples.select(*by, "ts", ((F.col("ts") - start) / 60).alias("minute"), (total("mem") / GIB).alias("mem"), total("cpu").alias("cpu"))
    return moving_average(rows, "cpu", "ts", by, width).select(*by, "minute", "mem", F.col("smoothed").alias("cpu"))


def run_times(runs: DataFrame) -> DataFrame:
    """dataset, mode, total_minutes, first_minutes of runs(dataset, sm, start, end, update_ts, part_ts, sm_ts).

    The first iteration lasts from the partitions' time stamp to the first update, in single mode from the start to the
    first single-machine stamp. A missing stamp gives null.
    """
    first = F.when(F.col("sm"), F.get("sm_ts", F.lit(0)) - F.col("start")).otherwise(F.get("update_ts", F.lit(0)) - F.col("part_ts"))
    mode = F.when(F.col("sm"), "single").otherwise("distributed")
    return runs.select("dataset", mode.alias("mode"), ((F.col("end") - F.col("start")) / 60).alias("total_minutes"), (first / 60).alias("first_minutes"))


def iteration_seconds(stamps: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """stamps and `seconds` since the one before of the same series; null for the first."""
    return stamps.withColumn("seconds", F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(ts)))


#: The columns of the metrics table and their headings.
HEADINGS = {
    "test": "Test",
    "minutes": "Running time (m)",
    "mean_mem": "Mean mem (GB)",
    "mean_cpu": "Mean cpu (%)",
    "n_communities": "Predicted",
    "inclusion_accuracy": "Accuracy",
    "purity": "Purity",
    "nmi": "NMI",
    "ari": "ARI",
    "avg_degree": "Avg Degree",
}


def test_title(dataset: Column, single: Column, gamma: Column, lam: Column, parts: Column) -> Column:
    mode = F.when(single, F.lit("single process")).otherwise(F.concat(F.lit("MR gamma="), gamma.cast("string")))
    return F.concat(F.initcap(dataset), F.lit(", "), mode, F.lit(" l="), lam.cast("string"), F.lit(", p="), parts.cast("string"))


def markdown(rows: DataFrame) -> DataFrame:
    """line: a Markdown row for each run, of rows with the columns of HEADINGS."""
    cells = [F.round(F.col(c), 4) if c in ("purity", "nmi", "ari", "avg_degree") else F.col(c) for c in HEADINGS]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |")).alias("line"))


def markdown_head() -> list[str]:
    return ["| " + " | ".join(HEADINGS.values()) + " |", "|" + " :---: |" * len(HEADINGS)]
