"""Writers: communities, run records, remapped inputs. All replace what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_communities(communities: DataFrame, path: str) -> None:
    """A folder of text files with "id comm" lines, ids ascending over the files."""
    rows = communities.repartitionByRange("id").sortWithinPartitions("id")
    rows.select(F.concat_ws(" ", "id", "comm").alias("value")).write.mode("overwrite").text(path)


def write_details(result, path: str) -> None:
    """The run record: communities, degree, iterations and run as tables under path."""
    spark = result.communities.sparkSession
    result.communities.write.mode("overwrite").parquet(f"{path}/communities.parquet")
    result.degree.write.mode("overwrite").parquet(f"{path}/degree.parquet")
    steps = "n int, phase string, step int, active long, total long, seconds double, ts double"
    spark.createDataFrame([tuple(x.get(k) for k in ("n", "phase", "step", "active", "total", "seconds", "ts")) for x in result.iterations], steps).write.mode("overwrite").parquet(f"{path}/iterations.parquet")
    stamps = "engine string, start double, end double, part_ts double, update_ts array<double>, sm_ts array<double>"
    spark.createDataFrame([tuple(result.run[k] for k in ("engine", "start", "end", "part_ts", "update_ts", "sm_ts"))], stamps).write.mode("overwrite").parquet(f"{path}/run.parquet")


def write_samples(samples, spark, path: str) -> None:
    """The resource record: one row a sample."""
    spark.createDataFrame(samples, "ts double, main_mem long, main_cpu double, java_mem long, java_cpu double, workers_mem long, workers_cpu double").write.mode("overwrite").parquet(path)


def write_edges(edges: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    """Tab-separated src, dst lines, below a comment line in each file. headers (line_no, value): comment lines that stand
    above all others, in a file of their own that comes first."""
    line = F.concat_ws("\t", "src", "dst")
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # of a partition
    rows = edges.select(F.when(first, F.concat(F.lit("# FromNodeId\tToNodeId\n"), line)).otherwise(line).alias("value"))
    if headers is not None:
        rows = headers.coalesce(1).sortWithinPartitions("line_no").select("value").union(rows)
    rows.write.mode("overwrite").text(path)


def write_ground_truth(communities: DataFrame, path: str) -> None:
    """comm_id and members, tab-separated, of (comm_id, members)."""
    rows = communities.repartitionByRange("comm_id").sortWithinPartitions("comm_id")
    rows.select(F.concat_ws("\t", F.col("comm_id").cast("string"), F.array_join(F.transform("members", lambda x: x.cast("string")), "\t")).alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: list[str], table: DataFrame, path: str) -> None:
    """Text lines above a one-column table of lines, in one file."""
    spark = table.sparkSession
    head = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n long, value string")
    body = table.select((F.monotonically_increasing_id() + len(lines)).alias("n"), F.col(table.columns[0]).alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
