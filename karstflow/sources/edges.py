"""Readers: edge lists, ground truth, predictions, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _tokens(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def parse_edges(lines: DataFrame, line: str = "value", strict: bool = False, number: str | None = None) -> DataFrame:
    """src, dst of each line of an edge list: two integers apart by white space, further tokens ignored.

    Blank lines, lines that begin with # and lines of one token are skipped. A token that is no integer is an error that
    names the line (its number, if a column of numbers is given). strict: lines must have exactly two tokens.
    """
    rows = lines.select(F.col(line).alias("_line"), (F.col(number) if number else F.lit(None).cast("long")).alias("_no"), _tokens(F.col(line)).alias("_t"))
    rows = rows.where((F.col("_t")[0] != "") & ~F.col("_t")[0].startswith("#") & ((F.size("_t") >= 2) | F.lit(strict)))
    where = F.concat(F.lit("invalid number format in line "), F.coalesce(F.col("_no").cast("string"), F.lit("")), F.lit(": "), F.col("_line"))

    def integer(k: int) -> Column:
        x = F.get(F.col("_t"), F.lit(k)).try_cast("long")
        bad = x.isNull() | (F.lit(strict) & (F.size("_t") != 2))
        return F.when(bad, F.raise_error(where).cast("long")).otherwise(x)

    return rows.select(integer(0).alias("src"), integer(1).alias("dst"))


def read_edges(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """src, dst of a text file (or a folder of them) in the form of parse_edges(). Errors name the number of the line."""
    return parse_edges(numbered_lines(spark, path), strict=strict, number="line_no")


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of the lines of text files that begin with #."""
    return numbered_lines(spark, path).where(F.ltrim("value").startswith("#"))


def parse_ground_truth(lines: DataFrame, number: str, line: str = "value") -> DataFrame:
    """comm_id, node, rank of lines "comm_id node node ...": lines of one token are skipped; of lines with the same comm_id
    the last one counts. rank orders communities as a reader keeps them: by the first line of each."""
    rows = lines.select(F.col(number).alias("_no"), _tokens(F.col(line)).alias("_t")).where(F.size("_t") >= 2)
    rows = rows.select("_no", F.col("_t")[0].cast("long").alias("comm_id"), F.slice("_t", F.lit(2), F.size("_t") - 1).alias("_nodes"))
    one = rows.groupBy("comm_id").agg(F.min("_no").alias("rank"), F.max_by("_nodes", "_no").alias("_nodes"))
    return one.select("comm_id", F.explode(F.array_distinct("_nodes")).alias("node"), "rank").withColumn("node", F.col("node").cast("long"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of text files: 1, 2, ... through the files, by path.

    Each part of a file that a task reads at once is numbered by itself; the parts' counts, a row each, give the offsets.
    """
    at = F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")
    lines = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("_id"))
    parts = lines.groupBy("_f", "_b").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_o"))
    return lines.join(F.broadcast(parts), ["_f", "_b"]).select((F.col("_o") + F.col("_id")).alias("line_no"), "value")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_ground_truth(numbered_lines(spark, path), "line_no")


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """id, comm of "id comm" lines."""
    t = _tokens(F.col("value"))
    return spark.read.text(path).select(t[0].cast("long").alias("id"), t[1].cast("long").alias("comm"))


def inverted(communities: DataFrame) -> DataFrame:
    """comm, nodes of (id, comm) rows."""
    return communities.groupBy("comm").agg(F.sort_array(F.collect_set("id")).alias("nodes"))


def read_details(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a run record: communities, degree, iterations, run. A missing one is an error."""
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in ("communities", "degree", "iterations", "run")}


#: Folder names of runs: dataset, lambda, window, gamma, partitions, single mode.
FOLDER = r"^(.+)_l([0-9.]+)_w(-?[0-9]+)_g([0-9]+)_p([0-9]+)_sm(True|False)$"


def parse_folder(name: Column) -> Column:
    """A struct of a run folder's parts; another name is an error."""
    part = lambda k, kind: F.regexp_extract(name, FOLDER, k).cast(kind)
    ok = name.rlike(FOLDER)
    bad = F.raise_error(F.concat(F.lit("not a run folder: "), name))
    found = F.struct(
        part(1, "string").alias("dataset"), part(2, "double").alias("l"), part(3, "int").alias("w"), part(4, "int").alias("g"), part(5, "int").alias("p"), (part(6, "string") == "True").alias("sm")
    )
    return F.when(ok, found).otherwise(bad.cast("struct<dataset:string,l:double,w:int,g:int,p:int,sm:boolean>"))


def folder_name(dataset: str, lam: float, window: int, gamma: int, partitions: int, single: bool) -> str:
    return f"{dataset}_l{lam}_w{window}_g{gamma}_p{partitions}_sm{single}"
