"""Edges that arrive as a stream: each canonical edge once, and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.sources.edges import parse_edges


def edge_stream(lines: DataFrame, line: str = "value") -> DataFrame:
    """u, v of a stream of edge-list lines, each edge once. The state holds every edge seen: give lines a watermark and
    use dropDuplicatesWithinWatermark() on the result of parse_edges() where copies arrive close together."""
    pairs = parse_edges(lines, line).where("src <> dst")
    return pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).dropDuplicates(["u", "v"])


def degree_stream(edges: DataFrame) -> DataFrame:
    """id, k: degrees so far, for output mode "complete"."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
