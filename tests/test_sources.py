"""Readers, writers, the command line, the monitor and the stream."""

import sys

import pytest
from pyspark.sql import functions as F

from karstflow import __main__ as cli
from karstflow.functions import monitor, windows
from karstflow.operators import graph, reporting
from karstflow.sources import edges, sinks
from karstflow.streaming.edges import degree_stream, edge_stream


def _lines(spark, lines):
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "no long, value string")


def test_edge_lines(spark):
    rows = _lines(spark, ["# head", "", "  ", "1 2", "2\t1", "7", "3 3 x y", "  0   12  "])
    assert sorted(tuple(r) for r in edges.parse_edges(rows).collect()) == [(0, 12), (1, 2), (2, 1), (3, 3)]
    pairs = edges.parse_edges(rows)
    assert sorted(tuple(r) for r in graph.canonical(pairs).collect()) == [(2, 1), (12, 0)]
    assert sorted(r.id for r in graph.vertices(pairs).collect()) == [0, 1, 2, 3, 12]
    assert edges.parse_edges(_lines(spark, [])).count() == 0


@pytest.mark.parametrize(("lines", "strict"), [(["1 2", "x 1"], False), (["1 2 3"], True), (["1"], True)])
def test_bad_lines_name_their_number(spark, lines, strict):
    with pytest.raises(Exception, match=f"line {len(lines) - 1}"):
        edges.parse_edges(_lines(spark, lines), strict=strict, number="no").collect()


def test_lines_are_numbered_through_the_files(spark, tmp_path):
    """In tasks that read parts of several files."""
    for name, n in (("a", 700), ("b", 3), ("c", 400)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {k}\n" for k in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    found = [r.value for r in edges.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    numbers = sorted(r.line_no for r in edges.numbered_lines(spark, str(tmp_path)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == [f"{name} {k}" for name, n in (("a", 700), ("b", 3), ("c", 400)) for k in range(n)]
    assert numbers == list(range(1, 1104))
    (tmp_path / "bad.txt").write_text("1 2\n\n3 4\nfour 5\n")
    with pytest.raises(Exception, match="in line 4: four 5"):
        edges.read_edges(spark, str(tmp_path / "bad.txt")).collect()


def test_ground_truth_last_line_wins(spark):
    found = edges.parse_ground_truth(_lines(spark, ["1 5 6", "2 7", "3", "1 8 8"]), "no").collect()
    assert sorted((r.comm_id, r.node) for r in found) == [(1, 8), (2, 7)]


def test_files_and_commands(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("# test\n# more\n10 20\n20 30\n30 10\n40 50\n50 60\n60 40\n30 40\n")
    truth = tmp_path / "t.txt"
    truth.write_text("10 20 30\n40 50 60\n")
    a = cli.parser().parse_args(["remap", str(path), str(tmp_path / "r"), str(truth)])
    cli.remap(spark, a)
    assert sorted(tuple(r) for r in edges.read_edges(spark, str(tmp_path / "r/graph")).collect()) == [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)]
    heads = [r.value for r in edges.header_lines(spark, str(tmp_path / "r/graph")).orderBy("line_no").collect()]
    assert heads[:2] == ["# test", "# more"] and set(heads[2:]) == {"# FromNodeId\tToNodeId"}
    found = edges.read_ground_truth(spark, str(tmp_path / "r/communities")).collect()
    assert sorted((r.comm_id, r.node) for r in found) == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)]
    runs = tmp_path / "runs"
    out = runs / edges.folder_name("toy", 0.5, 15, 0, 8, False)
    args = ["-g", str(tmp_path / "r/graph"), "-o", str(out), "-l", "0.5", "-w", "15", "-t", "0.7", "-G", "0", "-p", "8"]
    cli.run(spark, cli.parser().parse_args(["run", *args, "--max-iter", "50"]))
    comm = edges.read_communities(spark, str(out / "communities"))
    assert comm.count() == 6
    tables = edges.read_details(spark, str(out / "details"))
    assert tables["degree"].count() == 6 and tables["run"].first().engine == "task" and tables["iterations"].count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        edges.read_details(spark, str(tmp_path))
    cli.evaluate(spark, cli.parser().parse_args(["evaluate", str(out / "details"), str(tmp_path / "r/communities")]))
    sinks.write_samples([monitor.Sample(float(k), main_mem=2**30, main_cpu=5.0).row() for k in range(120)], spark, str(out / "resources"))
    (runs / "not_a_run").mkdir()
    cli.report(spark, cli.parser().parse_args(["report", str(runs), str(tmp_path / "r/communities"), str(tmp_path / "m")]))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    times = spark.read.parquet(str(tmp_path / "m_run_times")).first()
    assert times.dataset == "toy" and times.mode == "distributed" and 0 < times.first_minutes <= times.total_minutes < 5
    assert spark.read.parquet(str(tmp_path / "m_resources")).count() == 116
    assert lines[0].startswith("| Test |") and lines[2].startswith("| Toy, MR gamma=0 l=0.5, p=8 | 0 | 1.0 | 5.0 |") and len(lines) == 3


def test_unknown_vertex_in_communities_is_an_error(spark):
    mapping = spark.createDataFrame([(5, 1)], "id long, new_id long")
    with pytest.raises(Exception, match="no such vertex"):
        graph.remapped_communities(_lines(spark, ["5 6"]), mapping, "no").collect()


def test_folder_names(spark):
    one = lambda x: spark.range(1).select(edges.parse_folder(F.lit(x)).alias("x")).select("x.*").first()
    assert tuple(one("a_b_l0.5_w-1_g5000_p8_smTrue")) == ("a_b", 0.5, -1, 5000, 8, True)
    with pytest.raises(Exception, match="not a run folder"):
        one("whatever")


def test_window_text(spark):
    row = spark.range(1).select(windows.to_text(F.lit(5).cast("long"), 4).alias("t"), windows.from_text(F.lit("1010")).alias("n")).first()
    assert tuple(row) == ("1010", 5)


def test_dense_ranks_over_partitions(spark):
    ids = spark.range(0, 5000, 7).select((F.col("id") * 3).alias("id"))
    found = sorted(tuple(r) for r in graph.dense(ids.union(ids)).collect())
    assert found == [(21 * k, k + 1) for k in range(715)]
    assert graph.dense(ids.where("id < 0")).count() == 0


def test_moving_average_needs_full_frames(spark):
    rows = spark.createDataFrame([("a", float(k), float(k)) for k in range(7)] + [("b", 0.0, 1.0)], "run string, ts double, x double")
    assert [r.smoothed for r in reporting.moving_average(rows, "x", "ts", ["run"]).orderBy("ts").collect()] == [2.0, 3.0, 4.0]


def test_monitor_samples_a_command():
    code, samples = monitor.launched([sys.executable, "-c", "import time; e = time.time() + 2\nwhile time.time() < e: pass"], 0.1)
    assert code == 0 and max(s.main_mem for s in samples) > 2**20 and max(s.main_cpu for s in samples) > 0
    assert monitor.sample(2**22 + 1, 0.01).main_mem == 0


def test_stream_of_edges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1 2\n2 1\n3 3\n# x\n2 3\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    q = edge_stream(lines).writeStream.format("memory").queryName("edge_rows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("edge_rows").collect()) == [(2, 1), (3, 2)]
    q = degree_stream(edge_stream(lines)).writeStream.format("memory").queryName("degree_rows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("degree_rows").collect()) == [(1, 1), (2, 2), (3, 1)]
