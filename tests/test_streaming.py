"""T02 streaming ingest and T03 streaming sample grid."""

import datetime as dt
import os


from logvault.layouts import get_layout
from logvault.operators.predicates import Eq
from logvault.operators.search import search
from logvault.streaming.ingest import ingest_stream, run_to_completion
from logvault.streaming.metrics import grid_stream, read_grid, stream_sample_total


def test_ingest_stream_resumes_from_checkpoint(spark, tmp_path):
    src, dst, ck = str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "ck")
    os.makedirs(src)
    with open(f"{src}/a.log", "w") as f:
        f.write('{"id":1}\n\n{"id":2}\n')
    run_to_completion(ingest_stream(spark, src, dst, "variant", ck))
    with open(f"{src}/b.log", "w") as f:
        f.write('{"id":3}\n')
    run_to_completion(ingest_stream(spark, src, dst, "variant", ck))  # picks up only the new file
    lay = get_layout("variant")
    df = lay.read(spark, dst)
    assert df.count() == 3
    assert search(df, lay, Eq("id", 3)).count() == 1


def test_stream_sample_total(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=s), f"root 1 0 0 1 {kb} ? S 0 0 java") for s, kb in
            [(0, 10), (1, 20), (5, 30), (20, 40)]]
    src = str(tmp_path / "samples")
    spark.createDataFrame(rows, "run_id long, ts timestamp, ps_line string").write.parquet(src)
    stream = spark.readStream.schema("run_id long, ts timestamp, ps_line string").parquet(src)
    related = spark.createDataFrame([("t", "java")], "tool string, name string")
    q = (stream_sample_total(stream, related, "2 seconds", "1 second").writeStream
         .format("memory").queryName("grid_out").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    out = sorted((r["sample_ts"].second, r["total_rss_bytes"]) for r in spark.table("grid_out").collect())
    # windows closed by the watermark (max event 20 s - 1 s) are emitted
    assert out == [(0, 30 * 1024), (4, 30 * 1024)]


def test_watermark_survives_restart_and_drops_late_rows(spark, tmp_path):
    schema = "run_id long, ts timestamp, ps_line string"
    src, dst, ck = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "ck")
    related = spark.createDataFrame([("t", "java")], "tool string, name string")
    t = dt.datetime(2024, 1, 1)

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        q = (stream_sample_total(stream, related, "10 seconds", "5 seconds").writeStream.format("parquet")
             .option("path", dst).option("checkpointLocation", ck).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination(120)

    line = "root 1 0 0 1 {} ? S 0 0 java"
    arrive("a", [(1, t, line.format(1)), (1, t + dt.timedelta(seconds=60), line.format(2))])
    run()  # watermark now 55 s: window [0, 10) is final
    arrive("b", [(1, t + dt.timedelta(seconds=3), line.format(4)), (1, t + dt.timedelta(seconds=90), line.format(8))])
    run()  # restarted from the checkpoint: the row at 3 s is late and dropped
    out = sorted((r["sample_ts"].second + 60 * r["sample_ts"].minute, r["total_rss_bytes"])
                 for r in spark.read.parquet(dst).collect())
    assert out == [(0, 1024), (60, 2 * 1024)]


def test_ingest_stream_processing_time_trigger(spark, tmp_path):
    src, dst, ck = str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "ck")
    os.makedirs(src)
    with open(f"{src}/a.log", "w") as f:
        f.write('{"id": 1, "attr": {"x": "a"}}\n{"id": 2}\n')
    q = ingest_stream(spark, src, dst, "document", ck, available_now=False, processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    lay = get_layout("document")
    assert search(lay.read(spark, dst), lay, Eq("id", 2)).count() == 1


def test_grid_keeps_open_windows_and_goes_on_from_them(spark, tmp_path):
    schema = "run_id long, ts timestamp, ps_line string"
    src, dst, ck = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "ck")
    related = spark.createDataFrame([("t", "java")], "tool string, name string")
    t = dt.datetime(2024, 1, 1)

    def arrive(name, *points):
        rows = [(1, t + dt.timedelta(seconds=s), f"root 1 0 0 1 {kb} ? S 0 0 java") for s, kb in points]
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/{name}")

    def grid():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        run_to_completion(grid_stream(stream, related, dst, ck, "10 seconds", "5 seconds"))
        return sorted((r["sample_ts"].second + 60 * r["sample_ts"].minute, r["total_rss_bytes"] // 1024)
                      for r in read_grid(spark, dst).collect())

    arrive("a", (1, 1), (62, 2))
    assert grid() == [(0, 1), (60, 2)]  # the window at 60 s is still open
    arrive("b", (65, 4), (3, 100), (91, 8))  # 65 s joins it, 3 s is late
    assert grid() == [(0, 1), (60, 6), (90, 8)]
    assert grid() == [(0, 1), (60, 6), (90, 8)]  # nothing new
