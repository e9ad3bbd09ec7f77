"""N17-N19, J04, R08, S10/S19 writers and the SQL face."""

import os

from pyspark.sql import functions as F

from logvault.functions.sql import register_sql_functions
from logvault.layouts import get_layout
from logvault.operators.project import cast_number, from_pairwise, json_extract, json_extract_scalar
from logvault.sinks.writers import write_layout, write_report
from logvault.sources.catalog import catalog_frame, lookup_catalog


def test_json_extract_functions(spark, lines_df):
    df = lines_df(['{"a": {"b": [1, {"c": "22419"}]}}', "not json"])
    out = df.select(F.to_json(json_extract(F.col("line"), "a.b[1]")).alias("sub"),
                    json_extract_scalar(F.col("line"), "a.b[1].c").alias("s"),
                    cast_number(json_extract_scalar(F.col("line"), "a.b[1].c")).alias("n")).collect()
    assert (out[0]["sub"], out[0]["s"], out[0]["n"]) == ('{"c":"22419"}', "22419", 22419)
    assert (out[1]["sub"], out[1]["s"], out[1]["n"]) == (None, None, None)


def test_pairwise_lookup_and_sql_face(spark, lines_df):
    df = get_layout("pairwise").build(lines_df(['{"id": 5, "s": "x", "f": 1.5, "b": true}']))
    row = df.select(from_pairwise("id", "int"), from_pairwise("s", "string"), from_pairwise("zz", "int")).first()
    assert tuple(row) == (5, "x", None)
    register_sql_functions(spark)
    df.createOrReplaceTempView("pw")
    assert spark.sql("SELECT count(*) FROM pw WHERE pairwise_get_int(int_columns, int_values, 'id') = 5"
                     ).first()[0] == 1


def test_catalog_lookup(spark):
    cat = catalog_frame(spark, [("mongod", "mongod", 3, "t.$date", "mongod.log", None, None)])
    rows = spark.createDataFrame([("mongod", 1), ("other", 2)], "dataset string, x int")
    out = {r["dataset"]: r["timestamp_key"] for r in lookup_catalog(rows, cat).collect()}
    assert out == {"mongod": "t.$date", "other": None}


def test_size_bounds_and_report_sheets(spark, tmp_path, lines_df):
    lines = lines_df([f'{{"i": {i}}}' for i in range(10)])
    p = str(tmp_path / "bounded")
    write_layout(get_layout("variant").build(lines).coalesce(1), "variant", p, max_records_per_file=3,
                 block_size=1 << 20)
    assert len([f for f in os.listdir(p) if f.endswith(".parquet")]) == 4
    rep = spark.createDataFrame([("a (ingest)", "m", 1.0), ("a (search)", "q0_cold", 2.0)],
                                "sheet string, metric string, v double")
    out = str(tmp_path / "report")
    write_report(rep, out, fmt="csv")
    assert sorted(d for d in os.listdir(out) if d.startswith("sheet=")) == ["sheet=a (ingest)", "sheet=a (search)"]


def test_event_time_by_dataset(spark):
    from logvault.operators.project import event_time_by_dataset
    cat = catalog_frame(spark, [("mongod", "mongod", 1, "t.$date", "a", None, None),
                                ("es", "es", 1, "@timestamp", "b", None, None),
                                ("sparkev", "sparkev", 2, "Timestamp", "c", None, None)])
    rows = [("mongod", '{"t": {"$date": "2024-01-02T03:04:05.678+00:00"}}'),
            ("es", '{"@timestamp": "2024-01-02T03:04:05Z", "timestamp": "ignored"}'),
            ("sparkev", '{"Event": "x"}'),
            ("sparkev", '{"Timestamp": 1704164645000}'),
            ("unknown", '{"timestamp": "2024-01-02T03:04:05Z"}')]
    df = spark.createDataFrame(rows, "dataset string, line string").select("dataset", F.parse_json("line").alias("j"))
    out = [r["event_time"] for r in event_time_by_dataset(df, cat).collect()]
    assert out[0] is not None and out[0].minute == 4 and out[1] is not None
    assert out[2] is None and out[4] is None
    assert out[3] is not None and out[3].minute == 4


def test_rows_per_row_group(spark, tmp_path, lines_df):
    import glob

    import pyarrow.parquet as pq
    lines = lines_df([f'{{"i": {i}}}' for i in range(2500)])
    p = str(tmp_path / "rg")
    write_layout(lines.coalesce(1), "json_string", p, row_group_rows=1000)
    meta = pq.ParquetFile(glob.glob(p + "/*.parquet")[0]).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 500]


def test_epoch_to_text(spark):
    from logvault.operators.project import epoch_to_text
    df = spark.createDataFrame([(1704067207.9,)], "s double")
    assert df.select(epoch_to_text(F.col("s"))).first()[0] == "2024-01-01 00:00:07"


def test_target_file_bytes(spark, tmp_path, lines_df):
    import hashlib
    pad = [hashlib.sha256(str(i).encode()).hexdigest() * 3 for i in range(3000)]
    lines = lines_df([f'{{"i": {i}, "pad": "{pad[i]}"}}' for i in range(3000)])
    p = str(tmp_path / "sized")
    write_layout(lines.coalesce(1), "json_string", p, target_file_bytes=64 * 1024)
    sizes = [os.path.getsize(os.path.join(p, f)) for f in os.listdir(p) if f.endswith(".parquet")]
    assert len(sizes) >= 2
    assert max(sizes) < 4 * 64 * 1024
