"""The command line front end."""

import os

from logvault.__main__ import main


def test_ingest_search_catalog(spark, tmp_path):
    src = tmp_path / "logs"
    os.makedirs(src)
    (src / "a.log").write_text('{"id": 22419, "ctx": "x", "attr": {"tickets": 1}}\nbad\n{"id": 1, "ctx": "y"}\n')
    dst = str(tmp_path / "arch")
    out = main(["ingest", str(src), dst, "--layout", "variant", "--malformed", "skip"], spark)
    assert out["rejected"] == 1
    hits = main(["search", dst, "--layout", "variant"], spark)["hits"]
    assert hits["q1"] == 1 and hits["q2"] == 1
    assert main(["search", dst, "--where", "lv_text(j, '$.ctx') = 'y'"], spark)["hits"] == 1
    paths = {r["path"] for r in spark.read.parquet(main(["catalog", dst, dst + "-paths"], spark)["out"]).collect()}
    assert paths == {"id", "ctx", "attr.tickets"}


def test_ingest_with_encoded_keys(spark, tmp_path):
    src = tmp_path / "l2"
    os.makedirs(src)
    (src / "a.log").write_text('{"bad key": 1}\n')
    dst = str(tmp_path / "enc")
    main(["ingest", str(src), dst, "--layout", "pairwise", "--keys", "b64"], spark)
    out = main(["catalog", dst, dst + "-paths", "--layout", "pairwise"], spark)["out"]
    paths = {r["path"] for r in spark.read.parquet(out).collect()}
    assert paths == {"YmFkIGtleQ=="}


def test_report_from_result_files(spark, tmp_path):
    import json
    for tool in ("toolA", "toolB"):
        d = tmp_path / "assets" / tool
        os.makedirs(d)
        doc = {"mongod": {"{}": {"ingest": {"time_taken_s": 1.5, "memory_average_B": 1048576,
                                            "compressed_size_B": 1048576, "decompressed_size_B": 2097152,
                                            "start_time": "2024-01-01 00:00:00"}}}}
        (d / "output.json").write_text(json.dumps(doc, indent=2))
    out = str(tmp_path / "sheets")
    main(["report", str(tmp_path / "assets" / "*" / "output.json"), out, "--format", "csv"], spark)
    rows = spark.read.option("header", "true").csv(out).collect()
    cells = {(r["sheet"], r["metric"]): (r["toolA ()"], r["toolB ()"]) for r in rows}
    assert cells[("mongod (ingest)", "compression_ratio")] == ("2.0", "2.0")
    assert cells[("mongod (ingest)", "memory_average_MB")] == ("1.0", "1.0")
