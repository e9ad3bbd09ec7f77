"""R09 with order: digests of line sequences."""

import gzip
import os
import random

import pytest

from logvault.operators.quality import roundtrip_report
from logvault.operators.sequence import BASES, PRIME, roundtrip_ordered, sequence_digest
from logvault.sources.lines import read_lines


def write_files(path, files):
    os.makedirs(path)
    for name, lines in files.items():
        data = "".join(x + "\n" for x in lines).encode()
        with open(f"{path}/{name}", "wb") as f:
            f.write(gzip.compress(data) if name.endswith(".gz") else data)
    return str(path)


@pytest.fixture()
def lines():
    rng = random.Random(5)
    return [rng.choice(["", "same", "é", f'{{"id":{i}}}']) for i in range(300)]


def test_files_and_splits_do_not_matter(spark, tmp_path, lines):
    one = write_files(tmp_path / "one", {"a.log": lines})
    many = write_files(tmp_path / "many", {f"{i:02d}.log": lines[a:z] for i, (a, z) in enumerate([(0, 7), (7, 7), (7, 200), (200, 300)])})
    zipped = write_files(tmp_path / "zip", {"0.log.gz": lines[:100], "1.log.gz": lines[100:]})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        want = sequence_digest(spark, one).first()
        assert want["n_lines"] == 300
        for size in ("64b", "300b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert {sequence_digest(spark, p).first() for p in (one, many, zipped)} == {want}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_digest_is_the_polynomial(spark, tmp_path, lines):
    from pyspark.sql import functions as F
    got = sequence_digest(spark, write_files(tmp_path / "one", {"a.log": lines})).first()
    hashes = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select(
        "i", *[F.xxhash64("line", F.lit(s)).alias(f"h{s}") for s in range(2)]).orderBy("i").collect()
    for s, base in enumerate(BASES):
        assert got[f"d{s}"] == sum(r[f"h{s}"] % PRIME * pow(base, r["i"], PRIME) for r in hashes) % PRIME


@pytest.mark.parametrize("change", ["swap", "far swap", "lose", "repeat", "edit", "move file"])
def test_changes_are_found(spark, tmp_path, change):
    lines = [f"line {i}" for i in range(60)]
    new = list(lines)
    if change == "swap":
        new[10], new[11] = new[11], new[10]
    elif change == "far swap":
        new[0], new[59] = new[59], new[0]
    elif change == "lose":
        del new[30]
    elif change == "repeat":
        new.insert(5, new[5])
    elif change == "edit":
        new[7] += " "
    else:
        new = lines[20:] + lines[:20]
    a = write_files(tmp_path / "a", {"0.log": lines[:20], "1.log": lines[20:]})
    b = write_files(tmp_path / "b", {"0.log": new[:40], "1.log": new[40:]})
    row = roundtrip_ordered(spark, a, b).first()
    assert (row["n_original"], row["n_restored"], row["equal"]) == (60, len(new), False)
    if change in ("swap", "far swap", "move file"):  # the multiset digest cannot see these
        assert roundtrip_report(read_lines(spark, a), read_lines(spark, b)).first()["equal"]


def test_empty_and_unknown(spark, tmp_path, lines):
    none = write_files(tmp_path / "none", {"a.log": []})
    assert tuple(sequence_digest(spark, none).first()) == (0, 0, 0)
    assert roundtrip_ordered(spark, none, none).first()["equal"]
    assert not roundtrip_ordered(spark, none, write_files(tmp_path / "x", {"a.log": ["x"]})).first()["equal"]
    with pytest.raises(ValueError, match="fmt"):
        sequence_digest(spark, none, "bogus")


def test_json_string_archive(spark, tmp_path):
    lines = [f'{{"id":{i}}}' for i in range(50)]
    a = write_files(tmp_path / "a", {"a.log": lines})
    spark.read.text(a).withColumnRenamed("value", "line").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert roundtrip_ordered(spark, a, str(tmp_path / "p"), restored_fmt="json_string").first()["equal"]
