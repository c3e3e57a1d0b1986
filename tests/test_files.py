import random

import pytest
from faultlens.functions.paths import parse_list_literal
from faultlens.sources import files


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi",\nthere', ["a", "it's", "b\\c"]), (2, None, []), (3, "", ["x"])]
    df = spark.createDataFrame(rows, "id long, text string, labels array<string>")
    files.write_csv(df, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), "id long, text string, labels string")
    got = {r.id: r for r in back.withColumn("labels", parse_list_literal(back.labels)).collect()}
    assert got[1].text == 'say "hi",\nthere' and got[1].labels == ["a", "it's", "b\\c"]
    assert got[2].labels == [] and got[3].labels == ["x"]
    assert (got[2].text or "") == "" and (got[3].text or "") == ""


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_split_csv_equals_whole_reading(spark, tmp_path, size):
    rng = random.Random(1)
    pieces = ["plain", 'say ""hi""', "a,b", "line\nbreak", "\n\n", "wörter €", '""', "x" * 90, "\r\nand", ""]
    schema = "id long, text string, tail string"
    for name, count, end in (("a", 120, "\n"), ("b", 1, "\n"), ("c", 40, "\r\n"), ("d", 0, "\n")):
        rows = [f'{i},"{"".join(rng.choice(pieces) for _ in range(i % 5))}",{rng.choice(["z", "", chr(34) * 2])}' for i in range(count)]
        text = end.join(["id,text,tail", *rows]) + ("" if name == "b" else end * (1 + (name == "a")))
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    whole = sorted(map(repr, files.read_csv(spark, str(tmp_path), schema).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = files.read_split_csv(spark, str(tmp_path), schema)
        assert sorted(map(repr, got.collect())) == whole and len(whole) == 161
        splits = spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions()
        assert splits > 20 if size == 40 else splits < 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.123456, None)], "model string, MAP double, error string")
    files.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == "m\t0.1235\t"
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().MAP == 0.123456


def test_partitioned_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    files.write_table(df, str(tmp_path / "p"), ["split"])
    plan = spark.read.parquet(str(tmp_path / "p")).filter("split = 'test'")
    assert [r.id for r in plan.collect()] == [2]
