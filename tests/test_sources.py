"""Readers and sinks."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from rhoscope.sources import readers as IO


def test_csv_round_trip_and_index(spark, tmp_path):
    df = spark.createDataFrame([(0, "é", 0.123456), (1, None, 2.0)], "i int, s string, x double")
    IO.write_csv(df, str(tmp_path / "c"), decimals=4)
    back = IO.read_csv(spark, str(tmp_path / "c"), "i int, s string, x double")
    assert sorted(map(tuple, back.collect())) == [(0, "é", 0.1235), (1, None, 2.0)]
    assert IO.read_csv(spark, str(tmp_path / "c"), index_column=True).columns == ["s", "x"]


def test_latin1(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("a\ncafé\n".encode("latin-1"))
    assert IO.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first().a == "café"


def test_stems_are_datasets(spark, tmp_path):
    for name in ("one", "two", "one_summary"):
        (tmp_path / f"{name}.csv").write_text("v\n1\n")
    assert sorted(r.dataset for r in IO.read_stems(spark, f"{tmp_path}/*.csv", "v int").collect()) == ["one", "two"]


def test_missing_inputs(spark, tmp_path):
    assert IO.read_or(spark, str(tmp_path / "no"), on_missing="skip") is None
    with pytest.raises(AnalysisException):
        IO.read_or(spark, str(tmp_path / "no"))
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(1).selectExpr("id", "id AS b").write.parquet(str(tmp_path / "b"))
    assert IO.union_present(spark, [str(tmp_path / x) for x in ("a", "no", "b")]).count() == 3


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(map(tuple, IO.upsert(base, new, ["k"]).collect())) == [("a", 9), ("b", 2)]
    assert sorted(map(tuple, IO.upsert(base, new.limit(0), ["k"]).collect())) == [("a", 1), ("a", 3), ("b", 2)]


def test_describe_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "a int, b string")
    got = {r.name: (r.n_rows, r.n_null, r.n_distinct, r.sample) for r in IO.describe_source(df).collect()}
    assert got == {"a": (3, 0, 2, "1,2"), "b": (3, 1, 2, "x,y")}
    (tmp_path / "d.json").write_text('{"T": ["a", "b"]}')
    assert IO.read_json(spark, str(tmp_path / "d.json")).first()["T"] == ["a", "b"]


def test_build_if_missing(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert IO.build_if_missing(spark, str(tmp_path / "s"), build).count() == 3
    assert made == [1]
