import json
import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from shelfprice.session import scratch_dir
from shelfprice.sources import (
    DatasetError, clean_headers, load_model, read_lenient_csv, require_rows, save_model, write_csv, write_json, write_table,
)


def write(tmp_path, text, encoding="utf-8"):
    path = tmp_path / f"{uuid.uuid4().hex}.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_ragged_blank_and_quoted_rows(spark, tmp_path):
    path = write(tmp_path, 'product id,price,note\nA,1.5,"x, ""y"""\nB,2.5\n\n,,\nC,3.5,z,extra\nD,4.5,"a,b,c,d"\n')
    rows = {r["product_id"]: r for r in read_lenient_csv(spark, path).collect()}
    assert sorted(rows) == ["A", "B", "D"]
    assert rows["A"]["note"] == 'x, "y"' and rows["B"]["note"] is None and rows["D"]["note"] == "a,b,c,d"
    assert rows["D"]["price"] == 4.5


def test_byte_order_mark_and_latin(spark, tmp_path):
    assert read_lenient_csv(spark, write(tmp_path, "﻿name,n\nx,1\n")).columns == ["name", "n"]
    row = read_lenient_csv(spark, write(tmp_path, "name,n\ncafé,1\n", "latin-1")).first()
    assert row["name"] == "café"


def test_headers_and_guards(spark, tmp_path):
    assert clean_headers([" unit  price ", "", "a b"]) == ["unit_price", "col_1", "a_b"]
    with pytest.raises(DatasetError):
        read_lenient_csv(spark, write(tmp_path, "a,b\n"))
    with pytest.raises(DatasetError):
        require_rows(spark.range(5), max_rows=4)
    assert require_rows(spark.range(5), max_rows=5).count() == 5


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5, "x"), ('q"', 2.0, "y")], "name string, v double, part string")
    back = spark.read.csv(write_csv(df, str(tmp_path / "c")), header=True, escape='"')
    assert {r["name"] for r in back.collect()} == {"a,b", 'q"'}
    table = spark.read.parquet(write_table(df, str(tmp_path / "t"), ["part"]))
    assert {(r["name"], r["part"]) for r in table.collect()} == {("a,b", "x"), ('q"', "y")}
    write_json(df, str(tmp_path / "j"))
    lines = [json.loads(line) for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 2 and {"name", "v", "part"} == set(lines[0])


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")]).fit(df)
    again = load_model(save_model(model, str(tmp_path / "m")))
    assert again.transform(df).first()["prediction"] == pytest.approx(1.0, abs=1e-6)


def test_scratch_dir_is_the_session_one(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_line_breaks_and_open_quotes(spark, tmp_path):
    rows = read_lenient_csv(spark, write(tmp_path, 'id,note,n\nA,"two\nlines",5\nB,x,6\n')).collect()
    assert sorted(tuple(r) for r in rows) == [("A", "two\nlines", 5), ("B", "x", 6)]
    with pytest.raises(DatasetError):
        read_lenient_csv(spark, write(tmp_path, 'id,note\nA,"never closed\nB,x\n'))
    rows = read_lenient_csv(spark, write(tmp_path, "id;note\nA;1,5\nB;2,5,0\n"), sep=";").collect()
    assert len(rows) == 2
