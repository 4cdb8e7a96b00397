import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.sources import display, files, generators
from tidewater.streaming import pubsub


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes('﻿sym,px,qty,note\r\nAAA,187.5,100,"a, b"\r\nBBB,410.2,50,"say ""hi"""\r\nCCC,138.9,,plain\r\n'.encode())
    df = files.read_csv(spark, str(p))
    assert df.dtypes == [("sym", "string"), ("px", "double"), ("qty", "bigint"), ("note", "string")]
    assert [tuple(r) for r in df.collect()] == [("AAA", 187.5, 100, "a, b"), ("BBB", 410.2, 50, 'say "hi"'), ("CCC", 138.9, None, "plain")]
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "ragged.csv")).collect()] == [(1, 2), (3, None)]


def test_tables_on_disk(spark, tmp_path):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "sym string, px double")
    files.splay(str(tmp_path / "s"), t)
    assert files.dload(spark, str(tmp_path / "s")).count() == 3
    files.partsave(str(tmp_path / "p"), t, "sym")
    assert sorted(r["sym"] for r in files.parts(spark, str(tmp_path / "p"), "sym").collect()) == ["a", "b"]
    assert files.partload(spark, str(tmp_path / "p"), F.col("sym") == "a").count() == 2
    files.dset(str(tmp_path / "v.json"), {"a": [1, 2]})
    assert files.dget(spark, str(tmp_path / "v.json")) == {"a": [1, 2]}
    files.dset(str(tmp_path / "t"), t)
    assert files.dget(spark, str(tmp_path / "t")).count() == 3
    files.write_bytes(b"hello", str(tmp_path / "b"))
    assert bytes(files.read_bytes(spark, str(tmp_path / "b"), 1, 3).first()["content"]) == b"ell"


def test_exchange(spark):
    t = spark.createDataFrame([(1, 2.5), (2**40, None)], "a long, b double")
    data = files.arrow_export(t)
    assert isinstance(data, pa.Table) and files.arrow_import(spark, data).collect() == t.collect()
    assert [r["value"] for r in files.json_lines(t).collect()] == ['{"a":1,"b":2.5}', '{"a":1099511627776}']
    assert files.jdec(files.jenc({"k": [1, "ä"]})) == {"k": [1.0, "ä"]}
    assert "<td>&lt;x&gt;</td>" in files.html_table(spark.createDataFrame([("<x>",)], "s string"))


def test_nan_is_null(spark):
    df = files.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"))
    assert [r["x"] for r in df.collect()] == [1.0, None]


def test_generators(spark):
    q, t, o = generators.quotes(spark, 500), generators.trades(spark, 500), generators.options(spark, 100)
    assert 900 < q.count() < 1100 and 450 < t.count() < 550 and o.count() == 100
    assert q.where("ask <= bid or bid <= 0 or time < 34200000 or time > 57600000").count() == 0
    assert t.where("px is null or sz < 100").count() == 0
    assert q.collect() == generators.quotes(spark, 500).collect()
    assert o.where("price < 0 or iv <= 0 or bid > ask").count() == 0
    assert sorted(r["x"] for r in generators.deal(spark, 10, 10).collect()) == list(range(10))
    with pytest.raises(ValueError):
        generators.deal(spark, 3, 2)


def test_display(spark):
    text = display.grid(spark.createDataFrame([("a", 34215007)], "sym string, time long"))
    assert "09:30:15.007" in text and "1 rows, 2 columns" in text


def test_pubsub(spark, tmp_path):
    hub = pubsub.Hub(spark, str(tmp_path))
    empty = spark.createDataFrame([], "sym string, px double")
    hub.define("trd", empty)
    seen = []
    hub.subscribe("trd", lambda name, rows: seen.append((name, rows.count())))
    hub.publish("trd", spark.createDataFrame([("a", 1.0), ("b", 2.0)], empty.schema))
    hub.publish("trd", spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], empty.schema))
    assert hub.get("trd").count() == 5 and sum(n for _, n in seen) == 5
    assert hub.end("trd", str(tmp_path / "day")).count() == 5 and hub.get("trd").count() == 5
    assert pubsub.drain(hub.follow("trd").groupBy("sym").count()).count() == 3
    got = []
    pubsub.each_batch(hub.follow("trd"), lambda df, n: got.append(df.count()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sum(got) == 5
    with pytest.raises(ValueError):
        hub.publish("trd", empty.select("px"))
    with pytest.raises(KeyError):
        hub.get("nope")
