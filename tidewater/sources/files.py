"""Reading and writing tables and values."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = "_ord"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_order(df: DataFrame, name: str = ORDER) -> DataFrame:
    """Number the rows as they are read: increasing in file order, not consecutive. Only right on a fresh scan, before any shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floats have one null: NaN becomes NULL at the source."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Header, quotes with doubled quotes inside, CRLF, byte order mark; short rows are filled with NULL, longer ones cut.

    Types, unless a schema is given: long if all cells of a column are whole numbers, else double, else string. Empty cells are NULL; a column without any
    value is long. With a schema the file is read once.
    """
    text = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "")
    if schema is not None:
        return text.schema(schema).csv(path)
    raw = text.option("inferSchema", False).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    whole = r"^[+-]?[0-9]{1,18}$"
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    cell = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
    row = raw.agg(*(F.struct(F.coalesce(F.bool_and(cell(c).rlike(whole)), F.lit(True)).alias("whole"), F.coalesce(F.bool_and(cell(c).rlike(number)), F.lit(True)).alias("number")).alias(f"c{i}") for i, c in enumerate(raw.columns))).first()
    kinds = ["bigint" if row[i]["whole"] else "double" if row[i]["number"] else "string" for i in range(len(raw.columns))]
    return raw.select(*(cell(c).cast(k).alias(c) for c, k in zip(raw.columns, kinds)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_bytes(spark: SparkSession, path: str, offset: int | None = None, length: int | None = None) -> DataFrame:
    """(path, content) of files, or of a stretch of them."""
    files = spark.read.format("binaryFile").load(path)
    if offset is None:
        return files.select("path", "content")
    return files.select("path", F.substring("content", offset + 1, length if length is not None else 2**31 - 1).alias("content"))


def write_bytes(data: bytes, path: str) -> None:
    """A small file, from the driver."""
    Path(path).write_bytes(data)


# ---- values and tables on disk --------------------------------------------------------------------------------------------


def dset(path: str, value: Any) -> None:
    """Keep a table as Parquet or any other value as JSON."""
    if isinstance(value, DataFrame):
        value.write.mode("overwrite").parquet(path)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(value))


def dget(spark: SparkSession, path: str) -> Any:
    """What dset kept. Nothing in a file is ever run."""
    p = Path(path)
    return json.loads(p.read_text()) if p.is_file() else spark.read.parquet(path)


def splay(path: str, df: DataFrame) -> None:
    """Columnar, column by column readable."""
    df.write.mode("overwrite").parquet(path)


def dload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: that of the checkpoints, or on one machine the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = spark.conf.get("spark.sql.warehouse.dir")
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def delete_at_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def partsave(path: str, df: DataFrame, by: str, tasks: int = 8, rows_a_file: int = 0) -> None:
    """A folder for each value of a column. Rows are first dealt by that column together with a hash, so that a frequent value
    is written by so many ``tasks`` and a rare one makes few files; ``rows_a_file`` bounds a file, 0 does not."""
    deal = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType))), F.lit(tasks))
    df.repartition(F.col(by), deal).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(by).parquet(path)


def partload(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """All partitions, or with a condition on the partition column only those that it needs."""
    df = spark.read.parquet(path)
    return df if only is None else df.where(only)


def parts(spark: SparkSession, path: str, by: str) -> DataFrame:
    return spark.read.parquet(path).select(by).distinct()


def bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int) -> DataFrame:
    """A catalogue table laid out by key, so that joins and groups on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    return df.sparkSession.table(name)


# ---- exchange -------------------------------------------------------------------------------------------------------------


def arrow_export(df: DataFrame):
    """A pyarrow table in driver memory; its C data interface hands it to any other library."""
    return df.toArrow()


def arrow_import(spark: SparkSession, data) -> DataFrame:
    return spark.createDataFrame(data)


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object, on the executors."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def jenc(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def jdec(text: str) -> Any:
    """Numbers are floats."""
    return json.loads(text, parse_int=float)


def html_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as an HTML table; text is escaped."""
    from html import escape

    tag = lambda name, inner: f"<{name}>{inner}</{name}>"
    head = tag("tr", "".join(tag("th", escape(c)) for c in df.columns))
    body = "".join(tag("tr", "".join(tag("td", "" if v is None else escape(str(v))) for v in r)) for r in df.limit(rows).collect())
    return tag("table", head + body)
