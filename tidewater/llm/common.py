"""What the operators share: reading tables, learning splits, tables in the shared folder, components of links."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that a Python worker gets at once. Texts are long, so the session's default of 10,000 is lowered; any other value stays.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def ready(df: DataFrame) -> DataFrame:
    """Let Python workers import this package from where the driver has it; on a cluster it is installed there or on PYTHONPATH."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if df.sparkSession.conf.get(BATCH_ROWS) == "10000":
        df.sparkSession.conf.set(BATCH_ROWS, "1000")
    return df


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of df with more columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInPandas, with this package importable on the workers."""
    return ready(df).mapInPandas(run, schema)


def closed_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches that are sorted by key, cut anew so that no group is in two of them; only the last key's rows are held over."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[keys].to_numpy()
        last = values[-1]
        open_ = (values == last).all(axis=1)
        if rest and not (open_.all() and (rest[0][keys].to_numpy()[0] == last).all()):
            yield pd.concat([*rest, pdf[~open_]], ignore_index=True)
            rest = [pdf[open_]]
        elif not rest and not open_.all():
            yield pdf[~open_]
            rest = [pdf[open_]]
        else:
            rest.append(pdf)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], run: Callable) -> Iterator[pd.DataFrame]:
    """Call ``run`` with all rows of each key, of batches that are sorted by key. Only the last key's rows are held over."""
    rest = None
    for pdf in chain(batches, [None]):
        if pdf is None:
            whole, rest = rest, None
        else:
            rest = pdf if rest is None or not len(rest) else pd.concat([rest, pdf], ignore_index=True)
            if not len(rest):
                continue
            values = rest[keys].to_numpy()
            open_ = (values == values[-1]).all(axis=1)
            whole, rest = rest[~open_], rest[open_]
        if whole is None or not len(whole):
            continue
        values = whole[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(whole)]):
            out = run(whole.iloc[a:b])
            if out is not None and len(out):
                yield out


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. Only where the session names none, and all run on this machine (tests), a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, tag: str, by: str | None = None, into: DataFrame | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    With ``by``, rows are laid out in as many buckets of that column as there are shuffle partitions, so that a later group or join on it
    reads them where they are; ``into`` adds to a table written so. The table goes when the application ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    name = f"{tag}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    # what a finished write has shuffled is of no more use
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        if by is None:
            df.write.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), name.replace("-", "_")
            if into is not None:
                path, name, buckets = into._shared_path, into._table, into._buckets
            df.write.mode("append").bucketBy(buckets, by).option("path", path).saveAsTable(name)
            out = spark.table(name)
            out._table, out._buckets = name, buckets
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out._shared_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_shared_path", None)
        if path:
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (a long, b long), as rows (node, component = smallest node).

    Each round joins every node to the smallest label around it and then follows labels of labels, so that
    the number of rounds grows with the logarithm of a component's diameter. Labels live in the shared folder;
    the driver sees one count a round. A node with many links is pre-aggregated before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        stepped = materialise(stepped, "stepped")
        roots = stepped.select(F.col("node").alias("to"), F.col("to").alias("root"))
        jumped = stepped.join(roots, "to", "left").select(
            "node", F.least("to", F.coalesce("root", "to")).alias("label"), "was"
        )
        jumped = materialise(jumped, "labels")
        moved = jumped.where("label <> was").limit(1).count()
        discard(labels, stepped)
        labels = jumped.select("node", "label")
        labels._shared_path = jumped._shared_path
        if not moved:
            discard(edges)
            return labels.select("node", F.col("label").alias("component"))
