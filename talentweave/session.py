"""What the operators need from a session: tables, checkpoints, size checks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A copy of ``df`` written to the shared folder that spark.checkpoint.dir names, so that a
    lost executor doesn't cost the work before it. Only where that is unset and the master is
    local (tests) a folder is made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``number``, the place of a row within its key from 0. Rows are sorted by range over all tasks,
    so that a hot key is spread; only the counts of keys by task are brought together."""
    names, kinds = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[Any, int] = {}
        for batch in batches:
            numbers = []
            for value in batch.column(names.index(key)).to_pylist():
                numbers.append(seen.get(value, 0))
                seen[value] = numbers[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*names, "_n"])

    placed = cut_lineage(df.repartitionByRange(F.asc(key), *order).sortWithinPartitions(F.asc(key), *order).mapInArrow(run, f"{kinds}, _n bigint").withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return placed.join(F.broadcast(offsets), [key, "_p"]).withColumn("number", F.col("_n") + F.col("_before")).drop("_n", "_p", "_before")
