"""Positions of rows in an order, without bringing all rows to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(session: SparkSession) -> str:
    """The folder of this context in what spark.checkpoint.dir names; one of our own only in local mode, as in tests."""
    context = session.sparkContext
    if not context.getCheckpointDir():
        named = session.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pointloom-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, estimated: bool = True) -> DataFrame:
    """``df`` checkpointed in the shared folder.

    A checkpoint keeps the estimated size of its plan, which joins multiply: in a loop its digits double or triple with each
    step, until planning takes minutes and the driver's memory. An estimate beyond 2**62 is dropped, and any without ``estimated``:
    for what comes of rows that were exploded, as those count as before, and a join would send a large table whole to every task.
    """
    session = df.sparkSession
    shared_folder(session)
    kept = df.checkpoint(eager=True)
    if estimated and estimated_bits(kept) <= 62:
        return kept
    return DataFrame(session._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), session)


def estimated_bits(df: DataFrame) -> int:
    """Binary digits of the size in bytes that Spark expects."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())).bit_length()


def ranked(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in a total order.

    Rows are dealt by range and sorted inside partitions; a partition's first
    position is the number of rows before it, from one count for each partition.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    firsts = counts.select("_part", before.alias("_first"))
    return placed.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_row", "_first")
