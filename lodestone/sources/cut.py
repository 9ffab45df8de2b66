"""Cutting lineage at a table that all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """df, written below ``spark.checkpoint.dir`` and read back.

    Loops that build on it don't grow their plan, and a lost executor loses nothing. Only
    where no checkpoint folder is set and the master is this machine (tests) a temporary one is.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            known = context._jsc.sc().getCheckpointDir()
        path = known.get()
    path = f"{path.rstrip('/')}/cut-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, *order: str) -> DataFrame:
    """df with ``position``, the place of each row in the order of some columns, from 0.

    Rows are dealt into ranges; a range's offset is the number of rows in the ranges before
    it. Only the ranges' counts ever meet in one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("place", place).join(F.broadcast(offsets), "range").withColumn("position", F.col("before") + F.col("place") - 1).drop("range", "place", "before")
