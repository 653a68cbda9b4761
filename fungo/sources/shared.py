"""Tables in the folder that all executors share, and joins that a hot key does not crowd."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is joined by broadcast at most, as counted.
SMALL = 100_000
#: Keys that hold more than one of this many rows are joined apart.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a fresh local one only where it is unset and all runs in this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fungo-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/fungo-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table of the shared folder: a lost executor costs its running tasks only, later passes read narrow files."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_keys(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows JOIN table on keys that are unique and not null in `table`; column `size` tells the rows of each key and is left out.

    A table of up to SMALL rows is broadcast.  Of a larger one only the keys with over
    1/HOT_SHARE of the rows are, fewer than HOT_SHARE; the others meet in a shuffle in
    which none is a large part of a task.
    """
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= SMALL:
        return rows.join(F.broadcast(table.drop(size)), on)
    is_hot = F.col(size) * HOT_SHARE > total
    hot, cold = table.filter(is_hot).drop(size), table.filter(~is_hot).drop(size)
    seldom = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(seldom)
