"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.sources.shared import shared_dir

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`; also what bytes.split() and bytes.strip() use.
WHITE = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths written since scratch() was entered, where it was.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/fungo-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder, wherever that lies."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """At the end, removes the tables that operators wrote within; write what outlives it elsewhere before."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        paths = _WRITTEN.get()
        _WRITTEN.reset(token)
        remove(spark, *paths)


def cut_lineage(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back.

    A lost executor then costs its running tasks only, and later passes read narrow
    columnar files instead of repeating the work before.
    """
    path = shared_path(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of these sizes that hold about `limit` bytes each (one row at least), to bound a task's memory."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def column(name: str) -> Column:
    """The column of exactly this name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, carry: tuple[str, ...]) -> tuple[list, list[T.StructField]]:
    """Columns that travel beside an operator's own, under names that cannot clash, and their fields."""
    fields = [T.StructField(f"_c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
    return [column(c).alias(f.name) for c, f in zip(carry, fields)], fields


def with_fields(schema: str, fields: list[T.StructField]) -> T.StructType:
    """A schema of simple types, and further fields of any type."""
    return T.StructType([*T.StructType.fromDDL(schema).fields, *fields])


def uncarried(carry: tuple[str, ...]) -> list:
    """Gives carried columns their names back."""
    return [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]


def map_text(df: DataFrame, key: str, text: str, schema: str, make: Callable[[], Callable], limit: int = 4_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs `make()(keys, texts)` over slices of rows; it returns the columns of `schema`.

    `make` is called once per task, so that tables are loaded once.  Texts arrive as
    UTF-8 bytes (null: None), whole, in slices of about `limit` bytes.  Columns in `carry`
    come out beside the results, as _c0, _c1 and so on (see uncarried); where the text is
    one of them it is sent to the workers once, for both.
    """
    columns, more = carried(df, carry)
    places = np.cumsum([1, *(c != text for c in carry)]).tolist()  # of each carried column behind the text, in what is sent
    source = [1 if c == text else n for c, n in zip(carry, places[1:])]
    columns = [x for c, x in zip(carry, columns) if c != text]
    names = [x.split()[0] for x in schema.split(", ")] + [f"_c{i}" for i in range(len(carry))]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        f = make()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), limit):
                got = f(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())
                beside = [batch.column(i).slice(a, b - a) for i in source]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in got] + beside, names=names)

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), *columns).mapInArrow(run, with_fields(schema, more))


#: Keys that hold more than one of this many rows are joined apart.
HOT_SHARE = 1000


def join_by_share(left: DataFrame, right: DataFrame, on: str | list[str], rows: str, total: int) -> DataFrame:
    """left JOIN right on `on`, where `right` tells for each key the number of its rows in `left` (column `rows`, left out), `total` in all.

    Keys with over 1/HOT_SHARE of the rows number fewer than HOT_SHARE, so their side is
    broadcast and their rows stay where they are; the others are shuffled, none of them a
    large part of a task.
    """
    is_hot = F.col(rows) * HOT_SHARE > total
    hot, cold = right.filter(is_hot).drop(rows), right.filter(~is_hot).drop(rows)
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def list_array(lists: list, kind) -> pa.Array:
    return pa.array(lists, type=pa.list_(kind))
