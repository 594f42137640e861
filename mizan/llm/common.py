"""Shared pieces of the training-data operators: tables in the shared folder, batch limits, safe table reads."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import arrow_limits, shared_dir  # noqa: F401  (operators take both from here)

_LIVE: list[str] = []
#: For tables of rows of many MB: a row group is closed by its size, looked at after each row. Readers hold a row group, and
#: Parquet else looks first after a hundred rows.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def saved(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors. options: of
    the writer.

    Such tables are removed by ``scratch``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(paths: list[str]) -> None:
    sc = SparkContext._active_spark_context
    if sc is None:
        return
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _LIVE.remove(p)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is saved inside is removed at the end, but for what was saved by the function that this gives: the tables that
    the result still reads."""
    start, kept = len(_LIVE), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        at = len(_LIVE)
        out = saved(df, name)
        kept.add(_LIVE[at])
        return out

    yield keep
    _remove([p for p in _LIVE[start:] if p not in kept])


atexit.register(lambda: _remove(list(_LIVE)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row() -> Column:
    """All columns of a row as one, so that an operator's own columns can't clash with them."""
    return F.struct("*").alias("row")
