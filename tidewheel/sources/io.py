"""Sources and sinks: Parquet, CSV, JDBC with planned partitions, and resumable stage outputs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as types_


T = TypeVar("T")


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """One or more files or folders; columns and filter reach the scan. Raises FileNotFoundError with a hint."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        df = spark.read.parquet(*paths)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{paths}: run the stage that writes it first") from e
        raise
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | types_.StructType | None = None) -> DataFrame:
    """CSV with a header; all strings unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_reports(parts: dict[str, DataFrame], path: str, key: str = "factor") -> None:
    """Reports of many factors as one table partitioned by `key`, instead of a file for each."""
    from functools import reduce

    from pyspark.sql import functions as F

    write_parquet(reduce(DataFrame.unionByName, [d.withColumn(key, F.lit(k)) for k, d in parts.items()]), path, [key])


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Result of a stage: read where it is complete, else built and written. An empty result keeps its schema."""
    if force or not _complete(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def chunked_stage(spark: SparkSession, path: str, chunks: dict[str, T], build: Callable[[T], DataFrame], force: bool = False) -> DataFrame:
    """Union of the results of all chunks (name -> what `build` takes, such as a date window and a batch of ids).

    Every chunk has a folder of its own and is built only where it isn't complete, so a run that was cut short goes
    on with the chunks that are left. All chunks have one schema; there must be at least one.
    """
    folders = []
    for name, chunk in chunks.items():
        folders.append(f"{path}/{name}")
        cached_stage(spark, folders[-1], lambda c=chunk: build(c), force)
    return spark.read.parquet(*folders)


def date_chunks(start: dt.date, end: dt.date | None, max_days: int) -> list[tuple[dt.date, dt.date]]:
    """Contiguous inclusive windows of at most max_days days; the last is clipped, no end means today."""
    end = end or dt.date.today()
    out = []
    while start <= end:
        stop = min(start + dt.timedelta(days=max_days - 1), end)
        out.append((start, stop))
        start = stop + dt.timedelta(days=1)
    return out


def batched(items: Iterable, n: int) -> Iterator[list]:
    """Lists of n items, the last may be shorter."""
    items = list(items)
    for i in range(0, len(items), n):
        yield items[i : i + n]


def overlap_predicates(start: dt.date, end: dt.date | None, max_days: int, begin: str, finish: str) -> list[str]:
    """One predicate per date window, for a partitioned read of rows whose text years overlap the window."""
    return [f"({begin} ~ '^[0-9]+$' AND CAST({begin} AS INT) <= {b.year} AND ({finish} IS NULL OR LOWER({finish}) = 'curr' OR ({finish} ~ '^[0-9]+$' AND CAST({finish} AS INT) >= {a.year})))" for a, b in date_chunks(start, end, max_days)]


class JdbcSource:
    """A remote database, read lazily and in parallel where predicates are given."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, fetch_size: int = 50_000):
        self.spark, self.url = spark, url
        self.properties = {"fetchsize": str(fetch_size)} | (properties or {})

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.properties).load()

    def table(self, schema: str, name: str, columns: list[str] | None = None, limit: int | None = None, predicates: list[str] | None = None) -> DataFrame:
        at = f"{schema}.{name}"
        df = self.spark.read.jdbc(self.url, at, predicates=predicates, properties=self.properties) if predicates else self.spark.read.jdbc(self.url, at, properties=self.properties)
        df = df.select(*columns) if columns else df
        return df.limit(limit) if limit is not None else df
