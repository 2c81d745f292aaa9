"""Shared helpers of the training-data operators: tables, durable cuts, text rules."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, shared_path

#: The six ASCII white-space characters that separate words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: The same class for Java regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths made since :func:`scratch` began, for each one under way.
_scratches: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = shared_path(spark, label)
    if _scratches:
        _scratches[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete what is at ``path``, if anything is."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables and files that operators have made in it; what is made of them must
    be written by then, to a path from before."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            delete(spark, path)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks after the cut only. The tables live
    under ``<spark.checkpoint.dir>/loomlog-<application id>``, until :func:`forget`, the end
    of :func:`scratch`, or :func:`clean_up`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`durable` that only tables already written were made from."""
    for table in tables:
        delete(table.sparkSession, table._durable_path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder: tables that results still read from."""
    delete(spark, f"{shared_dir(spark)}/loomlog-{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: Column | str) -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus: neither is ever broadcast, at any size."""
    return left.join(right.hint("merge"), on, how)
