"""Sinks that can be run again: sorted CSV, blocks that a retried run replaces, tables that are read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.checks import row_digest
from trajspark.operators.guards import guarded

CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_sorted_csv(df: DataFrame, path: str, columns: list[str], order: list[str], files: int | None = None) -> None:
    """CSV files with a header and exactly `columns`, in `order` over all files: part n holds what comes before part n + 1. Refuses to overwrite.

    Rows are dealt by ranges of the order, so no task sorts them all. Times have microseconds; null is an empty field, empty strings are quoted.
    """
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).select(*columns).write.mode("errorifexists")
    writer.option("timestampNTZFormat", CSV_TIME).csv(path, header=True, timestampFormat=CSV_TIME, nullValue="", emptyValue='""', escapeQuotes=True)


def append_blocks(df: DataFrame, path: str, block: list[str]) -> None:
    """Adds blocks, the values of the `block` columns, to a partitioned table. A block that is written again, by a retried or restarted run, takes the
    place of the former one; blocks that df does not hold stay as they are. A block appears when its job has been committed, not before."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*block).parquet(path)


def missing_blocks(spark: SparkSession, path: str, wanted: DataFrame, block: list[str]) -> DataFrame:
    """The wanted blocks that are not there yet, for a run that goes on where another one stopped. A path without anything lacks them all."""
    try:
        there = spark.read.parquet(path).select(*block).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return wanted.select(*block).distinct()
    kinds = dict(wanted.dtypes)
    return wanted.select(*block).distinct().join(there.select(*[F.col(c).cast(kinds[c]).alias(c) for c in block]), block, "left_anti")


def write_verified(tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Writes each table to root/name, refusing to overwrite any, and reads it back; every returned table fails its job unless the rows' number and digest,
    over all columns, are those that were written. Nothing is written where one of the folders stands already."""
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in tables:
        path = hadoop(f"{root}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileExistsError(f"{root}/{name}")
    out = {}
    for name, df in tables.items():
        by = (partition_by or {}).get(name, [])
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{root}/{name}").select(*df.columns)
        out[name] = guarded(back, differences(df, back))
    return out


def differences(written: DataFrame, back: DataFrame) -> DataFrame:
    """One row: by how many rows two tables differ in number, and 1 if their digests do; the digest does not depend on the order."""
    side = lambda df, n: row_digest(df, df.columns).select(F.col("rows").alias(f"rows{n}"), F.col("digest").alias(f"digest{n}"))
    j = side(written, 0).join(F.broadcast(side(back, 1)), F.lit(True))  # one row each
    return j.select(F.abs(F.col("rows0") - F.col("rows1")).alias("rows"), (~F.col("digest0").eqNullSafe(F.col("digest1"))).cast("int").alias("digest"))
