"""Helpers shared by the training-data operators: table reading, clean columns, generated column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.sources.scratch import saved, shared_folder  # noqa: F401  used by the operators


#: Bytes of a batch that a Python worker turns into objects at once, about; Spark's batches hold up to 10,000 rows or 64 MB.
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about SLICE_BYTES each, of one row at least: a worker's memory doesn't follow the size of Spark's batches."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def own_name(what: str) -> str:
    """A column name that no input has."""
    return f"_{what}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def usable_vectors(df: DataFrame, key: str, vector: str, zero_ok: bool = True) -> DataFrame:
    """One row per non-null key with a finite, null-free vector of the table's usual length.

    Rows with a null key, a null or empty vector, or null or non-finite components take no part; repeated keys count once
    (the smallest vector); vectors whose length differs from the most common one (the longer of ties) take no part.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    good = good.where(F.coalesce(finite, F.lit(False)))
    if not zero_ok:
        good = good.where(F.exists(F.col(vector), lambda x: x != 0))
    good = saved(good.groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.min(vector).alias("vector")), "vectors")  # read several times
    usual = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.where(F.size("vector") == (usual[0]["n"] if usual else 0))
