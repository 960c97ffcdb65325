"""Files by content: hashes in blocks, snapshots of folders and what changed between two."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task holds of a file at once.
BLOCK_BYTES = 1 << 20


def snapshot(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, bytes, sha256) of each file under root, empty ones too. The driver lists them; tasks read them block by block, so that no file is held whole.

    Files are listed and read by pyarrow's file systems (local paths, hdfs, s3, gs). For stores that only Spark reads, gps.file_checksums hashes whole values.
    """
    from pyarrow import fs

    system, base = file_system(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(root)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with own.open_input_stream(path) as stream:
                    while block := stream.read(block_bytes):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["path", "bytes", "sha256"])

    listed = [(i.path, i.size) for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
    rows = spark.createDataFrame(listed, "path string, bytes long")
    return rows.repartition(max(1, min(len(listed), 8 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(run, "path string, bytes long, sha256 string")


def file_system(path: str):
    """(file system, path in it) of a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status): added, lost, changed or same, from two snapshots; paths must be unique in each."""
    a = before.select("path", F.col("sha256").alias("_before"))
    b = after.select("path", F.col("sha256").alias("_after"))
    status = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "lost").when(F.col("_before") != F.col("_after"), "changed").otherwise("same")
    return a.join(b, "path", "full").select("path", status.alias("status"))
