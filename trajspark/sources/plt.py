"""The format "plt": GPS logs root/<user>/Trajectory/<file>.plt as a Spark data source, one partition a group of files.

    spark.dataSource.register(PltSource)
    spark.read.format("plt").option("users", "000,001").option("filesPerUser", 5).load(root)

Folders are listed and files read by pyarrow's file systems (local paths, hdfs, s3, gs); read_plt does the same for stores that only Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import file_system

SCHEMA = "user_id string, trajectory_id string, line int, timestamp timestamp_ntz, latitude double, longitude double, altitude double"
#: Bytes of files that one partition reads together, and rows of a batch.
GROUP_BYTES, BATCH_ROWS = 64_000_000, 50_000


@dataclass
class FileGroup(InputPartition):
    """(user, trajectory, path) of the files that one task reads."""

    files: list[tuple[str, str, str]]


class PltSource(DataSource):
    """Options: users (comma-joined; all without it), filesPerUser (the first ones by name), headerLines (6), missing (error or skip)."""

    @classmethod
    def name(cls) -> str:
        return "plt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PltReader:
        return PltReader(self.options)


def find_files(root: str, users: list[str] | None, limit: int | None, missing: str) -> list[tuple[str, str, str, int]]:
    """(user, trajectory, path, bytes) of each wanted user's files by name. Missing users, and users without files, are named in an error or skipped."""
    from pyarrow import fs

    system, base = file_system(root)
    base = base.rstrip("/")
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    there = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)
    out, lacking = [], []
    for user in users if users is not None else there:
        folder = f"{base}/{user}/Trajectory"
        found = sorted((i for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and i.base_name.endswith(".plt")), key=lambda i: i.base_name)
        if not found:
            lacking.append(user)
        out += [(user, i.base_name[:-4], i.path, i.size) for i in found[:limit]]
    if lacking and missing != "skip":
        raise ValueError(f"users without files: {', '.join(lacking)}")
    return out


class PltReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("load(path) or the option path is needed")
        self.root = options["path"]
        self.users = [u.strip() for u in options["users"].split(",") if u.strip()] if "users" in options else None
        self.limit = int(options["filesPerUser"]) if "filesPerUser" in options else None
        self.header = int(options.get("headerLines", 6))
        self.missing = options.get("missing", "error")

    def partitions(self) -> list[FileGroup]:
        groups, size = [FileGroup([])], 0
        for user, trajectory, path, length in find_files(self.root, self.users, self.limit, self.missing):
            if size and size + length > GROUP_BYTES:
                groups.append(FileGroup([]))
                size = 0
            groups[-1].files.append((user, trajectory, path))
            size += length
        return groups

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        for user, trajectory, path in partition.files:
            yield from self._file(user, trajectory, path)

    def _file(self, user: str, trajectory: str, path: str) -> Iterator[pa.RecordBatch]:
        import io

        import pandas as pd

        system, _ = file_system(self.root)
        with system.open_input_stream(path) as stream:
            lines = io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", errors="replace")
            number, held = -1, []

            def batch() -> pa.RecordBatch:
                frame = pd.DataFrame([(n, *(t.split(",") + [None] * 7)[:7]) for n, t in held], columns=["line", *range(7)])
                at = pd.to_datetime(frame[5].str.strip().str.cat(frame[6].str.strip(), sep=" ", na_rep=""), format="%Y-%m-%d %H:%M:%S", errors="coerce")
                numbers = [pa.array(pd.to_numeric(frame[k].str.strip(), errors="coerce"), pa.float64(), from_pandas=True) for k in (0, 1, 3)]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([user] * len(frame)), pa.array([trajectory] * len(frame)), pa.array(frame["line"], pa.int32()), pa.array(at, pa.timestamp("us"), from_pandas=True), *numbers], ["user_id", "trajectory_id", "line", "timestamp", "latitude", "longitude", "altitude"])

            for number, text in enumerate(lines):
                text = text.rstrip("\r\n")
                if number >= self.header and text.strip(" "):
                    held.append((number, text))
                    if len(held) >= BATCH_ROWS:
                        yield batch()
            if held:
                yield batch()
