"""Label archives as a data source: members of zip files, read by ranges of their directories.

The driver reads only each archive's central directory, at its end. A partition is a range of members of
one archive, of some BYTES compressed bytes, so an archive of any size is read by many tasks, none of which
holds it whole; a member is the largest thing in memory. Members are read in the order of archives and
their directories. Splits and archives are chosen by options, so that others are never opened (filters
are not taken over: Spark keeps those of a frame's first scan for its later ones). The fields of records
are parsed by Spark; members are not unpacked where records are not wanted.

Paths are opened through pyarrow's file systems (local, HDFS, S3 and GCS by their URIs).
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Compressed bytes of a partition.
BYTES = 32 << 20
SCHEMA = "split string, archive string, member string, json string"


def opened(path: str) -> pa.NativeFile:
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(at)


def listed(path: str) -> list[str]:
    """Files under a folder, sorted; none where there is no folder."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    root = path.removesuffix(at)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
    return sorted(root + f.path for f in found if f.type == fs.FileType.File)


@dataclass
class Members(InputPartition):
    """Members first to last (not included) of an archive, by their places in its directory."""

    split: str
    path: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.limit = options["path"], int(options.get("bytes", BYTES))
        self.prefix, self.bare = options.get("member_prefix", "LAB_"), options.get("records", "true") == "false"
        self.splits = dict(x.split("=", 1) for x in options.get("splits", "Training=TL_,Validation=VL_").split(","))
        self.archives = set(filter(None, options.get("archives", "").split(",")))

    def partitions(self) -> list[Members]:
        out = []
        for split, prefix in self.splits.items():
            for path in listed(f"{self.root}/{split}"):
                name = path.rsplit("/", 1)[-1]
                if not (name.startswith(prefix) and name.endswith(".zip")) or (self.archives and name not in self.archives):
                    continue
                with opened(path) as file, zipfile.ZipFile(file) as z:
                    first, held = 0, 0
                    entries = z.infolist()
                    for i, entry in enumerate(entries):
                        if held and held + entry.compress_size > self.limit:
                            out.append(Members(split, path, first, i))
                            first, held = i, 0
                        held += entry.compress_size
                    if entries:
                        out.append(Members(split, path, first, len(entries)))
        return out

    def read(self, partition: Members | None) -> Iterator[tuple]:
        if partition is None:  # no archives
            return
        archive = partition.path.rsplit("/", 1)[-1]
        with opened(partition.path) as file, zipfile.ZipFile(file) as z:
            for entry in z.infolist()[partition.first : partition.last]:
                base = entry.filename.rsplit("/", 1)[-1]
                if base.startswith(self.prefix) and base.endswith(".json"):
                    yield partition.split, archive, entry.filename, None if self.bare else z.read(entry).decode("utf-8")


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def members(spark: SparkSession, root: str, **options) -> DataFrame:
    """(split, archive, member, json) of label archives under root.

    Options: splits (folder=prefix,...), archives (names, all if empty), member_prefix, bytes (of a
    partition), records="false" (json is null, nothing is unpacked).
    """
    spark.dataSource.register(Archives)
    return spark.read.format(Archives.name()).options(**{k: str(v) for k, v in options.items()}).load(root)


def labels(spark: SparkSession, root: str, schema: str, **options) -> DataFrame:
    """(split, archive, member, record)."""
    return members(spark, root, **options).select("split", "archive", "member", F.from_json("json", schema).alias("record"))
