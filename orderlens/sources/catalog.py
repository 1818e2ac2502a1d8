"""Names for tables, and the folder for tables written between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


class Tables(Mapping[str, DataFrame]):
    """DataFrames by table name, each opened on first use."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def register_tables(tables: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Make each table available to SQL under its short name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def new_id() -> str:
    """A name that nothing has yet."""
    return uuid.uuid4().hex


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not yet in use, below the shared folder named by ``spark.checkpoint.dir``.

    Every executor must reach it. Where the setting is missing, a master in one
    process gets a temporary folder; on a cluster it is an error, as each machine
    would write to a disk of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master!r} share")
        shared = tempfile.mkdtemp(prefix="orderlens-")
    return f"{shared.rstrip('/')}/{name}-{new_id()}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a frame that several jobs will read, and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and not a
    re-run of the joins, and each reader still gets column pruning and filters.
    The folder is ``path`` if given, else a new one of this name; it stays until
    ``remove_folder``.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored tables, in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
