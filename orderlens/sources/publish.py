"""Tables written for others to read: staged, checked, and published by a manifest.

``publish_tables`` writes each table into a new folder and counts rows and NULLs while it
writes. The written rows are counted again (Parquet answers from its footers), and only if all counts agree a manifest
names the folders. A reader takes the last manifest, so it sees all tables of one version
or all of another, and a run that fails leaves the version before as it was.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.catalog import Tables, new_id, remove_folder

PROFILE_SCHEMA = "table_name string, column_name string, total_rows long, null_rows long"


def observed(df: DataFrame, metrics: Observation) -> DataFrame:
    """The frame, whose rows and NULLs per column are counted by whatever job reads it."""
    nulls = [F.count_if(F.col(f"`{name}`").isNull()).alias(f"null_{i}") for i, name in enumerate(df.columns)]
    return df.observe(metrics, F.count(F.lit(1)).alias("rows"), *nulls)


def publish_tables(spark: SparkSession, tables: Mapping[str, DataFrame], directory: str) -> dict[str, Any]:
    """Write tables as the next version of a directory; returns its manifest.

    One scan of each table writes and profiles it. Raises if the files hold another
    number of rows than went into them; then, and if a write fails, the staged
    folders are removed and the last version stays.
    """
    root = directory.rstrip("/")
    staged = f"{root}/versions/{new_id()}"
    manifest: dict[str, Any] = {"tables": {}}
    try:
        for name, df in tables.items():
            metrics = Observation()
            path = f"{staged}/{name}"
            observed(df, metrics).write.parquet(path)
            counted = metrics.get
            written = spark.read.schema(df.schema).parquet(path).count()
            if written != counted["rows"]:
                raise ValueError(f"{path} holds {written} rows, but {counted['rows']} went into it")
            manifest["tables"][name] = {
                "path": path,
                "schema": df.schema.json(),
                "rows": counted["rows"],
                "nulls": {column: counted[f"null_{i}"] for i, column in enumerate(df.columns)},
            }
        version = (last_version(spark, root) or 0) + 1
        manifest["version"] = version
        _write_new(spark, f"{root}/manifests/{version:08}.json", json.dumps(manifest))
    except BaseException:
        remove_folder(spark, staged)
        raise
    return manifest


def last_version(spark: SparkSession, directory: str) -> int | None:
    files, path = _files(spark, f"{directory.rstrip('/')}/manifests")
    if not files.exists(path):
        return None
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return max((int(name.removesuffix(".json")) for name in names if name.endswith(".json")), default=None)


def manifest_of(spark: SparkSession, directory: str, version: int | None = None) -> dict[str, Any]:
    """The manifest of a version, or of the last one."""
    version = last_version(spark, directory) if version is None else version
    if version is None:
        raise ValueError(f"{directory} has no published version")
    path = f"{directory.rstrip('/')}/manifests/{version:08}.json"
    return json.loads("".join(row["value"] for row in spark.read.text(path, wholetext=True).collect()))


def read_published(spark: SparkSession, directory: str, version: int | None = None) -> Tables:
    """The tables of a published version, the last one if none is given."""
    manifest = manifest_of(spark, directory, version)

    def table(entry: dict[str, Any]) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])

    return Tables({name: partial(table, entry) for name, entry in manifest["tables"].items()})


def profile(spark: SparkSession, manifest: Mapping[str, Any]) -> DataFrame:
    """Rows and NULLs of each column as counted while the tables were written; no further scan."""
    rows = [
        (name, column, entry["rows"], nulls)
        for name, entry in manifest["tables"].items()
        for column, nulls in entry["nulls"].items()
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def _files(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet: under another name first, then renamed."""
    files, target = _files(spark, path)
    _, hidden = _files(spark, f"{path}.{new_id()}.tmp")
    out = files.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.exists(target) or not files.rename(hidden, target):
        files.delete(hidden, False)
        raise ValueError(f"{path} exists: another run has published this version")
