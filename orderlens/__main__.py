"""Command line: ``python -m orderlens --tables FOLDER --out FOLDER [--jobs NAME ...]``.

Reads one CSV file or folder per table and writes the ten main reports, or the
named jobs, each into its own folder. Session settings come from spark-submit.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from orderlens.plans.workflow import Analysis, export_reports
from orderlens.sources.csv import read_csv_tables, write_csv
from orderlens.sources.schemas import TABLE_SCHEMAS


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orderlens", description=__doc__)
    parser.add_argument("--tables", required=True, help="folder with a file or folder per table")
    parser.add_argument("--suffix", default=".csv", help="what follows the table name; empty for folders")
    parser.add_argument("--out", required=True, help="new folder for the results")
    parser.add_argument("--jobs", nargs="+", help="jobs to run instead of the ten reports")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("orderlens").getOrCreate()
    paths = {name: f"{options.tables.rstrip('/')}/{name}{options.suffix}" for name in TABLE_SCHEMAS}
    analysis = Analysis(read_csv_tables(spark, paths))
    if not options.jobs:
        export_reports(analysis, options.out)
        return
    jobs = analysis.jobs()
    unknown = sorted(set(options.jobs) - set(jobs))
    if unknown:
        parser.error(f"unknown jobs: {', '.join(unknown)}")
    for name in options.jobs:
        write_csv(jobs[name](), f"{options.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
