"""Every registered query against its SQL in DuckDB: names, types and values."""

import re

import compare
import pytest

import __spark_entry__ as entry_points
from orderlens.sample.oracle import sample_oracle
from orderlens.sample.queries import sample_queries

DIRECTORY = "/root/testdata/sf0.001"
# The larger tables hold cases that the small ones don't, such as reviewed orders without any score.
DIRECTORIES = [DIRECTORY, "/root/testdata/sf0.01"]
QUERIES = sample_queries()
ORACLE = sample_oracle()


@pytest.fixture(scope="module")
def connections():
    return {directory: compare.connect(directory) for directory in DIRECTORIES}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("directory", DIRECTORIES)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connections, name, directory):
    # SQL that ends with an order says that the order of rows is part of the result.
    ordered = re.search(r"ORDER BY [^()]*$", ORACLE[name].strip()) is not None
    assert compare.differences(QUERIES[name](spark, directory), connections[directory], ORACLE[name], ordered) == []


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
