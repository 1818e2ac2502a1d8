"""Registered queries: names, and results against SQL where SQL can express them."""

import re

import compare
import pytest

import __spark_entry__ as entry_points
from orderlens.llm.oracle import llm_oracle
from orderlens.llm.queries import llm_queries

DIRECTORY = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in llm_queries()]
    assert numbers == list(range(1, len(numbers) + 1))
    assert {*llm_queries(), "pipeline"} <= set(entry_points.queries())
    assert set(llm_oracle()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_query_matches_sql(spark, name):
    result = llm_queries()[name](spark, DIRECTORY)
    assert compare.differences(result, compare.connect(DIRECTORY), llm_oracle()[name]) == []
