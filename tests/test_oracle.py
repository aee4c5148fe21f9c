"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DEFAULT, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(DEFAULT)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, name, DEFAULT)
    assert not problems, "\n".join(problems)
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
