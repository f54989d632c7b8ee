"""Every registered query against its SQL twin."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from tools.check_oracle import compare

NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]  # those have tests of their own


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    message, ok = compare(spark, duck, name, SF_DIR)
    assert ok, message


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) - set(entry.oracle_sql()) == {"l11_format_bench"}
