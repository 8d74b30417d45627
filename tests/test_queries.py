"""Every registered query against its SQL, and the shape of the others."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from postweave.plans import catalog

WITH_SQL = sorted(catalog.SQL)
WITHOUT_SQL = sorted(set(catalog.QUERIES) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(built, con, name):
    assert differences(built(name), con, name) == []


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_gives_rows(built, name):
    df = built(name)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_comparison_notices_a_difference(built, con, monkeypatch):
    changed = dict(entry.oracle_sql())
    changed["text_length"] = changed["text_length"].replace("length(tweet)", "length(tweet) + 1")
    monkeypatch.setattr(entry, "oracle_sql", lambda: changed)
    assert differences(built("text_length"), con, "text_length")


def test_entry(spark):
    names = [r["name"] for r in entry.entry(spark).collect()]
    assert "Fires" in names and "weighted avg" in names
