"""Text files that queries write are compressed: plain ones were most of their disk."""

import glob

import pytest

from flowloom.plans.catalog import QUERIES
from flowloom.session import shared_folder


@pytest.fixture
def written(spark, small):
    """Runs a query; the files it wrote to folders of a purpose."""

    def run(name, purpose):
        def files():
            return {f for f in glob.glob(f"{shared_folder(spark)}/{purpose}-*/part-*")}

        before = files()  # of other runs
        rows = QUERIES[name](spark, small).collect()
        return rows, files() - before

    return run


def test_text_csv_is_compressed(written):
    rows, files = written("a05_write_csv", "text-csv")
    assert rows and files and all(f.endswith(".csv.gz") for f in files)


def test_checked_files_are_written_without_a_shuffle(spark, small, monkeypatch):
    """All columns used to be shuffled and sorted by class before they were written; rows are named by file and class either way."""
    from pyspark.sql.classic.dataframe import DataFrame

    for step in ("hint", "sortWithinPartitions"):
        monkeypatch.setattr(DataFrame, step, lambda *a, **kw: pytest.fail("rows are moved"))
    found = QUERIES["b01_validate_columns"](spark, small)
    assert {(r["column"], r["status"]) for r in found.collect()} == {("Rate", "missing"), ("kind", "extra")}
