import pytest

from ..conftest import spark  # noqa: F401 - the session fixture

BLANK = "[^\\x20\\x09-\\x0D]+"

#: Texts that every operator on documents has to bear.
ODD = [None, "", " ", "\n\n", "a", "é é\né é", "x " * 60, "one two three four", "😀 tab\tnew\r\nline   still", " nbsp word"]


def documents(spark, texts, **extra):
    """A documents table: ids from 0, some columns that clash with names used inside, given texts."""
    rows = [(i, t, f"src{i % 3}" if i % 7 else None, 7, "own", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _k string, mask double")


@pytest.fixture()
def odd_documents(spark):  # noqa: F811
    base = documents(spark, ODD)
    again = base.filter("doc_id in (5, 6)")  # repeated rows
    return base.union(again).union(spark.createDataFrame([(None, "no id here", "src1", 1, "x", 0.0)], base.schema))
