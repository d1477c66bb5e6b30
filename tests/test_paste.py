"""Pasted rows: over a sheet, behind its rows, as a new sheet."""

import pytest

from gridloom.operators.stages import Workbook


def test_modes_of_a_paste(spark):
    one, two = spark.createDataFrame([(1, "a")], "k int, t string"), spark.createDataFrame([(2.5, "b")], "k double, t string")
    book = Workbook(spark)
    book.add("pasted_here", one)
    book.apply("pasted_here", lambda df: df.filter("k > 0"), track=False)
    book.paste("pasted_here", two, "append")
    assert sorted(map(tuple, spark.table("pasted_here").collect())) == [(1.0, "a"), (2.5, "b")] and len(book.get("pasted_here").steps) == 2
    # the append is a step: it is replayed over other rows and its input has a fingerprint
    assert book.get("pasted_here").replay(one.limit(0)).count() == 1 and book.get("pasted_here").track()[1]
    book.paste("pasted_here", two)
    assert spark.table("pasted_here").count() == 1 and book.get("pasted_here").steps == [] and book.get("pasted_here").replay(one).count() == 1
    assert book.paste("pasted_new", two, "new").df.count() == 1 and set(book.stages) == {"pasted_here", "pasted_new"}
    with pytest.raises(ValueError, match="already exists"):
        book.paste("pasted_new", two, "new")
    with pytest.raises(ValueError, match="Unknown mode"):
        book.paste("pasted_new", two, "upsert")
    with pytest.raises(ValueError, match="Column names differ"):
        book.paste("pasted_new", two.withColumnRenamed("t", "u"), "append")
    book.add("pasted_empty")
    with pytest.raises(ValueError, match="No data"):
        book.paste("pasted_empty", two, "append")
