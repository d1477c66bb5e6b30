"""Table texts that are longer than a task's stretch of lines."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import texttable

TOP = "Title\tDate\tDirector\tWriter(s)\tProducer\tMusic\nStory\tScreenplay\n"
TEXTS = [
    "List\nCountry\tCity\tPeople\n" + "\n".join(f"Land{k}[a]\tTown{k}\t{k}" for k in range(20)),
    "name,age\n" + "\n".join(f"n{k},{k}" for k in range(23)),
    "Rank\tCity\tProvince\tA\tB\tC\n" + "\n".join(f"{k}\nTown{k}\tP{k}\t{k}0\t{k}1\t{k}2" for k in range(1, 17)),
    "Rank\tAnimal\tMass\t\n\t\t(m)\n\t\t\tOrigin[a]\n\tfoo\n" + "\n".join(f"{k}\tcat{k}\t5\tasia" for k in range(1, 15)),
    TOP + "\n".join(f"Film{k}\tMay 1, 2019\tAnn\tBob" + "\nCo-director: Cy\t" * (k % 6) for k in range(12)),
    "City\tState\tPop.\tArea\tPlace\n\tmi2\tkm2\t\nx\t\t\t\t\n" + "\n".join(f"Town{k}\tNY\t{k}\t300\t40°N 74°W" for k in range(17)),
    "a\tb\nsingle\nword\n1\t2\ntitle\nanother title\nthird title\n3\t4",
    "one\tline",
    "",
    None,
]


def everything(spark, parity):
    rows, meta = texttable.parse_tables(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), parity)
    return sorted(map(tuple, rows.withColumn("cells", F.to_json("cells")).collect())), sorted(map(tuple, meta.collect()))


@pytest.mark.parametrize("parity", [False, True])
def test_stretches_of_lines_change_nothing(spark, monkeypatch, parity):
    want = everything(spark, parity)
    if not parity:
        assert {m[1] for m in want[1]} == {"messy", "plain", "split", "multiline", "spanning", "complex", "single"}
    monkeypatch.setattr(texttable, "SEGMENT", 3)
    assert everything(spark, parity) == want


def test_one_text_of_many_lines_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(texttable, "SEGMENT", 50)
    top = spark.createDataFrame([(7, 0, TOP.split("\n")[0]), (7, 1, TOP.split("\n")[1])], "id int, at bigint, line string")
    # every tenth line begins a record; one record runs over several stretches
    body = spark.range(2, 4002).select(F.lit(7).alias("id"), F.col("id").alias("at"), F.when((F.col("id") % 10 == 2) & ~F.col("id").between(1003, 1302), F.format_string("Film%d\tMay 1, 2019\tAnn\tBob", "id")).otherwise("Co: Cy\t").alias("line"))
    lines = top.unionByName(body)
    marked = texttable._with_edges(lines, "at", 1, 2).groupBy("id", "seg").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect()
    assert max(r.n for r in marked) == 53 and sum(r.own for r in marked) == 4002 and len(marked) == 81
    rows, meta = texttable.parse_lines(lines)
    got = {r.row_no: r.cells for r in rows.collect()}
    assert meta.first().layout == "spanning" and len(got) == 1 + 400 - 30 and sorted(got) == list(range(len(got)))
    assert got[1][0] == "Film2" and got[1][4:] == ["Co: Cy", "; ".join(["Co: Cy"] * 8)]
    assert got[101][0] == "Film1002" and got[101][5].count("Co: Cy") == 308 and got[102][0] == "Film1312"
