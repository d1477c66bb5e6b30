from gridloom import streaming


def test_search_and_conversion_on_a_stream(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, "5 kg"), (2, "x"), (3, "11")], "id int, v string").write.parquet(source)
    stream = streaming.find(streaming.convert(streaming.read(spark, source, "id int, v string"), "v", "integer"), "v", "gt", "4")
    streaming.write(stream, out, f"file://{tmp_path}/checkpoint").awaitTermination(60)
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, 5), (3, 11)]
