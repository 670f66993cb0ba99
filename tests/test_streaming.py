from lexivane.streaming.append import append_lines, append_records, appended


def test_batches_are_appended_once(spark, tmp_path):
    spec = "id string, content string, vector map<string,float>"
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(f"r{i}", None, {"a": 1.0, f"t{i}": 2.0})], spec).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(spec).parquet(str(source))
        append_records(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    records = appended(spark, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in records) == ["r0", "r1", "r2"] and len({r.rec_no for r in records}) == 3
    assert appended(spark, str(tmp_path / "out"), "entries").count() == 6


def test_lines_are_validated(spark, tmp_path):
    spec = "line_no long, feed string, raw_line string"
    spark.createDataFrame([(1, "jsonl", '{"id": 1, "vector": {"a": 1}}'), (2, "jsonl", "{")], spec).write.parquet(str(tmp_path / "in"))
    append_lines(spark.readStream.schema(spec).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.id for r in appended(spark, str(tmp_path / "out"), "loaded").collect()] == ["1"]


def test_numbers_of_batches_do_not_meet(spark, tmp_path):
    """Also of batches with more partitions than the numbers within a partition would leave room for."""
    spec = "id string, content string, vector map<string,float>"
    source = tmp_path / "in"
    for i in range(2):
        rows = [(f"r{i}-{j}", None, {"a": 1.0}) for j in range(260)]
        spark.createDataFrame(rows, spec).repartition(130).write.mode("append").parquet(str(source))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            append_records(spark.readStream.schema(spec).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    numbers = [r.rec_no for r in appended(spark, str(tmp_path / "out")).collect()]
    assert len(numbers) == len(set(numbers)) == 520 and {n >> 40 for n in numbers} == {0, 1}
