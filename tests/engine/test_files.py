import pytest
from pyspark.sql import functions as F

from plumeline.sources import files
from plumeline.streaming.hourly import hourly_sums


def test_dated_scan_and_policies(spark, tmp_path):
    root = str(tmp_path / "days")
    for day in ("2018-02-01", "2018-02-02", "2018-02-05"):
        spark.range(3).withColumn("time", F.lit(day)).write.parquet(f"{root}/population_{day}.parquet")
    df, missing, extra = files.dated_scan(spark, root, "2018-02-01", "2018-02-03", ["id"])
    assert df.count() == 6 and missing == ["2018-02-03"] and extra == ["2018-02-05"]
    assert files.input_days("2018-02-02", "2018-02-02") == ["2018-02-01", "2018-02-02", "2018-02-03"]
    assert files.input_days("2018-02-02", "2018-02-02", "local") == ["2018-02-01", "2018-02-02"]
    with pytest.raises(ValueError):
        files.days("2018-02-02", "2018-02-01")
    there, not_there = f"{root}/population_2018-02-01.parquet", f"{root}/x.parquet"
    assert not files.outputs_missing(spark, [there]) and files.outputs_missing(spark, [not_there])
    with pytest.raises(FileExistsError):
        files.outputs_missing(spark, [there, not_there])
    stats = files.footer_statistics(spark, [there], ["id"]).agg(F.sum("n_rows"), F.min("min_text"), F.max("max_text")).first()
    assert tuple(stats) == (3, "0", "2")


def test_raw_lines_and_manifest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("2018-02-01 00:00:00;1\n;2\nno separator\nx;3")
    wanted = spark.createDataFrame([("a.txt", n) for n in (1, 2, 3, 4, 9)] + [("b.txt", 1)], "source_file string, line_no int")
    got = {(r.source_file, r.line_no): r.line_status for r in files.exact_lines(spark, str(tmp_path / "raw"), wanted).collect()}
    assert got == {("a.txt", 1): "valid_time", ("a.txt", 2): "blank_time", ("a.txt", 3): "no_separator", ("a.txt", 4): "unparseable_time", ("a.txt", 9): "missing_line", ("b.txt", 1): "missing_file"}
    old, new = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int"), spark.createDataFrame([("d2", 5)], "day string, n int")
    assert sorted(tuple(r) for r in files.newest_per_key(old, new, "day").collect()) == [("d1", 1), ("d2", 5)]


def test_stream_of_hours(spark, tmp_path):
    root = str(tmp_path / "in")
    spark.sql("select timestamp'2018-02-01 00:10:00' + make_interval(0,0,0,0,0,20*id) as utc_time, cast(id % 2 as int) as region, id as cnt from range(30)").write.parquet(root)
    stream = spark.readStream.schema("utc_time timestamp, region int, cnt long").parquet(root)
    q = hourly_sums(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = hourly_sums(spark.read.parquet(root)).collect()
    emitted = spark.sql("select * from hours").collect()
    assert emitted and set(map(tuple, emitted)) <= set(map(tuple, batch))
