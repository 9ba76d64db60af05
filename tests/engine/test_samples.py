import pytest
from pyspark.sql import functions as F

from plumeline.operators import quality


def positions(total, n):
    return sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})


@pytest.mark.parametrize("files", [3, 40])
def test_evenly_spaced_rows_of_a_large_table(spark, tmp_path, files):
    # keys 3 * i in no order; more rows than a sample of range bounds would read
    n = 700_000
    spark.range(n).select((F.col("id") * 524_287 % n * 3).alias("k")).repartition(files).write.parquet(f"{tmp_path}/t")
    for _ in range(3):
        got = sorted(r.k for r in quality.evenly_spaced(spark.read.parquet(f"{tmp_path}/t"), "k", 10).collect())
        assert got == [3 * i for i in positions(n, 10)]


def test_evenly_spaced_rows_with_nulls_and_equal_keys(spark):
    rows = [(None,)] * 40 + [(7,)] * 150 + [(i,) for i in range(100, 211)]
    ordered = sorted((r[0] for r in rows if r[0] is not None)) + [None] * 40
    got = [r.k for r in quality.evenly_spaced(spark.createDataFrame(rows, "k long").repartition(5), "k", 12).collect()]
    assert sorted(got, key=lambda k: (k is None, k)) == [ordered[i] for i in positions(301, 12)]
    named = spark.createDataFrame([(f"n{i:05}",) for i in range(4000)], "k string")
    assert sorted(r.k for r in quality.evenly_spaced(named, "k", 5).collect()) == [f"n{i:05}" for i in positions(4000, 5)]
