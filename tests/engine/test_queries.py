import math

import duckdb
import pytest

import __spark_entry__
from plumeline.plans import queries as plans

SF = "/root/testdata/sf0.001"
CHECKED = ["time_status", "day_completeness", "missing_region_hours", "cadence", "conic_grid", "region_weights", "time_scales", "raster_match", "period_changes", "decomposition", "grouped_totals", "contribution_statistics", "anomaly_flags", "robust_limits", "point_in_polygon", "global_moran", "local_moran", "category_counts", "dynamic_features", "even_sample", "daily_grid", "hour_checks", "reconciliation", "read_back_checks", "read_back_totals", "category_counts_by_group", "scale_exponents", "comparison_names", "lookup_join", "union_means", "unrecoverable_records", "infinite_counts", "complete_cases"]


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT"):
            return ""
        return f"{float(v):.9g}" if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    got, expected = plans.QUERIES[name](spark, SF).toPandas(), sql.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_attributions_add_up(spark):
    from plumeline.operators import models

    data = plans._customers(spark, SF)
    fitted = models.fit(models.boosted(plans.FEATURES, "target", trees=4, rate=0.5, depth=3), data)
    parts = models.attributions(data, fitted.stages[-1], plans.FEATURES, "key").join(fitted.transform(data).select("key", "prediction"), "key").collect()
    assert parts and all(math.isclose(r.base_value + sum(r[f] for f in plans.FEATURES), r.prediction, rel_tol=1e-6, abs_tol=1e-3) for r in parts)
