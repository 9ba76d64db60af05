import duckdb
import pytest

from plumeline.plans import queries as plans


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_customers_and_users_whole(spark, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    for t in ("customer", "events"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = sorted(tuple(r) for r in plans.QUERIES["set_agreement"](spark, d).collect())
    assert got == sorted(c.sql(plans.ORACLES["set_agreement"]).fetchall())
    have, seen = ({r[0] for r in c.sql(f"select {k} from {t}").fetchall()} for k, t in (("c_custkey", "customer"), ("user_id", "events")))
    assert got == sorted([(k, "left") for k in have - seen] + [(k, "right") for k in seen - have]) and have != seen
