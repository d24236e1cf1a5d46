import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

CHEAP = ["drop_no_fix", "latest", "fov_filter", "quality_gates", "parse_lines", "gid_summary", "confusion", "with_mean", "voxel_down", "flight_log_strict"]
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(res.fetchall(), key=key)


NATIVE = ["asof_nearest", "locate_boxes_center", "fuse_boxes", "build_gallery", "rolling_rate", "consistent_points"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in plan


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
