"""Every query with a SQL form gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from stationflow.plans import queries  # noqa: F401
from stationflow.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(table):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v if isinstance(v, (str, bool, type(None))) else float(v)

    names = sorted(table.column_names)
    return names, sorted((tuple(one(r[c]) for c in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = rows(con.sql(ORACLE_SQL[name]).to_arrow_table())
    assert rows(QUERIES[name](spark, SF).toArrow()) == expected


def test_flagship_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_the_feature_table_moves_its_rows_twice_after_the_aggregations(spark):
    x = QUERIES["f1_feature_table"](spark, SF)
    x.write.format("noop").mode("overwrite").save()
    plan = x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [e.split("ENSURE")[0] for e in plan.split("Exchange hashpartitioning")[1:]]
    # two aggregations by site and hour; parts for filling and parts with a halo; the summaries of parts, once by part and once by station
    assert sum("ts#" in e for e in exchanges) <= 4 and sum("_part#" in e for e in exchanges) <= 4


def test_lags_leads_and_rolling_share_one_exchange(spark):
    from stationflow.operators import timeseries
    from stationflow.sources import fixtures

    w = spark.createDataFrame([("AT", "0", 0, 1.0)], "country string, site_number string, t long, pm25 double").selectExpr("*", "timestamp_seconds(t) AS ts")
    new = lambda k: {**timeseries.lag_columns(["pm25"], [1, 24], k), **timeseries.rolling_columns(["pm25"], [3, 6], k), **timeseries.target_columns("pm25", [1, 3], k)}
    x = timeseries.in_slices(w, lambda rows, k: rows.withColumns(new(k)), 24, 3)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and fixtures.COUNTRIES[0] == "AT"
