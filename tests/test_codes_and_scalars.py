import math

import pytest
from pyspark.sql import functions as F

from stationflow.functions import codes, scalars

POINTS = {
    "AT/SPO.09.A23.65516.6001.1": ("AT", None, "A23"), "AT/SPO.09.ENK.1.6001.1": ("AT", "ENK", "ENK"), "BE/SPO-BETR817_06001_100": ("BE", "TR817", "BETR817"),
    "ES/SP_28079056_9_47": ("ES", "28079056", "28079056"), "FI/SPO-FI00208_06001_100": ("FI", "00208", "FI00208"), "FR/SPO-FR04024_6001": ("FR", "04024", "FR04024"),
    "XX/SPO-1": ("XX", None, None), "noslash": ("noslash", None, None),
}


def test_station_codes(spark):
    df = spark.createDataFrame([(p,) for p in POINTS], "p string")
    p = F.col("p")
    got = {r["p"]: (r["c"], r["s"], r["e"]) for r in df.select("p", codes.country_of(p).alias("c"), codes.site_number(p).alias("s"), codes.eoi_code(p).alias("e")).collect()}
    assert got == POINTS


def test_local_time_over_summer_time_changes(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-03-31 00:30:00', 'AT'), (TIMESTAMP '2024-03-31 01:00:00', 'AT'), (TIMESTAMP '2024-10-27 00:30:00', 'FI'), (TIMESTAMP '2024-10-27 00:30:00', 'ZZ') AS t(ts, c)")
    got = [r[0] for r in df.select(F.date_format(scalars.local_time(F.col("ts"), F.col("c")), "HH:mm")).collect()]
    assert got == ["01:30", "03:00", "03:30", "00:30"]


def test_sentinels_and_infinity_are_null(spark):
    df = spark.createDataFrame([(x,) for x in (-999.0, -0.1, 0.0, None, float("nan"), float("inf"), 2.5)], "v double")
    assert [r[0] for r in df.select(scalars.non_negative(F.col("v"))).collect()] == [None, None, 0.0, None, None, float("inf"), 2.5]
    assert [r[0] for r in df.select(scalars.finite(F.col("v"))).collect()][-3:] == [None, None, 2.5]


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (1.0, 1, 0.5), (0.0, 5, 1.0), (2.581, 999, 0.010), (12.706205, 1, 0.05)])
def test_student_p_against_tables(t, df, p):
    assert math.isclose(scalars.student_p(t, df), p, rel_tol=2e-3)
    assert scalars.student_p(-t, df) == scalars.student_p(t, df)


def test_labels_from_one_hots(spark):
    df = spark.createDataFrame([("urban",), ("rural",), (None,)], "a string").select(*scalars.one_hot("a", ["rural", "urban"], "StationArea"))
    assert [r[0] for r in df.select(scalars.label_by_argmax("StationArea", ["rural", "urban"])).collect()] == ["urban", "rural", "rural"]
    assert [r[0] for r in df.select(scalars.label_by_priority("StationArea", ["urban", "rural"])).collect()] == ["urban", "rural", "unknown"]


def test_number_texts(spark):
    df = spark.createDataFrame([(1234.5,), (None,)], "v double")
    assert [r[0] for r in df.select(scalars.number_text(F.col("v"))).collect()] == ["1,234.50", ""]
