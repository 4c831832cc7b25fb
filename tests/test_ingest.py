import pytest
from pyspark.sql import functions as F

from turnlake.operators import ingest

SECTORS = {"10": "Energy", "45": "Information Technology"}


def _calls(spark):
    rows = [(" aa ", f"202{y}-06-15", 2020 + y, 2, "[]", " ") for y in range(3)] + [("bb", "2020-06-15", 2020, 2, "[]", "Bee"), ("aa", "2019-06-15", 2019, 2, "[]", ""), ("aa", "bad", 2020, 1, "[]", "")]
    return spark.createDataFrame(rows, "symbol string, date string, year int, quarter int, structured_content string, company string")


def _facts(spark, code=45):
    return spark.createDataFrame([("AA", "2020-03-31", "Aa Corp", code, 451020), ("AA", "2021-06-15", "Aa New", code, 451020)], "tic string, datadate string, conm string, gsector int, gsubind int")


def test_ingest(spark):
    calls = ingest.clean_calls(_calls(spark), [2020, 2021, 2022])
    assert {r.ticker for r in calls.collect()} == {"AA"} and calls.count() == 3
    out = {r.year: r for r in ingest.with_fundamentals(calls, _facts(spark), SECTORS).collect()}
    assert out[2020].Company_name == "Aa Corp" and out[2021].Company_name == "Aa New"  # an exact match counts
    assert out[2022].sector == "Information Technology" and out[2022].industry_code == "GICS_00451020"


def test_errors(spark):
    calls = ingest.clean_calls(_calls(spark), [2020, 2021, 2022])
    with pytest.raises(ValueError, match="no sector"):
        ingest.with_fundamentals(calls, _facts(spark, 99), SECTORS)
    with pytest.raises(ValueError, match="without earlier"):
        ingest.with_fundamentals(calls, _facts(spark).filter("datadate > '2021'"), SECTORS)
    with pytest.raises(ValueError, match="null values"):
        ingest.require(calls.withColumn("year", F.lit(None)), ["year"])
    with pytest.raises(ValueError, match="repeated"):
        ingest.require(calls.unionByName(calls), ["ticker"], ["ticker", "year"])
