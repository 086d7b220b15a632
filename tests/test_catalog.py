import duckdb
import pytest

from barquality import catalog
from barquality.functions import clock, display
from barquality.schema import CODES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, con, name):
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and len(CODES) == 17


def test_display_and_parsing(spark):
    row = spark.range(1).select(
        display.price(F.lit(1234.5)), display.price(F.lit(0.12345)), display.count(F.lit(12345)), display.signed_percent(F.lit(None).cast("double")), display.signed_percent(F.lit(-1.234)),
        clock.to_long(F.lit(" 12 ")), clock.to_long(F.lit("1.0")), clock.to_double(F.lit("1e3")), clock.to_double(F.lit("1.5d")), clock.to_day(F.lit("2024")), clock.to_day(F.lit("2024-02-03T04:05:06")).cast("string"),
    ).first()
    assert tuple(row) == ("1,234.50", "0.1235", "12,345", "—", "-1.23%", 12, None, 1000.0, None, None, "2024-02-03")
