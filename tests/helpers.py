import datetime as dt

from barquality.operators.normalize import row_hash
from barquality.schema import BAR_COLUMNS, MINUTE

from pyspark.sql import functions as F

UTC = dt.UTC


def at(minute, day=dt.date(2024, 3, 4), hour=15):
    return dt.datetime.combine(day, dt.time(hour), UTC) + dt.timedelta(minutes=minute)


def bars(spark, rows, frequency=MINUTE):
    """Canonical bars from (contract, ts, open, high, low, close, volume[, trading_date])."""
    full = [(r[0], r[1], r[7] if len(r) > 7 else r[1].date(), *map(_f, r[2:6]), r[6]) for r in rows]
    df = spark.createDataFrame(full, "contract string, ts timestamp, trading_date date, open double, high double, low double, close double, volume long")
    df = df.withColumns({"root": F.lit("C"), "exchange": F.lit("X"), "frequency": F.lit(frequency), "open_interest": F.lit(None).cast("bigint"), "source_file": F.lit("m"), "ingested_at": F.lit(at(0))})
    return df.withColumn("row_hash", row_hash()).select(*BAR_COLUMNS)


def _f(x):
    return None if x is None else float(x)


def flat(contract, times, price=10.0, volume=100):
    return [(contract, t, price, price, price, price, volume) for t in times]
