import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barquality.operators import analytics
from helpers import at, bars, flat

FIVE = [(71.5, 72.25, 71.0, 72.0, 40), (72.0, 73.5, 71.75, 73.25, 15), (73.25, 73.25, 70.5, 70.75, 65), (70.75, 71.0, 70.75, 71.0, 5), (71.0, 72.5, 70.75, 72.25, 30)]


def test_daily_bar_of_five_minutes(spark):
    rows = [("C", at(i), *r) for i, r in enumerate(FIVE)]
    d = analytics.daily_ohlcv(bars(spark, rows[::-1])).first()
    assert tuple(d)[2:] == (71.5, 73.5, 70.5, 72.25, 155, None, 5)


def test_daily_bar_skips_nulls_and_nan_and_counts_null_volume_as_zero(spark):
    rows = [("C", at(0), None, 11, 9, 10, None), ("C", at(1), 10, float("nan"), float("nan"), None, None)]
    d = analytics.daily_ohlcv(bars(spark, rows)).first()
    assert (d["open"], d["high"], d["low"], d["close"], d["volume"], d["bar_count"]) == (10.0, 11.0, 9.0, 10.0, 0, 2)


def test_vwap_across_a_break(spark):
    rows = [x for m, p in ((0, 10.0), (1, 20.0), (61, 30.0), (62, 40.0)) for x in flat("C", [at(m)], p)]
    out = analytics.rolling_vwap(bars(spark, rows), 5).orderBy("ts").collect()
    assert [r["vwap"] for r in out] == [10, 15, 30, 35]


def test_vwap_edges_peers_zero_volume_and_midnight(spark):
    day = dt.date(2024, 3, 4)
    late = dt.datetime(2024, 3, 4, 23, 59, tzinfo=dt.UTC)
    rows = [("A", at(0), 1, 1, 1, 1, 0), ("A", at(1), 2, 2, 2, 2, None), *flat("B", [at(0)], 10.0), *flat("B", [at(0)], 30.0), *flat("B", [at(5)], 50.0)]
    rows += flat("N", [late], 10.0) + flat("N", [late + dt.timedelta(minutes=2)], 20.0)
    out = {}
    for r in analytics.rolling_vwap(bars(spark, rows), 5).collect():
        out.setdefault(r["contract"], []).append(r["vwap"])
    assert out["A"] == [None, None] and sorted(out["B"]) == [20, 20, 50] and sorted(out["N"]) == [10, 15]
    assert day
    with pytest.raises(ValueError):
        analytics.rolling_vwap(bars(spark, rows), 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2000), st.floats(1, 100), st.integers(0, 500)), min_size=1, max_size=30), st.integers(1, 1440))
def test_vwap_matches_a_plain_sum(spark, ticks, window):
    rows = [x for m, p, v in ticks for x in flat("C", [at(m)], p, v)]
    for r in analytics.rolling_vwap(bars(spark, rows), window).collect():
        inside = [(p, v) for m, p, v in ticks if r["ts"].replace(tzinfo=dt.UTC) - dt.timedelta(minutes=window) < at(m) <= r["ts"].replace(tzinfo=dt.UTC)]
        total = sum(v for _, v in inside)
        assert (r["vwap"] is None) == (total <= 0)
        if total:
            assert r["vwap"] == pytest.approx(sum(p * v for p, v in inside) / total)


def test_latest_range_change_and_chart(spark):
    rows = [x for m, p in ((0, 10.0), (1, 20.0), (2, 15.0)) for x in flat("C", [at(m)], p)]
    b = bars(spark, rows)
    top = analytics.latest(analytics.rolling_vwap(b, 5), 2).collect()
    assert len(top) == 2 and all(r["total_points"] == 3 and r["truncated"] for r in top)
    change = analytics.range_change(analytics.daily_ohlcv(b)).first()
    assert change["change_pct"] is None and change["last_close"] == 15.0 and change["total_volume"] == 300
    again = flat("F", [dt.datetime(2024, 11, 3, 6, 30, tzinfo=dt.UTC), dt.datetime(2024, 11, 3, 7, 15, tzinfo=dt.UTC), dt.datetime(2024, 11, 3, 8, 30, tzinfo=dt.UTC)])
    kept = analytics.chart_points(bars(spark, again)).select("ts").collect()
    assert len(kept) == 2
    with_range = analytics.default_range(analytics.catalogue(b)).first()
    assert with_range["start"] == with_range["end"] == dt.date(2024, 3, 4)
