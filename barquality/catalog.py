"""Every query of the engine by name, with its DuckDB counterpart.

The SQL states each operator from its definition, in another way than the plan.
Figures that are rounded for comparison are moved off exact ties by a hair on
both sides, as the last bits of a sum depend on its order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clock, display
from .operators import analytics, duplicates, evidence, gaps, normalize, occurrences, outliers, values
from .plans import report, store
from .schema import CODES, DAILY, MINUTE, OHLC, Settings
from .sources import derived, readers

TIGHT = Settings(outlier_mad_threshold=3.0, volume_spike_threshold=3.0)
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_O: dict[str, str] = {}


def query(sql: str, dates: tuple[str, ...] = ()):
    """Register a query and its SQL; both show ``dates`` as ISO text."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in dates})

        _Q[f.__name__] = run if dates else f
        shown = ", ".join(f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dates)
        _O[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql}) AS q" if dates else sql
        return f

    return add


def naive(name: str = "ts") -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


_BARS_OF = """bars AS (
  SELECT event_type AS contract, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, event_id) AS close, CAST(sum(user_id) AS BIGINT) AS volume
  FROM {0} GROUP BY 1, 2)"""
INTRADAY = _BARS_OF.format("events")
#: What one type has on three days came three days earlier, which leaves an extended gap.
GAPPED = _BARS_OF.format("(SELECT * REPLACE (CASE WHEN event_type = 'click' AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-12' THEN ts - INTERVAL 3 DAY ELSE ts END AS ts) FROM events)")
CHICAGO = "timezone('America/Chicago', timezone('UTC', {0}))"
DATED = f"dated AS (SELECT *, CAST({CHICAGO.format('ts')} AS DATE) AS trading_date FROM bars)"
DAYS = """days AS (
  SELECT o_orderpriority AS contract, CAST(o_orderdate AS DATE) AS trading_date, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)"""
DIRTY = f"""{INTRADAY}, hours AS (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 AS h FROM bars), dirty AS (
  SELECT contract, ts, CASE WHEN h % 13 = 0 THEN high + 5 WHEN h % 19 = 0 THEN 0.0 ELSE open END AS open,
         CASE WHEN h % 11 = 0 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN h % 17 = 0 THEN low - 5 WHEN h % 23 = 0 THEN CAST('inf' AS DOUBLE) ELSE close END AS close,
         CASE WHEN h % 29 = 0 THEN -volume WHEN h % 31 = 0 THEN NULL ELSE volume END AS volume FROM hours)"""
LINES = """lines AS (
  SELECT concat('P', l_partkey) AS contract, CAST(l_shipdate AS TIMESTAMP) AS ts, l_extendedprice AS price,
         CAST(trunc(l_quantity) AS BIGINT) AS volume, l_orderkey * 100 + l_linenumber AS row_number FROM lineitem),
  twice AS (SELECT * FROM lines UNION ALL SELECT contract, ts, price, volume, row_number + 1000000000000 FROM lines WHERE (row_number // 100) % 50 = 0)"""
GAPS = f"""{GAPPED}, actives AS (SELECT contract, coalesce(min(ts) FILTER (WHERE volume > 0), min(ts)) AS a FROM bars GROUP BY 1),
  steps AS (SELECT contract, ts, lag(ts) OVER (PARTITION BY contract ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT b.contract, ts FROM bars b JOIN actives USING (contract) WHERE ts >= a)),
  spaced AS (SELECT *, date_diff('second', prev_ts, ts) AS gap_s FROM steps WHERE prev_ts IS NOT NULL),
  modal AS (SELECT contract, gap_s AS expected_s FROM (SELECT contract, gap_s, row_number() OVER (PARTITION BY contract ORDER BY count(*) DESC, gap_s) AS r, sum(count(*)) OVER (PARTITION BY contract) AS n FROM spaced WHERE gap_s > 0 GROUP BY 1, 2) WHERE r = 1 AND n >= 10),
  wide AS (SELECT s.*, expected_s, CAST({CHICAGO.format('prev_ts')} AS DATE) AS d0, CAST({CHICAGO.format('ts')} AS DATE) AS d1 FROM spaced s JOIN modal USING (contract) WHERE gap_s > 1.5 * expected_s),
  flagged AS (SELECT *, d1 > d0 AND (isodow(d0) >= 5 OR isodow(d1) = 1) AS weekend FROM wide),
  classified AS (SELECT contract, prev_ts, ts, gap_s, expected_s, gap_s // expected_s - 1 AS missing_bars, round(gap_s / 60.0, 1) AS gap_minutes,
    CASE WHEN weekend THEN 'session_break' WHEN gap_s > 129600 THEN 'extended_gap' WHEN d1 > d0 THEN 'session_break' ELSE 'intra_session_gap' END AS code, weekend FROM flagged)"""


# -- analytics ---------------------------------------------------------------


@query(f"""WITH {INTRADAY}, {DATED} SELECT contract, trading_date,
  (SELECT round(open, 6) FROM dated x WHERE x.contract = d.contract AND x.trading_date = d.trading_date ORDER BY ts LIMIT 1) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
  (SELECT round(close, 6) FROM dated x WHERE x.contract = d.contract AND x.trading_date = d.trading_date ORDER BY ts DESC LIMIT 1) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bar_count FROM dated d GROUP BY contract, trading_date""", dates=("trading_date",))
def daily_ohlcv(spark, sf_dir):
    return analytics.daily_ohlcv(derived.intraday_bars(spark, sf_dir)).select("contract", "trading_date", *rounded(*OHLC), "volume", "bar_count")


@query(f"WITH {DAYS} SELECT contract, trading_date, open, high, low, close, volume, CAST(1 AS BIGINT) AS bar_count FROM days", dates=("trading_date",))
def daily_passthrough(spark, sf_dir):
    return analytics.daily_passthrough(derived.daily_bars(spark, sf_dir)).drop("open_interest")


def _vwap_sql(minutes: int) -> str:
    return f"""WITH {INTRADAY} SELECT a.contract, a.ts, CAST(sum(b.volume) AS BIGINT) AS window_volume,
      CASE WHEN sum(b.volume) > 0 THEN round(sum((b.high + b.low + b.close) / 3 * b.volume) / sum(b.volume) + 1.23e-11, 9) END AS vwap
      FROM bars a JOIN bars b ON a.contract = b.contract AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL {minutes} MINUTE GROUP BY 1, 2"""


@query(_vwap_sql(180))
def rolling_vwap_180m(spark, sf_dir):
    return analytics.rolling_vwap(derived.intraday_bars(spark, sf_dir), 180).select("contract", naive(), "window_volume", F.round(F.col("vwap") + 1.23e-11, 9).alias("vwap"))


@query(_vwap_sql(360))
def rolling_vwap_360m(spark, sf_dir):
    return analytics.rolling_vwap(derived.intraday_bars(spark, sf_dir), 360).select("contract", naive(), "window_volume", F.round(F.col("vwap") + 1.23e-11, 9).alias("vwap"))


@query(f"""WITH points AS ({_vwap_sql(180)}) SELECT contract, ts, vwap, (SELECT count(*) FROM points) AS total_points, (SELECT count(*) FROM points) > 500 AS truncated FROM points ORDER BY contract DESC, ts DESC LIMIT 500""")
def vwap_latest_n(spark, sf_dir):
    points = analytics.rolling_vwap(derived.intraday_bars(spark, sf_dir), 180)
    return analytics.latest(points, 500).select("contract", naive(), F.round(F.col("vwap") + 1.23e-11, 9).alias("vwap"), "total_points", "truncated")


@query(f"""WITH {INTRADAY}, {DATED}, {DAYS} SELECT contract, 'minute' AS frequency, left(contract, 2) AS root, 'TEST' AS exchange, min(trading_date) AS first_date, max(trading_date) AS last_date, count(*) AS bar_count FROM dated GROUP BY 1
  UNION ALL SELECT contract, 'daily', left(contract, 2), 'TEST', min(trading_date), max(trading_date), count(*) FROM days GROUP BY 1""", dates=("first_date", "last_date"))
def contract_catalogue(spark, sf_dir):
    return analytics.catalogue(derived.intraday_bars(spark, sf_dir).unionByName(derived.daily_bars(spark, sf_dir)))


@query(f"WITH {DAYS} SELECT contract, trading_date, close, volume FROM days WHERE contract = '1-URGENT' AND trading_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", dates=("trading_date",))
def bar_scan_filtered(spark, sf_dir):
    return analytics.scan(derived.daily_bars(spark, sf_dir), DAILY, "1-URGENT", "1996-01-01", "1996-12-31").select("contract", "trading_date", "close", "volume")


@query(f"""WITH {DAYS} SELECT contract, round((arg_max(close, trading_date) - arg_min(close, trading_date)) / arg_min(close, trading_date) * 100, 6) AS change_pct, arg_max(close, trading_date) AS last_close, CAST(sum(volume) AS BIGINT) AS total_volume FROM days GROUP BY 1""")
def range_change(spark, sf_dir):
    return analytics.range_change(derived.daily_bars(spark, sf_dir)).select("contract", *rounded("change_pct"), "last_close", "total_volume")


@query(f"""WITH {INTRADAY}, {DATED}, c AS (SELECT contract, min(trading_date) AS f, max(trading_date) AS l FROM dated GROUP BY 1)
  SELECT contract, 'minute' AS frequency, greatest(CAST(l - INTERVAL 30 DAY AS DATE), f) AS start, l AS "end" FROM c""", dates=("start", "end"))
def default_chart_range(spark, sf_dir):
    return analytics.default_range(analytics.catalogue(derived.intraday_bars(spark, sf_dir)))


@query(f"""WITH {INTRADAY} SELECT contract, ts, CAST(epoch({CHICAGO.format('ts')}) AS BIGINT) AS wall_s FROM bars""")
def chart_wall_seconds(spark, sf_dir):
    return analytics.chart_points(derived.intraday_bars(spark, sf_dir)).select("contract", naive(), "wall_s")


@query(f"WITH {INTRADAY} SELECT DISTINCT contract FROM bars")
def contract_names(spark, sf_dir):
    return analytics.contracts(derived.intraday_bars(spark, sf_dir))


@query(f"""WITH {INTRADAY} SELECT contract, ts, CASE WHEN close < open THEN 'down' ELSE 'up' END AS colour, strftime({CHICAGO.format('ts')}, '%d/%m/%Y, %H:%M:%S') AS exchange_time, strftime({CHICAGO.format('ts')}, '%H:%M') AS clock, printf('%+.2f%%', (close - open) / open * 100 + 1e-7) AS change FROM bars""")
def chart_labels(spark, sf_dir):
    bars = derived.intraday_bars(spark, sf_dir)
    zone = "America/Chicago"
    change = display.signed_percent((F.col("close") - F.col("open")) / F.col("open") * 100 + 1e-7)
    return bars.select("contract", naive(), display.candle(F.col("open"), F.col("close")).alias("colour"), clock.exchange_datetime(F.col("ts"), zone).alias("exchange_time"), clock.exchange_clock(F.col("ts"), zone).alias("clock"), change.alias("change"))


# -- single-row checks -------------------------------------------------------

_CHECKS = {
    "high_lt_low": "high < low",
    "open_out_of_range": "open > high OR open < low",
    "close_out_of_range": "close > high OR close < low",
    "non_positive_price": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "non_finite_price": "NOT (isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close))",
    "negative_volume": "volume < 0",
    "missing_volume": "volume IS NULL",
}


def _check(code: str):
    def run(spark, sf_dir):
        found = values.invalid_values(derived.intraday_bars_dirty(spark, sf_dir), MINUTE).where(F.col("code") == code)
        return found.select("contract", naive(), *rounded("open", "high", "low"), F.round("close", 6).cast("string").alias("close"), F.coalesce(F.col("volume").cast("string"), F.lit("none")).alias("volume"))

    run.__name__ = code
    query(f"""WITH {DIRTY} SELECT contract, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, CASE WHEN isinf(close) THEN 'Infinity' ELSE CAST(round(close, 6) AS VARCHAR) END AS close, coalesce(CAST(volume AS VARCHAR), 'none') AS volume FROM dirty WHERE {_CHECKS[code]}""")(run)


for _code in _CHECKS:
    _check(_code)


# -- duplicates, conflicts, upserts --------------------------------------------


@query(f"""WITH {LINES} SELECT contract, ts, round(price, 4) AS close, volume, count(*) - 1 AS extra_copies, count(*) AS copies FROM twice GROUP BY contract, ts, price, volume HAVING count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    found = duplicates.exact_duplicates(derived.line_bars(spark, sf_dir))
    return found.select("contract", naive(), F.round("close", 4).alias("close"), "volume", (F.col("copies") - 1).alias("extra_copies"), "copies")


@query(f"""WITH {LINES} SELECT contract, ts, count(*) AS rows, count(DISTINCT (price, volume)) AS variants, round(arg_min(price, row_number), 4) AS close FROM twice GROUP BY 1, 2 HAVING count(DISTINCT (price, volume)) > 1""")
def conflicting_duplicates(spark, sf_dir):
    return duplicates.conflicting_duplicates(derived.line_bars(spark, sf_dir)).select("contract", naive(), "rows", "variants", F.round("close", 4).alias("close"))


@query(f"""WITH {LINES} SELECT contract, ts, count(*) AS rows, round(min(price), 4) AS close FROM twice GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT (price, volume)) = 1""")
def repeated_timestamps(spark, sf_dir):
    return duplicates.repeated_timestamps(derived.line_bars(spark, sf_dir)).select("contract", naive(), "rows", F.round("close", 4).alias("close"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``line_bars`` that the queries show, so that no others are shuffled."""
    return derived.line_bars(spark, sf_dir).select("contract", "ts", "close", "volume", "row_number", "row_hash")


_UNIQUE = f"{LINES}, uniq AS (SELECT contract, ts, price, volume, min(row_number) AS row_number FROM twice GROUP BY contract, ts, price, volume)"


@query(f"""WITH {_UNIQUE} SELECT contract, ts, round(price, 4) AS close, volume, row_number FROM uniq QUALIFY row_number() OVER (PARTITION BY contract, ts ORDER BY row_number DESC) = 1""")
def last_write_wins(spark, sf_dir):
    winners, _ = duplicates.last_write_wins(_lines(spark, sf_dir), winning=())
    return winners.select("contract", naive(), F.round("close", 4).alias("close"), "volume", "row_number")


@query(f"""WITH {_UNIQUE}, w AS (SELECT *, first_value(price) OVER (PARTITION BY contract, ts ORDER BY row_number DESC) AS win, row_number() OVER (PARTITION BY contract, ts ORDER BY row_number DESC) AS n FROM uniq)
  SELECT contract, ts, round(price, 4) AS close, volume, row_number, round(win, 4) AS winning_close FROM w WHERE n > 1""")
def superseded_audit(spark, sf_dir):
    _, losers = duplicates.last_write_wins(_lines(spark, sf_dir), winning=("close",))
    return losers.select("contract", naive(), F.round("close", 4).alias("close"), "volume", "row_number", F.round("winning_close", 4).alias("winning_close"))


@query(f"""WITH {_UNIQUE}, w AS (SELECT *, row_number() OVER (PARTITION BY contract, ts ORDER BY row_number DESC) AS n FROM uniq)
  SELECT contract, count(DISTINCT ts) AS instants, count(*) AS discarded_rows, 'superseded_in_file' AS reasons FROM w WHERE n > 1 GROUP BY 1""")
def resolved_conflicts(spark, sf_dir):
    _, losers = duplicates.last_write_wins(_lines(spark, sf_dir).drop("close", "volume"), winning=())
    found = duplicates.resolved_conflicts(losers.withColumn("reason", F.lit(normalize.SUPERSEDED_IN_FILE)))
    return found.select("contract", "instants", "discarded_rows", F.array_join("reasons", ",").alias("reasons"))


def _batch(bars: DataFrame) -> DataFrame:
    """A later delivery: every third day again, of which every second has other closes, and one new day."""
    day = F.datediff("trading_date", F.lit("1995-01-01").cast("date"))
    again = bars.where(day % 3 == 0).withColumn("close", F.when(day % 2 == 0, F.col("close") + 1).otherwise(F.col("close")))
    new = bars.where(day == 0).withColumn("trading_date", F.lit("2005-01-01").cast("date")).withColumn("ts", F.lit("2005-01-01").cast("timestamp"))
    return again.unionByName(new).withColumn("row_hash", normalize.row_hash())


_BATCH = f"""{DAYS}, numbered AS (SELECT *, CAST(trading_date - DATE '1995-01-01' AS BIGINT) AS n FROM days),
  batch AS (SELECT contract, trading_date, CASE WHEN n % 2 = 0 THEN close + 1 ELSE close END AS close FROM numbered WHERE n % 3 = 0 UNION ALL SELECT contract, DATE '2005-01-01', close FROM numbered WHERE n = 0)"""


@query(f"WITH {_BATCH} SELECT contract, trading_date, round(coalesce(b.close, d.close), 4) AS close FROM days d FULL JOIN batch b USING (contract, trading_date)", dates=("trading_date",))
def upsert_result(spark, sf_dir):
    bars = derived.daily_bars(spark, sf_dir)
    return store.merge(bars, _batch(bars)).select("contract", "trading_date", F.round("close", 4).alias("close"))


@query(f"WITH {_BATCH} SELECT contract, trading_date, round(d.close, 4) AS close, 'superseded_by_run' AS reason FROM days d JOIN batch b USING (contract, trading_date) WHERE round(b.close, 4) <> round(d.close, 4)", dates=("trading_date",))
def displaced_by_run(spark, sf_dir):
    bars = derived.daily_bars(spark, sf_dir)
    return store.displaced_rows(bars, _batch(bars)).select("contract", "trading_date", F.round("close", 4).alias("close"), "reason")


# -- gaps ----------------------------------------------------------------------


@query(f"WITH {GAPS} SELECT contract, expected_s FROM modal")
def modal_interval(spark, sf_dir):
    return gaps.modal_interval(gaps.spacings(derived.gapped_bars(spark, sf_dir))).select("contract", "expected_s")


def _gaps(spark, sf_dir, *codes: str) -> DataFrame:
    found = gaps.classified(derived.gapped_bars(spark, sf_dir))
    found = found.where(F.col("code").isin(*codes)) if codes else found
    return found.select("contract", naive("prev_ts"), naive(), "gap_s", "expected_s", "missing_bars", "gap_minutes", "code", "weekend")


_ALL_GAPS = f"WITH {GAPS} SELECT * FROM classified"


@query(_ALL_GAPS)
def gap_classified(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(f"{_ALL_GAPS} WHERE code = 'intra_session_gap'")
def intra_session_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir, "intra_session_gap")


@query(f"{_ALL_GAPS} WHERE code = 'extended_gap'")
def extended_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir, "extended_gap")


@query(f"{_ALL_GAPS} WHERE code = 'session_break'")
def session_breaks(spark, sf_dir):
    return _gaps(spark, sf_dir, "session_break")


_SESSIONS = f"""WITH {DAYS}, kept AS (SELECT * FROM days WHERE trading_date NOT IN (DATE '1996-03-05', DATE '1997-07-09')), s AS (SELECT contract, min(trading_date) AS lo, max(trading_date) AS hi FROM kept GROUP BY 1),
  cal AS (SELECT contract, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS missing_date FROM s) SELECT contract, missing_date FROM cal WHERE isodow(missing_date) <= 5 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.contract = cal.contract AND k.trading_date = cal.missing_date)"""


@query(_SESSIONS, dates=("missing_date",))
def missing_sessions(spark, sf_dir):
    return gaps.missing_sessions(_holed(spark, sf_dir))


def _holed(spark, sf_dir) -> DataFrame:
    return derived.daily_bars(spark, sf_dir).where(~F.col("trading_date").isin("1996-03-05", "1997-07-09"))


@query(_SESSIONS.replace("SELECT contract, missing_date FROM cal", "SELECT contract, CAST(missing_date AS TIMESTAMP) AS ts, strftime(missing_date, '%Y-%m-%d') AS label, 'missing_session' AS classification FROM cal"))
def missing_instants_daily(spark, sf_dir):
    return gaps.missing_daily(_holed(spark, sf_dir)).select("contract", naive(), "label", "classification")


_MISSING = f"""WITH {GAPS}, g AS (SELECT contract, code, unnest(generate_series(prev_ts + to_seconds(expected_s), ts - to_seconds(expected_s), to_seconds(expected_s))) AS ts FROM classified WHERE code IN ('intra_session_gap', 'extended_gap')),
  missing AS (SELECT contract, ts, CASE code WHEN 'intra_session_gap' THEN 'intra_session' ELSE 'extended' END AS classification FROM g)"""


@query(f"{_MISSING} SELECT * FROM missing")
def missing_instants_minute(spark, sf_dir):
    return gaps.missing_instants(derived.gapped_bars(spark, sf_dir)).select("contract", naive(), "classification")


@query(f"{_MISSING} SELECT contract, ts, classification FROM missing ORDER BY contract, ts LIMIT 50 OFFSET 100")
def missing_instants_page(spark, sf_dir):
    _, page = report.missing_timestamps(derived.gapped_bars(spark, sf_dir), MINUTE, 50, 100)
    return page.select("contract", naive(), "classification")


@query(f"{_MISSING} SELECT contract, CAST({CHICAGO.format('ts')} AS DATE) AS day, count(*) AS n FROM missing GROUP BY 1, 2", dates=("day",))
def missing_by_exchange_date(spark, sf_dir):
    return gaps.missing_by_date(derived.gapped_bars(spark, sf_dir))


_MINUTES = """bars AS (SELECT event_type AS contract, date_trunc('minute', ts) AS ts, CAST(sum(user_id) AS BIGINT) AS volume FROM events GROUP BY 1, 2)"""


@query(f"{_MISSING.replace(GAPPED, _MINUTES)} SELECT contract, ts, classification, (SELECT count(*) FROM missing) AS total FROM missing ORDER BY contract, ts LIMIT 500 OFFSET 60000")
def missing_minutes_deep_page(spark, sf_dir):
    total, page = report.missing_timestamps(derived.minute_bars(spark, sf_dir), MINUTE, 500, 60_000)
    return page.select("contract", naive(), "classification", F.lit(total).cast("bigint").alias("total"))


@query(f"{_MISSING.replace(GAPPED, _MINUTES)} SELECT contract, CAST({CHICAGO.format('ts')} AS DATE) AS day, classification, count(*) AS n, min(ts) AS first, max(ts) AS last FROM missing GROUP BY 1, 2, 3", dates=("day",))
def missing_minutes_by_date(spark, sf_dir):
    slices = gaps.missing_slices(derived.minute_bars(spark, sf_dir))
    return slices.groupBy("contract", "day", "classification").agg(F.sum("n").alias("n"), F.min("first").cast("timestamp_ntz").alias("first"), F.max("last").cast("timestamp_ntz").alias("last"))


# -- outliers ------------------------------------------------------------------

_OUTLIERS = f"""{INTRADAY}, r AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY contract ORDER BY ts) AS ret FROM bars WHERE close > 0), m AS (SELECT contract, median(ret) AS med FROM r GROUP BY 1 HAVING count(*) >= 30),
  d AS (SELECT contract, median(abs(ret - med)) AS mad FROM r JOIN m USING (contract) GROUP BY 1), scored AS (SELECT r.*, abs(ret - med) / (1.4826 * mad) AS score FROM r JOIN m USING (contract) JOIN d USING (contract) WHERE mad > 0)"""
_SPIKES = f"""{INTRADAY}, w AS (SELECT *, CASE WHEN count(*) OVER f >= 20 THEN quantile_cont(volume, 0.5) OVER f END AS local_median FROM bars WINDOW f AS (PARTITION BY contract ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_OUTLIERS} SELECT contract, ts, round(ret, 6) AS log_return, round(score, 1) AS mad_score, round(close, 6) AS close FROM scored WHERE score > 3")
def price_return_outliers(spark, sf_dir):
    return outliers.price_return_outliers(derived.intraday_bars(spark, sf_dir), TIGHT).select("contract", naive(), "log_return", "mad_score", *rounded("close"))


@query(f"WITH {_SPIKES} SELECT contract, ts, round(local_median, 4) AS local_median, round(volume / local_median, 1) AS x_median, volume FROM w WHERE local_median > 0 AND volume > 3 * local_median AND (SELECT count(*) FROM bars b WHERE b.contract = w.contract) >= 50")
def volume_spikes(spark, sf_dir):
    return outliers.volume_spikes(derived.intraday_bars(spark, sf_dir), TIGHT).select("contract", naive(), F.round("local_median", 4).alias("local_median"), "x_median", "volume")


# -- ingest --------------------------------------------------------------------

_VENDOR = """vendor AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE upper(substr(o_orderpriority, 3, 2)) || 'H' || left(o_orderpriority, 1) END AS contract,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 150 MINUTE END AS wall, o_totalprice AS price FROM orders),
  zoned AS (SELECT *, timezone('UTC', timezone('America/Chicago', wall)) AS utc FROM vendor),
  checked AS (SELECT *, timezone('America/Chicago', timezone('UTC', utc)) <> wall OR timezone('America/Chicago', timezone('UTC', utc + INTERVAL 1 HOUR)) = wall OR timezone('America/Chicago', timezone('UTC', utc - INTERVAL 1 HOUR)) = wall AS odd FROM zoned),
  judged AS (SELECT *, CASE WHEN contract IS NULL THEN 'missing_contract' WHEN k % 61 = 0 THEN 'unparseable_price' WHEN k % 67 = 0 OR k % 71 = 0 THEN 'missing_ohlc' WHEN odd THEN 'ambiguous_or_nonexistent_local_time' WHEN wall IS NULL THEN 'unparseable_timestamp' END AS reason FROM checked)"""


def _normalized(spark, sf_dir) -> normalize.Normalized:
    return normalize.normalize(derived.vendor_rows(spark, sf_dir))


@query(f"WITH {_VENDOR} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return _normalized(spark, sf_dir).rejected.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_VENDOR} SELECT 'orders' AS source_file, k AS row_number, reason FROM judged WHERE reason IS NOT NULL")
def rejected_rows(spark, sf_dir):
    return _normalized(spark, sf_dir).rejected


@query(f"""WITH {_VENDOR}, good AS (SELECT contract, utc AS ts, price, min(k) AS k FROM judged WHERE reason IS NULL GROUP BY 1, 2, 3)
  SELECT contract, ts, CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS trading_date, left(contract, length(contract) - 2) AS root, 'minute' AS frequency, round(price, 4) AS close, CAST(10 AS BIGINT) AS volume FROM good QUALIFY row_number() OVER (PARTITION BY contract, ts ORDER BY k DESC) = 1""", dates=("trading_date",))
def alias_normalise(spark, sf_dir):
    return _normalized(spark, sf_dir).clean.select("contract", naive(), "trading_date", "root", "frequency", F.round("close", 4).alias("close"), "volume")


@query(f"""WITH {_VENDOR}, good AS (SELECT contract, utc AS ts, price, min(k) AS k FROM judged WHERE reason IS NULL GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY contract, ts ORDER BY k DESC) AS n FROM good) SELECT contract, ts, round(price, 4) AS close, 'superseded_in_file' AS reason FROM w WHERE n > 1""")
def superseded_in_file(spark, sf_dir):
    return _normalized(spark, sf_dir).superseded.select("contract", naive(), F.round("close", 4).alias("close"), "reason")


@query("""SELECT name AS contract, coalesce(nullif(regexp_extract(name, '^([A-Za-z0-9]+?)[FGHJKMNQUVXZ]\\d{1,2}$', 1), ''), left(name, 2)) AS root FROM (SELECT DISTINCT substr(p, 3, 3) || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || (o_orderkey % 120) AS name FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders))""")
def root_extract(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.substring("o_orderpriority", 3, 3), F.char(65 + F.col("o_orderkey") % 26), (F.col("o_orderkey") % 120).cast("string"))
    return orders.select(name.alias("contract")).distinct().select("contract", normalize.root_of(F.col("contract")).alias("root"))


@query("""WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-09 22:00:00', TIMESTAMP '2024-03-10 06:00:00', INTERVAL 30 MINUTE)) AS wall UNION ALL SELECT unnest(generate_series(TIMESTAMP '2024-11-02 22:00:00', TIMESTAMP '2024-11-03 06:00:00', INTERVAL 30 MINUTE)))
  SELECT wall, CASE WHEN wall >= TIMESTAMP '2024-03-10 02:00:00' AND wall < TIMESTAMP '2024-03-10 03:00:00' THEN NULL WHEN wall >= TIMESTAMP '2024-11-03 01:00:00' AND wall < TIMESTAMP '2024-11-03 02:00:00' THEN NULL
    WHEN wall >= TIMESTAMP '2024-03-10 03:00:00' AND wall < TIMESTAMP '2024-11-03 01:00:00' THEN wall + INTERVAL 5 HOUR ELSE wall + INTERVAL 6 HOUR END AS ts FROM w""")
def localise_dst(spark, sf_dir):
    def span(lo: str, hi: str) -> DataFrame:
        return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{lo}', timestamp_ntz'{hi}', interval 30 minutes)")).alias("wall"))

    walls = span("2024-03-09 22:00:00", "2024-03-10 06:00:00").unionByName(span("2024-11-02 22:00:00", "2024-11-03 06:00:00"))
    return walls.select("wall", clock.localised(F.col("wall"), "America/Chicago").cast("timestamp_ntz").alias("ts"))


@query("SELECT o_orderkey % 4 AS file, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS row_number FROM orders")
def csv_row_numbers(spark, sf_dir):
    # small blocks, so that files have several at every size; the setting belongs to a session of the query's own
    reading = spark.newSession()
    reading.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    raw = readers.CsvReader().read(reading, f"{derived.vendor_files(spark, sf_dir)}/*/*.csv")
    file = F.regexp_extract(readers.SOURCE_FILE, "/file=([0-9]+)/", 1).cast("bigint").alias("file")
    return raw.select(file, F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col(readers.ROW_NUMBER).alias("row_number"))


@query("SELECT source, row_number() OVER (PARTITION BY source ORDER BY id) AS row_number, id FROM (SELECT 'w' || l_linenumber AS source, l_orderkey AS id FROM lineitem WHERE l_linenumber <= 3)")
def frame_row_numbers(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 3")
    # in the order of their keys, over several tasks
    placed = lines.select(F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias(readers.SOURCE_FILE), F.col("l_orderkey").alias("id")).orderBy("id")
    return readers.from_frame(placed).select(F.col(readers.SOURCE_FILE).alias("source"), F.col(readers.ROW_NUMBER).alias("row_number"), "id")


# -- reports and evidence --------------------------------------------------------


def _occurrences(spark, sf_dir, *codes: str, dirty: bool = True) -> DataFrame:
    bars = (derived.intraday_bars_dirty if dirty else derived.gapped_bars)(spark, sf_dir)
    return occurrences.of_bars(bars, MINUTE, TIGHT, codes=codes)


_ALL = "WITH " + DIRTY + ", " + " , ".join(f"q_{c} AS (SELECT contract, '{c}' AS code FROM dirty WHERE {p})" for c, p in _CHECKS.items()) + ", found AS (" + " UNION ALL ".join(f"SELECT * FROM q_{c}" for c in _CHECKS) + ")"
_RANKS = "CASE code " + " ".join(f"WHEN '{c}' THEN '{v[1]}'" for c, v in CODES.items()) + " END"


@query(f"{_ALL} SELECT contract, code, {_RANKS} AS severity, 'invalid_value' AS category, count(*) AS count FROM found GROUP BY 1, 2")
def quality_summary(spark, sf_dir):
    found = report.findings(_occurrences(spark, sf_dir, *_CHECKS))
    return found.select("contract", "code", "severity", "category", "count")


@query(f"{_ALL} SELECT {_RANKS} AS severity, CAST(count(*) AS BIGINT) AS count, count(DISTINCT (contract, code)) AS issues FROM found GROUP BY 1")
def severity_tally(spark, sf_dir):
    return report.severity_tally(report.findings(_occurrences(spark, sf_dir, *_CHECKS)))


@query(f"WITH {DIRTY} SELECT contract, ts FROM dirty WHERE {_CHECKS['high_lt_low']} ORDER BY contract, ts LIMIT 40 OFFSET 20")
def issue_detail_page(spark, sf_dir):
    _, page = report.issue_details(_occurrences(spark, sf_dir, "high_lt_low"), "high_lt_low", 40, 20)
    return page.select("contract", naive())


@query(f"WITH {DIRTY}, n AS (SELECT contract, ts, row_number() OVER (PARTITION BY contract ORDER BY ts) AS r, count(*) OVER (PARTITION BY contract) AS t FROM dirty WHERE {_CHECKS['open_out_of_range']}) SELECT contract, ts, t AS detail_total, t > 10 AS truncated FROM n WHERE r <= 10")
def issue_detail_samples(spark, sf_dir):
    rows = report.samples(_occurrences(spark, sf_dir, "open_out_of_range"), 10)
    return rows.select("contract", naive(), "detail_total", "truncated")


def _dated(spark, sf_dir, *codes: str) -> DataFrame:
    return evidence.dated(_occurrences(spark, sf_dir, *codes, dirty=False))


_OCC = f"WITH {GAPS}, occ AS (SELECT contract, code, prev_ts + to_seconds(expected_s) AS ts, ts AS resume, gap_minutes FROM classified), placed AS (SELECT *, CAST({CHICAGO.format('ts')} AS DATE) AS day, hour({CHICAGO.format('ts')}) AS hour FROM occ)"
_GAP_CODES = ("intra_session_gap", "extended_gap", "session_break")


@query(f"{_OCC}, h AS (SELECT contract, code, hour, count(*) AS n, sum(count(*)) OVER (PARTITION BY contract, code) AS t, row_number() OVER (PARTITION BY contract, code ORDER BY count(*) DESC, hour) AS r FROM placed GROUP BY 1, 2, 3) SELECT contract, code, CAST(r AS INTEGER) AS rank, CAST(hour AS INTEGER) AS hour, n, CAST(round_even(n / t, 3) AS DOUBLE) AS share FROM h WHERE r <= 3")
def evidence_top_hours(spark, sf_dir):
    return evidence.top_hours(_dated(spark, sf_dir, *_GAP_CODES), ["contract", "code"])


@query(f"{_OCC} SELECT contract, code, left(dayname(day), 3) AS weekday, count(*) AS n FROM placed GROUP BY 1, 2, 3")
def evidence_weekday(spark, sf_dir):
    return evidence.weekday_counts(_dated(spark, sf_dir, *_GAP_CODES), ["contract", "code"])


@query(f"{_OCC}, p AS (SELECT *, CASE WHEN max(day) OVER w - min(day) OVER w <= 182 THEN 'week' WHEN max(day) OVER w - min(day) OVER w <= 1098 THEN 'month' ELSE 'quarter' END AS period FROM placed WINDOW w AS (PARTITION BY contract, code)) SELECT contract, code, period, CAST(CASE period WHEN 'week' THEN date_trunc('week', day) WHEN 'month' THEN date_trunc('month', day) ELSE date_trunc('quarter', day) END AS DATE) AS start, count(*) AS n FROM p GROUP BY 1, 2, 3, 4", dates=("start",))
def evidence_periods(spark, sf_dir):
    return evidence.periods(_dated(spark, sf_dir, *_GAP_CODES), ["contract", "code"])


@query(f"{_OCC}, s AS (SELECT contract, code, list(gap_minutes ORDER BY gap_minutes) AS m FROM occ GROUP BY 1, 2) SELECT contract, code, CAST(round_even(list_aggregate(m, 'median'), 1) AS DOUBLE) AS median_duration_min, CAST(round_even(m[CAST(floor((len(m) - 1) * 0.9 + 0.5) AS BIGINT) + 1], 1) AS DOUBLE) AS p90_duration_min FROM s")
def evidence_durations(spark, sf_dir):
    return evidence.durations(_dated(spark, sf_dir, *_GAP_CODES), ["contract", "code"])


@query(f"{_OCC}, {_SPIKES.split(', w AS', 1)[1].join(['w AS', ''])}, hit AS (SELECT contract, ts FROM w WHERE local_median > 0 AND volume > 3 * local_median) SELECT contract, CAST(round_even(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM occ o WHERE o.contract = hit.contract AND o.resume <= hit.ts AND hit.ts - o.resume <= INTERVAL 5 MINUTE)) / count(*), 3) AS DOUBLE) AS share_after_gap FROM hit GROUP BY 1")
def evidence_after_gap(spark, sf_dir):
    occ = _occurrences(spark, sf_dir, "volume_spike", *_GAP_CODES, dirty=False)
    return evidence.share_after_gap(occ.where("code = 'volume_spike'"), evidence.resumes(occ), ["contract"])


@query(f"{_OCC} SELECT contract, code, count(*) AS occurrences, count(DISTINCT day) AS days_affected FROM placed GROUP BY 1, 2")
def evidence_days_affected(spark, sf_dir):
    return _dated(spark, sf_dir, *_GAP_CODES).groupBy("contract", "code").agg(F.count("*").alias("occurrences"), F.countDistinct("day").alias("days_affected"))


@query(f"""WITH {_OUTLIERS}, {DATED}, hit AS (SELECT contract, 'price_return_outlier' AS code, ts, round(score, 1) AS x FROM scored WHERE score > 3), n AS (SELECT count(*) AS bars, count(DISTINCT trading_date) AS days FROM dated)
  SELECT contract, code, count(*) AS occurrences, CAST(round_even(count(*) * 1000 / (SELECT bars FROM n), 2) AS DOUBLE) AS per_1k_bars, CAST(round_even(count(DISTINCT CAST({CHICAGO.format('ts')} AS DATE)) / (SELECT days FROM n), 3) AS DOUBLE) AS days_affected_share, CAST(max(x) AS DOUBLE) AS max_magnitude, min(ts) AS first_seen FROM hit GROUP BY 1, 2""")
def evidence_pack(spark, sf_dir):
    bars = derived.intraday_bars(spark, sf_dir)
    full = evidence.evidence(occurrences.of_bars(bars, MINUTE, TIGHT, codes=["price_return_outlier"]), bars, MINUTE, TIGHT)
    return full.select("contract", "code", "occurrences", "per_1k_bars", "days_affected_share", "max_magnitude", naive("first_seen"))


# -- all codes at once -----------------------------------------------------------

#: ``derived.audited_bars`` and the occurrences of all codes in them, of the daily bars the missing sessions.
_AUDITED = GAPPED.replace("bars AS", "base AS", 1) + """, hours AS (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 AS h FROM base),
  once AS (SELECT contract, ts, CASE WHEN h % 13 = 0 THEN high + 5 WHEN h % 19 = 0 THEN 0.0 ELSE open END AS open, CASE WHEN h % 11 = 0 THEN low - 1 WHEN h % 23 = 0 THEN CAST('inf' AS DOUBLE) ELSE high END AS high, low,
    CASE WHEN h % 17 = 0 THEN low - 5 ELSE close END AS close, CASE WHEN h % 29 = 0 THEN -volume WHEN h % 31 = 0 THEN NULL ELSE volume END AS volume, h FROM hours),
  bars AS (SELECT contract, ts, open, high, low, close, volume FROM once UNION ALL SELECT contract, ts, open, high, low, close, volume FROM once WHERE h % 37 = 0 UNION ALL SELECT contract, ts, open + 0.5, high, low, close, volume FROM once WHERE h % 41 = 0),
  audit AS (SELECT contract, ts, 'superseded_in_file' AS reason FROM once WHERE h % 43 = 0 UNION ALL SELECT contract, ts, 'superseded_by_run' FROM once WHERE h % 86 = 0)"""
_NONE = "CAST(NULL AS TIMESTAMP) AS end_ts, 1 AS weight, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS minutes, CAST(NULL AS TIMESTAMP) AS lo, CAST(NULL AS TIMESTAMP) AS hi, CAST(NULL AS BIGINT) AS expected_s"
_FOUND = f"""{GAPS.replace(GAPPED, _AUDITED)}, {DATED},
  {_OUTLIERS.replace(INTRADAY + ", ", "")},
  spikes AS (SELECT *, CASE WHEN count(*) OVER f >= 20 THEN quantile_cont(coalesce(volume, 0), 0.5) OVER f END AS local_median FROM bars WINDOW f AS (PARTITION BY contract ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
  copies AS (SELECT contract, ts, open, count(*) AS n FROM bars GROUP BY contract, ts, open, high, low, close, volume HAVING count(*) > 1),
  instants AS (SELECT contract, ts, count(*) AS n, count(DISTINCT (open, high, low, close, volume)) AS variants FROM bars GROUP BY 1, 2 HAVING count(*) > 1),
  found AS (SELECT contract, 'exact_duplicate' AS code, concat(ts, open) AS grp, ts, {_NONE.replace("1 AS weight", "n - 1 AS weight")} FROM copies
    UNION ALL SELECT contract, CASE WHEN variants > 1 THEN 'conflicting_duplicate' ELSE 'repeated_timestamp' END, '', ts, {_NONE} FROM instants
    UNION ALL SELECT contract, 'price_return_outlier', '', ts, {_NONE.replace("CAST(NULL AS DOUBLE) AS x", "round(score, 1) AS x")} FROM scored WHERE score > 3
    UNION ALL SELECT contract, 'volume_spike', '', ts, {_NONE.replace("CAST(NULL AS DOUBLE) AS x", "round(volume / local_median, 1) AS x")} FROM spikes WHERE local_median > 0 AND volume > 3 * local_median AND contract IN (SELECT contract FROM bars GROUP BY 1 HAVING count(*) >= 50)
    UNION ALL SELECT contract, 'resolved_instant_conflict', '', ts, {_NONE} FROM audit
    UNION ALL SELECT contract, code, '', prev_ts + to_seconds(expected_s), ts - to_seconds(expected_s), 1, NULL, gap_minutes, prev_ts, ts, expected_s FROM classified
    {" ".join(f"UNION ALL SELECT contract, '{c}', '', ts, {_NONE} FROM bars WHERE {p}" for c, p in _CHECKS.items())})"""
_HOLED_SPAN = _NONE.replace("CAST(NULL AS TIMESTAMP) AS lo, CAST(NULL AS TIMESTAMP) AS hi", "CAST(lo AS TIMESTAMP) AS lo, CAST(hi AS TIMESTAMP) AS hi")
_EVERY = f"""{_FOUND}, holed AS ({_SESSIONS}), sessions AS (SELECT contract, min(trading_date) AS lo, max(trading_date) AS hi FROM days WHERE trading_date NOT IN (DATE '1996-03-05', DATE '1997-07-09') GROUP BY 1),
  every AS (SELECT 'minute' AS frequency, *, CAST({CHICAGO.format("ts")} AS DATE) AS day, CAST(hour({CHICAGO.format("ts")}) AS INTEGER) AS hour,
      EXISTS (SELECT 1 FROM classified g WHERE g.contract = found.contract AND g.ts <= found.ts AND found.ts - g.ts <= INTERVAL 5 MINUTE) AS near, EXISTS (SELECT 1 FROM classified g WHERE g.contract = found.contract) AS gapped FROM found
    UNION ALL SELECT 'daily', contract, 'missing_sessions', '', CAST(missing_date AS TIMESTAMP), {_HOLED_SPAN}, missing_date, NULL, false, false FROM holed JOIN sessions USING (contract)),
  scope AS (SELECT 'minute' AS frequency, count(*) AS bars, count(DISTINCT trading_date) AS days FROM dated UNION ALL SELECT 'daily', count(*), count(DISTINCT trading_date) FROM days WHERE trading_date NOT IN (DATE '1996-03-05', DATE '1997-07-09'))"""
_KEY = "frequency, contract, code, grp"


@query(f"""WITH {DAYS}, {_EVERY}, total AS (SELECT {_KEY}, CAST(CASE WHEN code = 'resolved_instant_conflict' THEN count(DISTINCT ts) ELSE sum(weight) END AS BIGINT) AS occurrences, count(*) AS analysed,
    CASE WHEN code IN ('intra_session_gap', 'extended_gap', 'missing_sessions') THEN min(lo) ELSE min(ts) END AS first_seen,
    CASE WHEN code IN ('intra_session_gap', 'extended_gap', 'missing_sessions') THEN max(hi) WHEN code = 'session_break' THEN max(ts) ELSE max(coalesce(end_ts, ts)) END AS last_seen, count(DISTINCT day) AS days_affected, CAST(round_even(max(x), 1) AS DOUBLE) AS max_magnitude, max(expected_s) AS expected_interval_s,
    list(minutes ORDER BY minutes) FILTER (WHERE minutes IS NOT NULL) AS m, CASE WHEN bool_or(gapped) AND max(lo) IS NULL THEN CAST(round_even(count(*) FILTER (WHERE near) / count(*), 3) AS DOUBLE) END AS share_after_gap,
    CASE WHEN max(day) - min(day) <= 182 THEN 'week' WHEN max(day) - min(day) <= 1098 THEN 'month' ELSE 'quarter' END AS period FROM every GROUP BY {_KEY}),
  tops AS (SELECT {_KEY}, string_agg(hour || ':' || n || ':' || CAST(round(round_even(n / t, 3) * 1000) AS BIGINT), ',' ORDER BY r) AS top_hours FROM (SELECT {_KEY}, hour, count(*) AS n, sum(count(*)) OVER (PARTITION BY {_KEY}) AS t, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, hour) AS r FROM every WHERE frequency = 'minute' GROUP BY {_KEY}, hour) WHERE r <= 3 GROUP BY {_KEY}),
  week AS (SELECT {_KEY}, string_agg(left(dayname(day), 3) || '=' || n, ',' ORDER BY isodow(day)) AS weekdays FROM (SELECT {_KEY}, min(day) AS day, count(*) AS n FROM every GROUP BY {_KEY}, isodow(day)) GROUP BY {_KEY}),
  trend AS (SELECT {_KEY}, string_agg(start || '=' || n, ',' ORDER BY start) AS period_counts FROM (SELECT {_KEY}, CAST(CASE period WHEN 'week' THEN date_trunc('week', day) WHEN 'month' THEN date_trunc('month', day) ELSE date_trunc('quarter', day) END AS DATE) AS start, count(*) AS n FROM every JOIN total USING ({_KEY}) GROUP BY {_KEY}, start) GROUP BY {_KEY})
  SELECT frequency, contract, code, occurrences, analysed, CAST(round_even(occurrences * 1000 / s.bars, 2) AS DOUBLE) AS per_1k_bars, first_seen, last_seen, expected_interval_s, days_affected,
    CASE WHEN days_affected <= s.days AND code <> 'missing_sessions' THEN CAST(round_even(days_affected / s.days, 3) AS DOUBLE) END AS days_affected_share, max_magnitude,
    CAST(round_even(list_aggregate(m, 'median'), 1) AS DOUBLE) AS median_duration_min, CAST(round_even(m[CAST(floor((len(m) - 1) * 0.9 + 0.5) AS BIGINT) + 1], 1) AS DOUBLE) AS p90_duration_min, share_after_gap, period, top_hours, weekdays, period_counts
  FROM total JOIN scope s USING (frequency) JOIN week USING ({_KEY}) JOIN trend USING ({_KEY}) LEFT JOIN tops USING ({_KEY})""")
def evidence_all_codes(spark, sf_dir):
    bars, superseded = derived.audited_bars(spark, sf_dir)
    days = _holed(spark, sf_dir)
    minutes = evidence.evidence(occurrences.of_bars(bars, MINUTE, TIGHT, superseded), bars, MINUTE, TIGHT)
    daily = evidence.evidence(occurrences.of_bars(days, DAILY, TIGHT, codes=["missing_sessions"]), days, DAILY, TIGHT)
    both = minutes.withColumn("frequency", F.lit(MINUTE)).unionByName(daily.withColumn("frequency", F.lit(DAILY)), allowMissingColumns=True)
    listed = {
        "top_hours": F.concat_ws(",", F.transform("top_hours", lambda h: F.concat_ws(":", h["hour"], h["n"], F.round(h["share"] * 1000).cast("bigint")))),
        "weekdays": F.concat_ws(",", *[F.concat(F.lit(f"{d}="), F.col("weekday_counts")[d]) for d in evidence.WEEKDAYS]),
        "period_counts": F.concat_ws(",", F.transform("period_counts", lambda p: F.concat_ws("=", p["start"], p["n"]))),
    }
    return both.withColumns(listed).select(
        "frequency", "contract", "code", "occurrences", "analysed", "per_1k_bars", naive("first_seen"), naive("last_seen"), "expected_interval_s", "days_affected", "days_affected_share", "max_magnitude",
        "median_duration_min", "p90_duration_min", "share_after_gap", "period", F.when(F.col("frequency") == MINUTE, F.col("top_hours")).alias("top_hours"), "weekdays", "period_counts",
    )


_SAYS = {c: f"n || ' bar(s): {t}'" for c, t in values.TEXT.items()} | {
    "exact_duplicate": "n + 1 || ' byte-identical rows for ' || contract",
    "conflicting_duplicate": "n || ' timestamps with conflicting OHLCV values for ' || contract",
    "repeated_timestamp": "n || ' timestamps repeated with identical values for ' || contract",
    "resolved_instant_conflict": "n || ' timestamps had conflicting OHLCV values for ' || contract || '; the latest row was kept and the rest are in superseded_bars'",
    "intra_session_gap": "n || ' intra-session gaps (~' || missing || ' missing ' || expected_s || 's bars) for ' || contract",
    "extended_gap": "n || ' multi-day gaps for ' || contract || ' (holiday or data outage)'",
    "session_break": "n || ' expected session breaks (overnight/weekend) for ' || contract",
    "missing_sessions": "n || ' business days with no bar for ' || contract || ' between ' || CAST(lo AS DATE) || ' and ' || CAST(hi AS DATE) || ' (some are exchange holidays)'",
    "price_return_outlier": "n || ' bar(s) with an extreme close-to-close return for ' || contract",
    "volume_spike": "n || ' bar(s) with volume >3.0x the local median for ' || contract",
}
_EXAMPLED = ", ".join(f"'{c}'" for c in ("conflicting_duplicate", "resolved_instant_conflict", *_CHECKS))


@query(f"""WITH {DAYS}, {_EVERY}, weekends AS (SELECT contract, count(*) FILTER (WHERE weekend) AS weekend FROM classified WHERE code = 'session_break' GROUP BY 1), moves AS (SELECT contract, max(abs(round(ret, 6))) AS most FROM scored WHERE score > 3 GROUP BY 1),
  whys AS (SELECT contract, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM audit GROUP BY 1),
  g AS (SELECT {_KEY}, CAST(CASE WHEN code = 'resolved_instant_conflict' THEN count(DISTINCT ts) ELSE sum(weight) END AS BIGINT) AS n, count(*) AS detail_total, min(ts) AS first, max(coalesce(end_ts, ts)) AS last, min(lo) AS lo, max(hi) AS hi,
    max(expected_s) AS expected_s, CAST(max(epoch(hi - lo)) AS BIGINT) AS largest, CAST(floor(sum(epoch(hi - lo) / expected_s - 1)) AS BIGINT) AS missing, array_to_string(list_slice(list_sort(list(CAST(day AS VARCHAR))), 1, 5), ',') AS days FROM every GROUP BY {_KEY})
  SELECT frequency, contract, code, CASE code {" ".join(f"WHEN '{c}' THEN '{v[0]}'" for c, v in CODES.items())} END AS category, {_RANKS} AS severity, n AS count, detail_total, CASE code {" ".join(f"WHEN '{c}' THEN {t}" for c, t in _SAYS.items())} END AS message,
    CASE WHEN code IN ('intra_session_gap', 'extended_gap', 'missing_sessions') THEN lo WHEN code <> 'session_break' THEN first END AS start_ts, CASE WHEN code IN ('intra_session_gap', 'extended_gap', 'missing_sessions') THEN hi WHEN code <> 'session_break' THEN last END AS end_ts,
    CASE WHEN code = 'intra_session_gap' THEN expected_s END AS expected_interval_s, CASE WHEN code = 'intra_session_gap' THEN largest END AS largest_gap_s, CASE WHEN code = 'intra_session_gap' THEN missing END AS estimated_missing_bars,
    CASE WHEN code = 'extended_gap' THEN round(largest / 86400, 1) END AS largest_gap_days, CASE WHEN code = 'session_break' THEN weekend END AS weekend, CASE WHEN code = 'session_break' THEN n - weekend END AS overnight,
    CASE WHEN code = 'price_return_outlier' THEN CAST(3 AS DOUBLE) END AS mad_threshold, CASE WHEN code = 'price_return_outlier' THEN round(most, 5) END AS max_abs_return, CASE WHEN code = 'resolved_instant_conflict' THEN detail_total END AS discarded_rows,
    CASE WHEN code IN ({_EXAMPLED}) THEN strftime(first, '%Y-%m-%d %H:%M:%S') || '+00:00' END AS example_ts, CASE WHEN code = 'resolved_instant_conflict' THEN reasons END AS reasons, CASE WHEN code = 'missing_sessions' THEN days END AS examples
  FROM g LEFT JOIN weekends USING (contract) LEFT JOIN moves USING (contract) LEFT JOIN whys USING (contract)""")
def findings_all_codes(spark, sf_dir):
    bars, superseded = derived.audited_bars(spark, sf_dir)
    minutes = report.findings(occurrences.of_bars(bars, MINUTE, TIGHT, superseded), MINUTE, TIGHT).withColumn("frequency", F.lit(MINUTE))
    daily = report.findings(occurrences.of_bars(_holed(spark, sf_dir), DAILY, TIGHT, codes=["missing_sessions"]), DAILY, TIGHT).withColumn("frequency", F.lit(DAILY))
    both = minutes.unionByName(daily)
    listed = [F.array_join(F.col("context")[n], ",").alias(n) for n in ("reasons", "examples")]
    plain = [F.col("context")[f.name].alias(f.name) for f in both.schema["context"].dataType if f.name not in ("reasons", "examples")]
    return both.select("frequency", "contract", "code", "category", "severity", "count", "detail_total", "message", naive("start_ts"), naive("end_ts"), *plain, *listed)


_FIGURES = {
    "exact_duplicate": ["copies", "row_hash"], "conflicting_duplicate": ["rows", "variants"], "repeated_timestamp": ["rows", "variants"], "price_return_outlier": ["log_return", "mad_score"], "volume_spike": ["local_median", "x_median"],
    "resolved_instant_conflict": ["reason"],
} | dict.fromkeys(_GAP_CODES, ["missing_bars", "gap_minutes", "gap_s", "expected_s", "resume_us", "prev_us", "weekend"])


@query(f"WITH {_FOUND} SELECT code, CAST(position AS INTEGER) AS position, name FROM (VALUES {', '.join(repr((c, i, n)) for c, names in _FIGURES.items() for i, n in enumerate(names, 1))}) t(code, position, name) WHERE code IN (SELECT code FROM found)")
def detail_columns(spark, sf_dir):
    bars, superseded = derived.audited_bars(spark, sf_dir)
    return report.detail_columns(occurrences.of_bars(bars, MINUTE, TIGHT, superseded))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
