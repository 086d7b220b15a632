"""Operators that must not gather a contract in one task, against definitions that do."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barquality.functions import clock
from barquality.operators import analytics, gaps, outliers, selection, sequence
from barquality.plans import paging, report
from barquality.sources import readers
from helpers import at, bars, flat

INF = math.inf


@pytest.mark.parametrize("case", ["even", "odd", "ties", "one", "tiny", "signs", "infinite"])
def test_medians_equal_the_definition(spark, case):
    rng = random.Random(case)
    make = {
        "even": lambda: [rng.gauss(0, 1e-3) for _ in range(500)], "odd": lambda: [rng.gauss(5, 1e6) for _ in range(501)], "ties": lambda: rng.choices([0.0, 0.0, -0.0, 1e-9, -1e-9], k=200), "one": lambda: [3.25],
        "tiny": lambda: [rng.choice([5e-324, 1e-310, -5e-324, 1.0, 1.0000000000000002]) for _ in range(300)], "signs": lambda: [-2.0, -1.0, 1.0, 2.0], "infinite": lambda: [rng.choice([INF, -INF, 1.0, 2.0]) for _ in range(101)],
    }[case]
    groups = {k: make() for k in "ab"}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r["median"] for r in selection.medians(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}


def test_the_bucket_never_falls(spark):
    rng = random.Random(3)
    values = sorted({s * math.ldexp(rng.choice([0.5, rng.random(), 1 - 2**-53]), rng.randint(-1073, 1023)) for s in (1, -1) for _ in range(4000)} | {0.0, INF, -INF, 5e-324, -5e-324, 1.7976931348623157e308})
    got = [r["b"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(selection.bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 3000


def test_the_median_of_one_contract_with_millions_of_rows(spark):
    rows = spark.range(3_000_001).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("contract"), ((F.hash("id") % 1_000_003) / 7e6).alias("v"))
    want = {r["contract"]: r["m"] for r in rows.groupBy("contract").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    got = {r["contract"]: r["median"] for r in selection.medians(rows, ["contract"], "v").collect()}
    assert got == want


@pytest.mark.parametrize("block", [5, 7, 50, 4096])
def test_trailing_frames_cross_blocks(spark, block):
    rng = random.Random(block)
    rows = [r for c, n in (("A", 230), ("B", 3), ("C", 64)) for i in range(n) for r in flat(c, [at(i * 97)], volume=rng.randint(0, 9)) * rng.choice([1, 1, 2])]
    df = bars(spark, rows)
    size = 5
    figures = {"n": lambda w: F.count("*").over(w), "s": lambda w: F.sum("volume").over(w)}
    got = sorted((r["contract"], r["ts"], r["n"], r["s"]) for r in sequence.trailing(df, size, figures, "row_hash", block).collect())
    want = []
    for c in "ABC":
        mine = sorted((r[1].replace(tzinfo=None), r[6]) for r in rows if r[0] == c)
        want += [(c, t, min(i + 1, size), sum(v for _, v in mine[max(0, i + 1 - size) : i + 1])) for i, (t, _) in enumerate(mine)]
    assert got == sorted(want)


def test_places_are_numbered_across_days(spark):
    rows = [r for i in range(50) for r in flat("A", [at(i * 700)])] + flat("B", [at(1)])
    got = sorted((r["contract"], r["place"]) for r in sequence.placed(bars(spark, rows), "row_hash").collect())
    assert got == [("A", i) for i in range(50)] + [("B", 0)]


def test_chart_points_drop_the_repeated_hour(spark):
    start = dt.datetime(2024, 11, 3, 4, tzinfo=dt.UTC)  # clocks go back at 07:00
    times = [start + dt.timedelta(minutes=20 * i) for i in range(40)]
    got = [(r["ts"], r["wall_s"]) for r in analytics.chart_points(bars(spark, flat("C", times))).orderBy("ts").collect()]
    kept, most = [], None
    for t in times:
        wall = int(t.timestamp()) - (5 if t < dt.datetime(2024, 11, 3, 7, tzinfo=dt.UTC) else 6) * 3600
        if most is None or wall > most:
            kept.append((t.replace(tzinfo=None), wall))
            most = wall
    assert got == kept and len(kept) == 37


def test_no_window_holds_all_rows_of_a_contract(spark):
    b = bars(spark, flat("C", [at(i) for i in range(80)]))
    for df in (outliers.volume_spikes(b), outliers.price_return_outliers(b), analytics.chart_points(b)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # windows by contract alone run over a row per day or bucket
        for line in (x for x in plan.splitlines() if "windowspecdefinition(contract#" in x):
            assert any(x in line for x in ("_day#", "_block#", "_bucket#", "sum(n#"))
        assert "percentile(log_return" not in plan and "percentile(off" not in plan


def test_rows_of_a_csv_file_are_numbered_over_its_blocks(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 1), ("c", 0), ("d", 800)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{i},{'z' * (i % 40)}\n" for i in range(1, n + 1)))
    reading = spark.newSession()
    reading.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    raw = readers.CsvReader().read(reading, str(tmp_path))
    rows = raw.select(readers.SOURCE_FILE, readers.ROW_NUMBER, "x").collect()
    assert len(rows) == 5801 and all(int(r["x"]) == r[readers.ROW_NUMBER] for r in rows)
    assert {r[readers.SOURCE_FILE].rsplit("/", 1)[1] for r in rows} == {"a.csv", "b.csv", "d.csv"}
    blocks = reading.read.csv(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    assert blocks > 20
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block#" in line for line in plan.splitlines() if "windowspecdefinition(" in line)


def test_rows_of_a_frame_are_numbered_over_its_tasks(spark):
    df = spark.range(10_000).repartitionByRange(7, "id").sortWithinPartitions("id").withColumn("_n", F.lit("kept"))
    rows = readers.from_frame(df).collect()
    assert all(r["id"] + 1 == r[readers.ROW_NUMBER] and r["_n"] == "kept" for r in rows) and len(rows) == 10_000
    own = df.withColumn(readers.ROW_NUMBER, F.lit(5)).withColumn(readers.SOURCE_FILE, F.lit("f"))
    assert readers.from_frame(own) is own and readers.from_frame(df.where("false")).collect() == []


def test_a_page_at_an_offset_of_a_million_rows(spark):
    # one contract without a bar for more than two years, and one with many small gaps
    rows = flat("A", [at(i) for i in range(15)] + [at(1_100_000)]) + flat("B", [at(3 * i) for i in range(3)] + [at(9 + i) for i in range(20)])
    b = bars(spark, rows)
    total, page = report.missing_timestamps(b, limit=700, offset=1_000_000)
    assert total == 1_099_985 + 6
    assert [r["ts"] for r in page.collect()] == [at(15 + 1_000_000 + i).replace(tzinfo=None) for i in range(700)]
    _, last = report.missing_timestamps(b, limit=100, offset=total - 8)
    assert [(r["contract"], r["ts"]) for r in last.collect()] == [("A", at(1_099_998 + i).replace(tzinfo=None)) for i in range(2)] + [("B", at(i).replace(tzinfo=None)) for i in (1, 2, 4, 5, 7, 8)]
    assert report.missing_timestamps(b, limit=5, offset=total)[1].collect() == []


def test_slices_count_what_they_expand_to(spark):
    start = dt.datetime(2024, 11, 1, 3, tzinfo=dt.UTC)  # over the night the clocks go back, and past a month's end
    times = [start + dt.timedelta(minutes=7 * i) for i in range(30)] + [start + dt.timedelta(days=d, minutes=m) for d, m in ((4, 1), (40, 3))]
    b = bars(spark, flat("A", times))
    slices = gaps.missing_slices(b)
    made = gaps.expanded(slices).withColumn("day", clock.local_date(F.col("ts"), "America/Chicago"))
    want = {(r["day"], r["classification"]): r["n"] for r in made.groupBy("day", "classification").agg(F.count("*").alias("n")).collect()}
    got = {}
    for r in slices.collect():
        got[r["day"], r["classification"]] = got.get((r["day"], r["classification"]), 0) + r["n"]
        assert r["n"] <= 206  # a day of 25 hours
    assert got == want and sum(got.values()) == made.select("ts").distinct().count()


def test_ranks_of_cells_and_pages_of_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), at(rng.randint(0, 20_000)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "contract string, ts timestamp, i int")
    key = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    want = [r[2] for r in sorted(rows, key=key)]
    for offset in (0, 17, 450, 880, 900, 5000):
        total, page = paging.page(df, ["i"], 60, offset)
        assert total == 900 and [r["i"] for r in page.collect()] == want[offset : offset + 60]
