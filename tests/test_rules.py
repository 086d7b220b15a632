import datetime as dt
import json
import math
import random
import statistics
import zoneinfo

from barquality import catalog
from barquality.operators import cube, duplicates, evidence, gaps, occurrences, outliers, values
from barquality.operators.normalize import row_hash
from barquality.plans import insights, report
from barquality.schema import DAILY, Settings
from helpers import at, bars, flat
from pyspark.sql import functions as F


def codes(spark, rows, frequency="minute", **options):
    return {r["code"]: r for r in report.findings(occurrences.of_bars(bars(spark, rows, frequency), frequency, **options), frequency).collect()}


def test_a_hole_is_one_intra_session_gap_with_its_missing_minutes(spark):
    rows = flat("C", [at(i) for i in range(180) if not 60 <= i <= 90])
    found = codes(spark, rows)
    assert set(found) == {"intra_session_gap"} and found["intra_session_gap"]["count"] == 1
    assert found["intra_session_gap"]["message"] == "1 intra-session gaps (~31 missing 60s bars) for C"
    missing = sorted(r["ts"] for r in gaps.missing_instants(bars(spark, rows)).collect())
    assert missing == [at(i).replace(tzinfo=None) for i in range(60, 91)]


def test_breaks_and_extended_gaps(spark):
    def session(day):
        return flat("C", [dt.datetime(2024, 1, day, 15, i, tzinfo=dt.UTC) for i in range(12)])

    found = {r["prev_ts"].day: r["code"] for r in gaps.classified(bars(spark, session(2) + session(3) + session(5) + session(8) + session(11))).collect()}
    assert found == {2: "session_break", 3: "extended_gap", 5: "session_break", 8: "extended_gap"}


def test_active_start_and_too_few_spacings(spark):
    quiet = flat("C", [at(-500)], volume=0) + flat("C", [at(i) for i in range(15)])
    assert gaps.classified(bars(spark, quiet)).count() == 0
    assert gaps.classified(bars(spark, flat("C", [at(i * i) for i in range(8)]))).count() == 0


def test_single_row_checks(spark):
    inf, nan = math.inf, math.nan
    rows = [("C", at(i), *r) for i, r in enumerate([(1, 1, 2, 1, 5), (3, 2, 1, 1, 5), (1, 2, 1, 3, 5), (0, 2, 0, 1, 5), (1, inf, 1, 1, 5), (1, nan, 1, 1, 5), (1, 2, 1, 1, -5), (1, 2, 1, 1, None), (1, 2, 1, 1, 5)])]
    got = {}
    for r in values.invalid_values(bars(spark, rows)).collect():
        got.setdefault((r["ts"].minute), set()).add(r["code"])
    assert got[0] >= {"high_lt_low"} and got[1] == {"open_out_of_range"} and got[2] == {"close_out_of_range"} and got[3] == {"non_positive_price"}
    assert "non_finite_price" in got[4] and "non_finite_price" in got[5] and got[6] == {"negative_volume"} and got[7] == {"missing_volume"} and 8 not in got
    assert "missing_volume" not in {r["code"] for r in values.invalid_values(bars(spark, rows), DAILY).collect()}


def test_return_outlier_fires_and_stays_silent_without_spread(spark):
    rng, price, rows = random.Random(1), 100.0, []
    for i in range(60):
        price *= 1 + (rng.random() - 0.5) / 1000 + (0.2 if i == 45 else 0)
        rows += flat("C", [at(i)], price)
    hit = outliers.price_return_outliers(bars(spark, rows)).collect()
    assert [r["ts"].minute for r in hit] == [45] and hit[0]["mad_score"] > 8
    still = flat("C", [at(i) for i in range(59)]) + flat("C", [at(59)], 99.0)
    assert outliers.price_return_outliers(bars(spark, still)).count() == 0


def test_volume_spike(spark):
    rows = flat("C", [at(i) for i in range(60)]) + flat("C", [at(60)], volume=2500)
    hit = outliers.volume_spikes(bars(spark, rows)).collect()
    assert [(r["local_median"], r["x_median"]) for r in hit] == [(100.0, 25.0)]


def test_duplicates_and_conflicts(spark):
    one = ("C", at(0), 1, 2, 1, 1, 5)
    rows = [one, one, one, ("C", at(1), 1, 2, 1, 1, 5), ("C", at(1), 1, 2, 1, 2, 5)]
    found = codes(spark, rows)
    assert found["exact_duplicate"]["count"] == 2 and found["conflicting_duplicate"]["count"] == 1 and found["repeated_timestamp"]["count"] == 1
    b = bars(spark, rows).selectExpr("*", "monotonically_increasing_id() AS row_number").cache()
    winners, losers = duplicates.last_write_wins(b)
    assert winners.count() == 2 and losers.count() == 1


def _arrivals(spark, rows):
    """Bars of (contract, minute, close, row_number); the minute may be absent."""
    b = bars(spark, [(c, at(minute or 0), 1, 2, 1, close, n) for c, minute, close, n in rows])
    b = b.withColumnRenamed("volume", "row_number").withColumn("volume", F.lit(5).cast("bigint"))
    absent = [n for _, minute, _, n in rows if minute is None]
    return b.withColumn("ts", F.when(~F.col("row_number").isin(*absent), F.col("ts")) if absent else F.col("ts")).withColumn("row_hash", row_hash())


def test_losers_carry_the_columns_of_their_winner(spark):
    b = _arrivals(spark, [("C", 0, 1.0, 1), ("C", 0, 1.5, 2), ("C", 0, 1.0, 3), ("C", 0, 1.25, 0), ("C", 1, 2.0, 4), ("D", 0, 1.0, 5), ("D", 0, 1.0, 6)])
    winners, losers = duplicates.last_write_wins(b, winning=("close", "row_number"))
    assert sorted((r["contract"], r["ts"].minute, r["close"], r["row_number"]) for r in winners.collect()) == [("C", 0, 1.5, 2), ("C", 1, 2.0, 4), ("D", 0, 1.0, 5)]
    assert sorted((r["close"], r["row_number"], r["winning_close"], r["winning_row_number"]) for r in losers.collect()) == [(1.0, 1, 1.5, 2), (1.25, 0, 1.5, 2)]
    by_hash = {r["row_hash"]: r["close"] for r in winners.collect()}
    assert {by_hash[r["winning_row_hash"]] for r in duplicates.last_write_wins(b)[1].collect()} == {1.5}


def test_one_row_wins_where_ordinals_are_equal_or_the_instant_is_absent(spark):
    b = _arrivals(spark, [("C", 0, 1.0, 7), ("C", 0, 1.5, 7), ("C", None, 1.0, 1), ("C", None, 1.5, 2), ("C", None, 1.75, 3)])
    winners, losers = duplicates.last_write_wins(b, winning=("close",))
    won, lost = winners.collect(), losers.collect()
    tied = {r["close"] for r in won if r["ts"] is not None}
    assert len(won) == 2 and len(tied) == 1 and [r["close"] for r in won if r["ts"] is None] == [1.75]
    assert sorted((r["close"], r["winning_close"]) for r in lost if r["ts"] is None) == [(1.0, 1.75), (1.5, 1.75)]
    assert [({r["close"]}, {r["winning_close"]}) for r in lost if r["ts"] is not None] == [({1.0, 1.5} - tied, tied)]


def test_the_audit_has_one_join_and_groups_only_the_columns_it_shows(spark):
    plan = catalog.queries()["superseded_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate [") == 3
    assert "high" not in plan.split("min_by(")[1].split(")")[0]


def test_missing_sessions(spark):
    days = [d for i in range(20) if (d := dt.date(2024, 1, 1) + dt.timedelta(days=i)).weekday() < 5 and d != dt.date(2024, 1, 10)]
    rows = flat("C", [dt.datetime.combine(d, dt.time(), dt.UTC) for d in days])
    found = codes(spark, rows, DAILY)
    assert found["missing_sessions"]["count"] == 1
    page = report.missing_timestamps(bars(spark, rows, DAILY), DAILY)
    assert page[0] == 1 and page[1].first()["label"] == "2024-01-10"


def test_halt_week_evidence(spark):
    rows = []
    for day in range(3, 8):
        start = dt.datetime(2024, 6, day, 13, tzinfo=dt.UTC)
        rows += flat("C", [start + dt.timedelta(minutes=i) for i in range(600) if not 480 <= i < 540])
    b = bars(spark, rows)
    occ = occurrences.of_bars(b)
    e = {r["code"]: r for r in evidence.evidence(occ, b).collect()}["intra_session_gap"]
    assert e["occurrences"] == 5 and e["days_affected"] == 5 and e["median_duration_min"] == 61.0 and e["days_affected_share"] == 1.0
    assert [(h["hour"], h["share"]) for h in e["top_hours"]] == [(16, 1.0)] and e["expected_interval_s"] == 60
    assert e["weekday_counts"] == dict.fromkeys(("Mon", "Tue", "Wed", "Thu", "Fri"), 1) and e["period"] == "week"


def _plain_evidence(occ, codes_of_gaps):
    """Figures of each finding from all its occurrences, one by one."""
    rows = [r.asDict() for r in occ.collect()]
    ends = {}
    for r in rows:
        if r["code"] in codes_of_gaps:
            ends.setdefault(r["contract"], []).append(r["metrics"]["resume_us"] / 1e6)
    out = {}
    for r in rows:
        e = out.setdefault((r["contract"], r["code"], r["group"] or ""), {"n": 0, "weight": 0, "hours": {}, "days": set(), "lengths": [], "near": 0})
        t = r["ts"].replace(tzinfo=dt.UTC)
        local = t.astimezone(zoneinfo.ZoneInfo("America/Chicago"))
        e["n"] += 1
        e["weight"] += r["weight"]
        e["hours"][local.hour] = e["hours"].get(local.hour, 0) + 1
        e["days"].add(local.date())
        e["near"] += any(0 <= t.timestamp() - x <= 300 for x in ends.get(r["contract"], []))
        if r["metrics"] and r["metrics"].get("gap_minutes") is not None:
            e["lengths"].append(r["metrics"]["gap_minutes"])
    return out, ends


def test_the_cube_gives_what_all_occurrences_give(spark):
    rng, rows = random.Random(9), []
    for contract in "AB":
        for day in range(3, 8):
            start = dt.datetime(2024, 6, day, 13, tzinfo=dt.UTC)
            for i in range(300):
                if rng.random() < 0.9 and not 100 <= i < 100 + 10 * day:
                    price = 100 + rng.random() + (30 if rng.random() < 0.03 else 0)
                    rows += flat(contract, [start + dt.timedelta(minutes=i)], price, rng.choice([1, 5, 100, 5000, None, -1])) * rng.choice([1, 1, 1, 2])
    rows += flat("C", [at(i) for i in range(60)], volume=None)  # no gap
    b = bars(spark, rows)
    lost = b.where("minute(ts) % 10 = 0").selectExpr("*", "'superseded_by_run' AS reason")
    occ = occurrences.of_bars(b, superseded=lost, settings=Settings(outlier_mad_threshold=3.0, volume_spike_threshold=3.0)).cache()
    want, ends = _plain_evidence(occ, occurrences.GAP_CODES)
    got = {(r["contract"], r["code"], r["group"]): r for r in evidence.evidence(occ, b).collect()}
    assert set(got) == set(want) and len({code for _, code, _ in got}) >= 8
    for key, e in want.items():
        r = got[key]
        assert r["analysed"] == e["n"] and r["days_affected"] == len(e["days"])
        best = sorted(e["hours"].items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(h["hour"], h["n"]) for h in r["top_hours"]] == best
        assert sum(r["weekday_counts"].values()) == sum(p["n"] for p in r["period_counts"]) == e["n"]
        if key[1] in occurrences.GAP_CODES or key[0] not in ends:
            assert r["share_after_gap"] is None
        else:
            assert r["share_after_gap"] == round(e["near"] / e["n"], 3)
        assert r["median_duration_min"] == (round(statistics.median(e["lengths"]), 1) if e["lengths"] else None)
    assert any(r["share_after_gap"] for r in got.values())


def test_a_pack_is_a_page_of_the_findings(spark):
    rows = [("C", at(i), 1, 2, 1, 1, 5) for i in range(7) for _ in range(2)] + [("C", at(9), 1, 1, 2, 1, -1)]
    b = bars(spark, rows)
    whole = insights.evidence_pack(b)
    some = [insights.evidence_pack(b, settings=Settings(pack_limit=4), offset=i) for i in (0, 4, 8)]
    assert whole["scope"]["findings"] == len(whole["evidence"]) == 12  # seven doubled bars, one repetition of instants, and what the last row breaks
    assert [e for s in some for e in s["evidence"]] == whole["evidence"] and all(len(s["evidence"]) == 4 for s in some)


def test_messages_and_contexts(spark):
    rows = [("C", at(0), 1, 1, 2, 1, -1), ("C", at(1, hour=14), 5, 2, 1, 1, None), ("C", at(1, hour=14), 5, 2, 1, 7, None), ("C", at(3), 1, 1, 1, 1, 1), ("C", at(3), 1, 1, 1, 1, 1), ("C", at(3), 1, 1, 1, 1, 1)]
    b = bars(spark, rows)
    lost = b.where("ts = '2024-03-04 15:00:00'").selectExpr("*", "explode(array('b', 'a')) AS reason")
    found = {r["code"]: r for r in report.findings(occurrences.of_bars(b, superseded=lost)).collect()}
    assert found["exact_duplicate"]["message"] == "3 byte-identical rows for C" and found["exact_duplicate"]["count"] == 2
    assert found["high_lt_low"]["message"] == "1 bar(s): high < low" and json.loads(found["high_lt_low"]["context_json"]) == {"example_ts": "2024-03-04 15:00:00+00:00"}
    assert found["conflicting_duplicate"]["context"]["example_ts"] == "2024-03-04 14:01:00+00:00"
    assert json.loads(found["resolved_instant_conflict"]["context_json"]) == {"discarded_rows": 2, "example_ts": "2024-03-04 15:00:00+00:00", "reasons": ["a", "b"]}
    assert found["repeated_timestamp"]["context_json"] == "{}"
    days = [d for i in range(30) if (d := dt.date(2024, 1, 1) + dt.timedelta(days=i)).weekday() < 5 and not 9 <= d.day <= 17]
    daily = report.findings(occurrences.of_bars(bars(spark, [("C", dt.datetime.combine(d, dt.time(), dt.UTC), 1, 2, 1, 9, 1) for d in days], DAILY), DAILY), DAILY).collect()
    found = {r["code"]: r for r in daily}
    assert found["missing_sessions"]["message"] == "7 business days with no bar for C between 2024-01-01 and 2024-01-30 (some are exchange holidays)"
    assert found["missing_sessions"]["context"]["examples"] == ["2024-01-09", "2024-01-10", "2024-01-11", "2024-01-12", "2024-01-15"]
    assert str(found["missing_sessions"]["start_ts"])[:10] == "2024-01-01" and found["close_out_of_range"]["message"].endswith("close outside [low, high] (settlement prints legitimately do this)")


def test_settings_come_from_the_environment():
    got = Settings.from_environment({"BARQUALITY_GAP_MIN_MULTIPLE": "2", "BARQUALITY_DETAIL_CAP": "7", "OTHER": "x"})
    assert got == Settings(gap_min_multiple=2.0, detail_cap=7)


def test_replies_are_checked_against_their_types(spark):
    good = {"pattern_id": "P1", "type": "adjust_threshold", "kind": "validation", "params": {"setting": "gap_min_multiple", "value": 3}, "rationale": "r"}
    bad = [good | {"kind": "cleansing"}, good | {"params": {"setting": "other", "value": 3}}, good | {"params": {"setting": "gap_min_multiple", "value": "3"}}, good | {"type": "none"}, 5]
    kept, refused = insights.verify_suggestions([good, *bad])
    assert kept == [good] and [r.reason.split(":")[0] for r in refused] == ["kind", "setting", "value", "type", "type"]
    schema = insights.suggestions_schema()["properties"]["suggestions"]["items"]["anyOf"]
    assert len(schema) == 6 and schema[1]["properties"]["params"]["properties"]["value"] == {"type": "number"} and schema[5]["properties"]["kind"]["enum"] == ["cleansing", "validation"]


def test_the_cube_runs_each_rule_once(spark):
    b = bars(spark, flat("C", [at(i) for i in range(90) if i % 13]))
    occ = occurrences.of_bars(b)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(cube.cells(occ)) == scans(occ)


def test_deep_pages_do_not_overlap(spark):
    rows = flat("C", [at(i) for i in range(3000) if i % 7])
    occ = occurrences.of_bars(bars(spark, rows)).cache()
    total, first = report.issue_details(occ, "intra_session_gap", 50, 0)
    _, second = report.issue_details(occ, "intra_session_gap", 50, 50)
    a, b = [r["ts"] for r in first.collect()], [r["ts"] for r in second.collect()]
    assert total > 380 and len(a) == len(b) == 50 and max(a) < min(b)
    assert report.issue_details(occ, "no_such_code")[0] == 0
    sample = report.samples(occ.where("code = 'intra_session_gap'"), 20).collect()
    assert len(sample) == 20 and sample[0]["detail_total"] == total and sample[0]["truncated"]


def test_report_order_and_clean_bars(spark):
    assert codes(spark, flat("C", [at(i) for i in range(120)])) == {}
    rows = [("B", at(0), 1, 1, 2, 1, -1), ("A", at(0), 1, 1, 2, 1, None)]
    found = report.ordered(report.findings(occurrences.of_bars(bars(spark, rows), settings=Settings()))).collect()
    ranks = [{"error": 2, "warning": 1, "info": 0}[r["severity"]] for r in found]
    assert ranks == sorted(ranks, reverse=True)
