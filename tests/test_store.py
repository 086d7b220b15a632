
import pytest

from barquality.__main__ import main
from barquality.plans import insights as ins
from barquality.plans.engine import Engine
from barquality.plans.store import BarStore, SchemaMismatchError
from barquality.sources import readers, synthetic
from barquality.streaming.ingest import ingest_stream, tick_bars


def write_csv(path, rows):
    names = list(rows[0])
    path.write_text("\n".join([",".join(names)] + [",".join("" if r.get(n) is None else str(r[n]) for n in names) for r in rows]) + "\n")
    return path


def test_readers_keep_provenance(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x,y,z\n1,NA,3\n4,5\n6,7,8,9\n")
    rows = readers.read_file(spark, f).orderBy(readers.ROW_NUMBER).collect()
    assert [tuple(r) for r in rows] == [("1", None, "3", str(f), 1), ("4", "5", None, str(f), 2), ("6", "7", "8", str(f), 3)]
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    assert readers.read_file(spark, part).first()[readers.ROW_NUMBER] == 1
    with pytest.raises(readers.UnsupportedFileError):
        readers.read_file(spark, "x.xlsx")
    assert readers.expand(spark, [tmp_path, f, tmp_path / "*.csv", tmp_path / "none", tmp_path / "none*"]).count(str(f)) == 1


def test_ingest_again_changes_nothing_and_keeps_five_conflicts(spark, tmp_path):
    f = write_csv(tmp_path / "dirty_minute.csv", synthetic.dirty_minute_rows())
    engine = Engine(spark, str(tmp_path / "store"))
    one = engine.store.ingest_paths([str(f)])[0]
    two = engine.store.ingest_paths([str(f)])[0]
    assert (one.rows_new, one.rows_deduplicated, one.rows_superseded, one.rows_rejected) == (137, 3, 5, 4) and two.rows_new == 0
    assert engine.store.bars("minute").count() == 137 and engine.store.superseded().count() == 10 and engine.store.runs().count() == 2 and engine.store.rejected().count() == 8
    issues = {r["code"]: r for r in engine.quality_report("CL_TEST")["issues"].collect()}
    assert issues["resolved_instant_conflict"]["count"] == 5 and issues["resolved_instant_conflict"]["context"]["discarded_rows"] == 10
    assert issues["intra_session_gap"]["count"] == 1 and issues["high_lt_low"]["count"] == 1 and issues["negative_volume"]["count"] == 1 and issues["non_positive_price"]["count"] == 1
    assert engine.missing_timestamps("CL_TEST")["total"] == 13
    day = engine.daily_ohlcv("CL_TEST").first()
    assert day["bar_count"] == 137
    assert engine.vwap("CL_TEST", limit=10).count() == 10
    assert engine.contracts().first()["bar_count"] == 137
    pack = ins.evidence_pack(engine.store.bars("minute"), engine.store.superseded())
    assert [e["id"] for e in pack["evidence"]] == [f"E{i + 1}" for i in range(len(pack["evidence"]))]

    class Scripted:
        model = "scripted"

        def complete_json(self, system, user, schema):
            if "patterns" in schema["properties"]:
                good = {"id": "P1", "title": "t", "classification": "unknown", "contracts": ["CL_TEST"], "evidence_refs": ["E1"], "explanation": "x", "confidence": "low"}
                return {"patterns": [good, good | {"confidence": "sure"}, 3]}
            return {"suggestions": [{"pattern_id": "P1", "type": "custom", "kind": "validation", "params": {"description": "d"}, "rationale": "r"}, {"type": "custom"}]}

    result = engine.insights(Scripted(), "CL_TEST")
    assert len(result.patterns) == 1 and len(result.suggestions) == 1 and [r.stage for r in result.rejected] == ["pattern", "pattern", "suggestion"]
    assert ins.joined(result)[0]["evidence"][0]["id"] == "E1" and ins.fact_lines(result.evidence[0])
    Scripted.complete_json = lambda *_: {"other": []}
    with pytest.raises(ins.ProviderError):
        engine.insights(Scripted(), "CL_TEST")


def test_a_correction_displaces_by_run(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"))
    rows = synthetic.daily_rows(days=10)
    store.ingest(synthetic.frame(spark, rows))
    fixed = [rows[0] | {"close": "1"}, *rows[1:3]]
    run = store.ingest(synthetic.frame(spark, fixed))
    assert run.rows_new == 0
    lost = store.superseded().collect()
    assert [r["reason"] for r in lost] == ["superseded_by_run"] and store.bars("daily").count() == len(rows)
    assert store.bars("daily", start="2024-01-01", end="2024-01-01").first()["close"] == 1.0
    assert store.bars("minute").count() == 0 and store.bars("daily", "none").count() == 0


def test_other_schema_versions_are_refused(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"))
    store._save({"schema_version": 0, "version": 1, "partitions": {}})
    with pytest.raises(SchemaMismatchError):
        BarStore(spark, str(tmp_path / "s"))


def test_a_crash_before_the_manifest_leaves_the_old_state_and_a_retried_run_adds_nothing(spark, tmp_path, monkeypatch):
    store = BarStore(spark, str(tmp_path / "s"))
    rows = synthetic.daily_rows(days=10)
    store.ingest(synthetic.frame(spark, rows), run_id="one")
    fixed = synthetic.frame(spark, [rows[0] | {"close": "1"}, *rows[1:3]])
    with monkeypatch.context() as broken:
        broken.setattr(BarStore, "_save", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.ingest(fixed, run_id="two")
    store = BarStore(spark, str(tmp_path / "s"))
    assert store.bars("daily").count() == len(rows) and store.bars("daily").where("close = 1").count() == 0
    for _ in range(2):
        run = store.ingest(fixed, run_id="two")
        assert run.rows_new == 0 and store.superseded().count() == 1 and store.runs().count() == 2
    assert store.bars("daily").where("close = 1").count() == 1
    for f in (tmp_path / "s" / "manifests").iterdir():
        f.unlink()
    with pytest.raises(SchemaMismatchError):
        BarStore(spark, str(tmp_path / "s"))


def test_command_line(spark, tmp_path, capsys):
    f = write_csv(tmp_path / "clean.csv", synthetic.minute_rows(n=30))
    assert main(["ingest", str(f), "--store", str(tmp_path / "s"), "--frequency", "minute"]) == 0
    assert "30 read, 30 new, 0 rejected" in capsys.readouterr().out
    assert main(["ingest", str(tmp_path / "nothing*"), "--store", str(tmp_path / "s")]) == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = synthetic.minute_rows(n=20)
    write_csv(tmp_path / "in" / "a.csv", rows)
    store = BarStore(spark, str(tmp_path / "s"))
    schema = ", ".join(f"{n} string" for n in rows[0])
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "c")).awaitTermination(120)
    assert store.bars("minute").count() == 20
    ticks = spark.createDataFrame([("A", "2024-01-01 00:00:10", 1.0, 5), ("A", "2024-01-01 00:00:50", 3.0, 5), ("A", "2024-01-01 00:01:10", 2.0, 1)], "c string, t string, p double, s long")
    out = tick_bars(ticks.selectExpr("c", "cast(t as timestamp) t", "p", "s"), "c", "t", "p", "s").orderBy("ts").collect()
    assert [tuple(r)[2:] for r in out] == [(1.0, 3.0, 1.0, 3.0, 10), (2.0, 2.0, 2.0, 2.0, 1)]
