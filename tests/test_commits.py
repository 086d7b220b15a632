"""The store under several writers, crashes, old runs and many files."""

import threading

import pytest
from pyspark.sql import functions as F

from barquality.plans.store import BarStore
from barquality.sources import readers, synthetic


def shown(store):
    """What a reader sees: bars, displaced rows and runs, without times and ids that differ."""
    bars = sorted((r["frequency"], r["contract"], str(r["ts"]), r["close"]) for r in store.bars().collect())
    lost = sorted((r["reason"], r["contract"], str(r["ts"]), r["close"], r["winning_row_hash"]) for r in store.superseded().collect())
    runs = sorted((r["source"], r["rows_read"], r["rows_new"], r["rows_rejected"], r["rows_deduplicated"], r["rows_superseded"]) for r in store.runs().collect())
    return bars, lost, runs, store.rejected().count()


def daily(spark, n=8, contract="ZC", bump=0):
    rows = [r | {"close": str(float(r["close"]) + bump)} for r in synthetic.daily_rows(days=n)]
    name = next(k for k in rows[0] if "contract" in k or "symbol" in k)
    return synthetic.frame(spark, [r | {name: contract} for r in rows])


def test_a_crash_at_any_step_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = BarStore(spark, str(tmp_path / "s"))
    store.ingest(daily(spark), run_id="one")
    before = shown(store)
    steps = 0
    while True:
        done, calls = False, [0]

        def failing(f, calls=calls, at=steps):
            def run(*a, **k):
                calls[0] += 1
                if calls[0] > at:
                    raise OSError("crash")
                return f(*a, **k)

            return run

        with monkeypatch.context() as broken:
            for name in ("_written", "_kept", "_save"):
                broken.setattr(BarStore, name, failing(getattr(BarStore, name)))
            try:
                store.ingest(daily(spark, bump=1), run_id="two")
                done = True
            except OSError:
                pass
        if done:
            break
        store = BarStore(spark, str(tmp_path / "s"))
        assert shown(store) == before
        steps += 1
    bars, lost, runs, _ = shown(store)
    assert steps >= 6 and len(bars) == len(before[0]) == len(lost) and len(runs) == 2
    assert store.expire(older_than_s=0) > steps / 2 and shown(store) == (bars, lost, runs, 0)


def test_an_old_run_that_comes_again_changes_nothing(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"))
    one = store.ingest(daily(spark), run_id="one")
    store.ingest(daily(spark, bump=1), run_id="two")
    state = shown(store)
    assert store.ingest(daily(spark), run_id="one") == one and BarStore(spark, store.root).ingest(daily(spark), run_id="one") == one
    assert shown(store) == state and store.upsert(store.bars(), "two") == 0
    assert {r["close"] for r in store.bars(version=1).collect()} != {r["close"] for r in store.bars().collect()}


@pytest.mark.parametrize("same", [True, False])
def test_of_two_writers_the_second_goes_on_or_merges_again(spark, tmp_path, monkeypatch, same):
    first, second = BarStore(spark, str(tmp_path / "s")), BarStore(spark, str(tmp_path / "s"))
    real, merges = BarStore._save, []
    merged = BarStore._merged
    monkeypatch.setattr(BarStore, "_merged", lambda self, *a: (merges.append(self is second), merged(self, *a))[1])

    def save(self, manifest):
        if self is second and not first.runs().count():
            first.ingest(daily(spark, contract="ZC" if same else "ZW"), "first")
        return real(self, manifest)

    monkeypatch.setattr(BarStore, "_save", save)
    run = second.ingest(daily(spark, n=10, bump=1), "second")
    bars, lost, runs, _ = shown(first)
    ten, eight = len(synthetic.daily_rows(days=10)), len(synthetic.daily_rows(days=8))
    assert len(runs) == 2 and merges.count(True) == (2 if same else 1)
    assert (len(bars), len(lost), run.rows_new) == ((ten, eight, ten - eight) if same else (ten + eight, 0, ten))


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    BarStore(spark, root)
    failed = []

    def write(i):
        try:
            BarStore(spark, root).ingest(daily(spark, n=5, contract=f"Z{i % 2}", bump=i), str(i), run_id=f"run{i}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    bars, lost, runs, _ = shown(BarStore(spark, root))
    n = len(synthetic.daily_rows(days=5))
    assert not failed and len(runs) == 4 and len(bars) == 2 * n and len(lost) == 2 * n and sum(r[2] for r in runs) == 2 * n


def test_the_list_of_folders_is_written_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("barquality.plans.store.CHECKPOINT", 2)
    store = BarStore(spark, str(tmp_path / "s"))
    for i in range(5):
        store.upsert(store._rows([]) if i == 3 else BarStore.bars(store).unionByName(_canonical(spark, i)), f"r{i}")
    fresh = BarStore(spark, store.root)
    assert len(list((tmp_path / "s" / "checkpoints").glob("0*.json"))) == 2
    assert shown(fresh)[0] == shown(store)[0] and len(shown(fresh)[0]) == 4
    assert [fresh.bars(version=v).count() for v in range(6)] == [0, 1, 2, 3, 3, 4]


def _canonical(spark, i):
    from helpers import at, bars, flat

    return bars(spark, flat("A", [at(i * 50_000)]))


def test_only_folders_of_the_asked_periods_are_read(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"))
    for i in range(4):
        store.upsert(_canonical(spark, i), f"r{i}")
    store.ingest(daily(spark))
    day = store.bars("minute").agg(F.max("trading_date")).first()[0]
    some = store.bars("minute", "A", start=day, end=day)
    assert some.count() == 1 and len(some.inputFiles()) == 1 and len(store.bars("minute").inputFiles()) == 4
    store.register("t_")
    assert spark.sql("SELECT count(*) FROM t_bars").first()[0] == store.bars().count()
    asked = spark.sql("SELECT close FROM t_bars WHERE frequency = 'minute' AND contract = 'A' AND period < '2024-05'")
    scan = next(x for x in asked._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "_c#" in scan.split("PartitionFilters: [")[1].split("]")[0] and asked.count() == 2
    assert spark.sql("SELECT count(*) FROM t_ingestion_runs JOIN t_rejected_rows USING (run_id)").first()[0] == 0 and spark.sql("FROM t_superseded_bars").count() == 0


def test_many_files_in_one_commit_give_the_runs_of_one_by_one(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = synthetic.dirty_minute_rows()
    names = list(rows[0])
    for i in range(6):
        # files overlap, some have another order of columns, one has only its header
        mine = [] if i == 4 else [r | {"volume": 1000 + i} for r in rows[i * 9 : i * 9 + 25]]
        order = names if i % 3 else names[::-1]
        (folder / f"f{i:02d}.csv").write_text("\n".join([",".join(order)] + [",".join("" if r.get(n) is None else str(r[n]) for n in order) for r in mine]) + "\n")
    many, single = BarStore(spark, str(tmp_path / "many")), BarStore(spark, str(tmp_path / "single"))
    got = many.ingest_paths([str(folder)], "minute")
    want = [single.ingest(readers.read_file(spark, f), f, "minute") for f in readers.expand(spark, [folder])]
    plain = lambda r: (r.source, r.rows_read, r.rows_new, r.rows_rejected, r.rows_deduplicated, r.rows_superseded, r.contracts, r.rejections_by_reason)
    assert list(map(plain, got)) == list(map(plain, want)) and len(got) == 6
    assert shown(many) == shown(single) and many._state().version == 1 and single._state().version == 6
    assert len({r.run_id for r in got}) == 6 and many.superseded().count() > 5
    by = {r["run_id"]: r["n"] for r in many.superseded().groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == many.superseded().count() and set(by) <= {r.run_id for r in got}
