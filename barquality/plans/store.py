"""A store of bars as Parquet with optimistic commits, an audit trail and a ledger of runs.

Bars lie in one folder per frequency, contract and period (a month of minutes, a
year of days).  A run writes the periods it touches into folders of its own and
then adds the next numbered manifest, which says what the run changed; adding a
file that is there already fails, so of two writers one is first.  The other
sees which periods that one changed and goes on if they are not its own, or else
merges again.  Audit rows and the run itself become visible with the same
manifest, so a crash at any point leaves the old state, and a run that comes
again under its id, however old, changes nothing.

Manifests are the ledger and are kept; every ``CHECKPOINT`` of them the folders
in use are listed in one file, so that a reader starts from there.  ``expire``
removes folders that no kept version uses.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import Normalized, detect_frequency, normalize
from ..schema import BAR_COLUMNS, BARS, KEY, MINUTE, REJECTED, RUNS, SUPERSEDED, Settings
from ..sources.readers import by_header, expand, read_files
from .files import Files

SCHEMA_VERSION = 2
SUPERSEDED_BY_RUN = "superseded_by_run"
#: Manifests from one list of all folders to the next; attempts to commit before a writer gives up.
CHECKPOINT, ATTEMPTS = 20, 50
_MANIFEST = "version long, audit string, runs array<struct<run_id string, source string, frequency string, rows_read long, rows_new long, rows_rejected long, rows_deduplicated long, rows_superseded long, contracts array<string>, rejections_by_reason map<string,long>>>, at string"


class SchemaMismatchError(RuntimeError):
    """The store was written by another version of the schema."""


class CommitConflict(RuntimeError):
    """Another writer changed the same periods first."""


@dataclass(frozen=True)
class RunResult:
    run_id: str
    source: str
    frequency: str
    rows_read: int
    rows_new: int
    rows_rejected: int
    rows_deduplicated: int
    rows_superseded: int
    contracts: tuple[str, ...]
    rejections_by_reason: dict[str, int]


@dataclass
class State:
    """The folder of each frequency, contract and period at a version."""

    version: int = -1
    schema_version: int = SCHEMA_VERSION
    folders: dict[str, str] = field(default_factory=dict)

    def applied(self, manifest: dict) -> State:
        return State(manifest["version"], manifest["schema_version"], self.folders | manifest.get("adds", {}))


class BarStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._known = State()
        if not self._versions():
            if self.files.children("bars"):
                raise SchemaMismatchError(f"{root}: there are bars without a manifest")
            try:
                self._save({"schema_version": SCHEMA_VERSION, "version": 0})
            except FileExistsError:
                pass  # another writer was first
        if (found := self._state().schema_version) != SCHEMA_VERSION:
            raise SchemaMismatchError(f"{root}: schema version {found}, expected {SCHEMA_VERSION}")

    # -- manifests

    def _versions(self) -> list[int]:
        return sorted(int(n[:12]) for n in self.files.children("manifests") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"manifests/{version:012d}.json"))

    def _save(self, manifest: dict) -> None:
        self.files.add(f"manifests/{manifest['version']:012d}.json", json.dumps(manifest))

    def _state(self, upto: int | None = None) -> State:
        """The latest state, or that of a version; what was read before is not read again."""
        state = self._known if upto is None or self._known.version <= upto else State()
        there = [v for v in self._versions() if upto is None or v <= upto]
        starts = [v for n in self.files.children("checkpoints") if n.endswith(".json") and state.version < (v := int(n[:12])) <= (there[-1] if there else -1)]
        if starts:
            state = State(**json.loads(self.files.read(f"checkpoints/{max(starts):012d}.json")))
        for v in there:
            if v > state.version:
                state = state.applied(self._manifest(v))
        if upto is None:
            self._known = state
        return state

    def _ledger(self) -> DataFrame:
        """version, audit, runs, at of every commit, read from the manifests."""
        return self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifests/*.json")

    def _recorded(self, run_id: str) -> RunResult | None:
        found = self._ledger().select(F.explode("runs").alias("run")).where(F.col("run.run_id") == run_id).select("run.*").limit(1).collect()
        return RunResult(**(r := found[0].asDict()) | {"contracts": tuple(r["contracts"] or ()), "rejections_by_reason": r["rejections_by_reason"] or {}}) if found else None

    def _commit(self, base: State, manifest: dict) -> None:
        """Add the manifest as the next version; CommitConflict if one since ``base`` touches the same periods or is the same run."""
        for _ in range(ATTEMPTS):
            now = self._state()
            for v in range(base.version + 1, now.version + 1):
                other = self._manifest(v)
                same = {r["run_id"] for r in other.get("runs", ())} & {r["run_id"] for r in manifest["runs"]}
                if same or other.get("adds", {}).keys() & manifest["adds"].keys():
                    raise CommitConflict(f"version {v}")
            try:
                self._save(manifest | {"schema_version": SCHEMA_VERSION, "version": now.version + 1, "at": datetime.now(UTC).isoformat()})
            except FileExistsError:
                continue
            if (now.version + 1) % CHECKPOINT == 0:
                try:
                    self.files.add(f"checkpoints/{now.version + 1:012d}.json", json.dumps(asdict(self._state(now.version + 1))))
                except FileExistsError:
                    pass
            return
        raise CommitConflict(f"{ATTEMPTS} attempts")

    # -- reading

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], BARS)
        return self.spark.read.schema(BARS).parquet(*[f"{self.root}/{f}" for f in sorted(folders)])

    def bars(self, frequency: str | None = None, contract: str | None = None, start=None, end=None, version: int | None = None) -> DataFrame:
        """Stored bars, now or at a version; only the folders of the asked frequency, contract and periods are listed and read."""
        wanted = []
        # a trading date may differ by a day from the date of the instant
        first = str(start)[:10] if start is not None else None
        last = str(end)[:10] if end is not None else None
        for key, folder in self._state(version).folders.items():
            f, c, period = key.split("\t")
            inside = (first is None or period >= _shifted(first, -1)[: len(period)]) and (last is None or period <= _shifted(last, 1)[: len(period)])
            if inside and (not frequency or f == frequency) and (not contract or unquote(c) == contract):
                wanted.append(folder)
        return _between(self._rows(wanted), start, end)

    def _audit(self, name: str, schema) -> DataFrame:
        """The rows of an audit table that a commit has made visible."""
        if not self.files.children(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")
        at = F.regexp_extract(F.col("_metadata.file_path"), f"/{name}/([0-9a-f]+)/", 1)
        names = schema.fieldNames()
        return rows.select(*names, at.alias("_audit")).join(self._ledger().select(F.col("audit").alias("_audit")), "_audit", "left_semi").select(*names)

    def superseded(self, frequency: str | None = None, contract: str | None = None, start=None, end=None) -> DataFrame:
        out = self._audit("superseded_bars", SUPERSEDED)
        for column, value in (("frequency", frequency), ("contract", contract)):
            if value:
                out = out.where(F.col(column) == value)
        return _between(out, start, end)

    def rejected(self) -> DataFrame:
        return self._audit("rejected_rows", REJECTED)

    def runs(self) -> DataFrame:
        rows = self._ledger().select(F.explode("runs").alias("run"), F.to_timestamp("at").alias("ingested_at")).select("run.*", "ingested_at")
        return rows.select(*RUNS.fieldNames())

    def register(self, prefix: str = "") -> None:
        """The store as SQL views: bars, superseded_bars, rejected_rows, ingestion_runs.

        In ``bars`` frequency, contract and period are names of folders, so
        conditions on them choose the folders that are read.
        """
        folders = list(self._state().folders.values())
        if folders:
            kept = [c for c in BAR_COLUMNS if c not in ("frequency", "contract")]
            places = T.StructType([*BARS.fields, *[T.StructField(n, T.StringType()) for n in ("_v", "_f", "_c", "_p")]])
            whole = self.spark.read.schema(places).option("basePath", f"{self.root}/bars").parquet(*[f"{self.root}/{f}" for f in folders])
            bars = whole.select(F.col("_f").alias("frequency"), F.col("_c").alias("contract"), F.col("_p").alias("period"), *kept)
        else:
            bars = self._rows([]).withColumn("period", F.lit(None).cast("string"))
        for name, df in (("bars", bars), ("superseded_bars", self.superseded()), ("rejected_rows", self.rejected()), ("ingestion_runs", self.runs())):
            df.createOrReplaceTempView(f"{prefix}{name}")

    # -- writing

    def _written(self, df: DataFrame, name: str, attempt: str, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{attempt}/{part}")

    def _kept(self, df: DataFrame, attempt: str, name: str) -> DataFrame:
        """A frame of a run written once, so that what it comes from is read and parsed once."""
        path = f"{self.root}/staging/{attempt}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _merged(self, base: State, incoming: DataFrame, attempt: str) -> tuple[dict[str, str], dict[str, int]]:
        """Write the touched periods anew, and what they displace to the audit folder; their folders, and how many instants are new by run."""
        touched = [f"{r[0]}\t{quote(r[1], safe='')}\t{r[2]}" for r in incoming.select(*[c.alias(n) for n, c in _places().items()]).distinct().collect()]
        stored = self._rows([base.folders[k] for k in touched if k in base.folders])
        chain = self._kept(succession(stored, incoming), attempt, "chain")
        lost = chain.where("winning_row_hash != row_hash").withColumns({"reason": F.lit(SUPERSEDED_BY_RUN), "run_id": F.col("_next_run"), "superseded_at": F.current_timestamp()})
        self._written(lost.select(*SUPERSEDED.fieldNames()), "superseded_bars", attempt, "by-run")
        fresh = {r["run_id"]: r["n"] for r in chain.where("_new").groupBy("run_id").agg(F.count("*").alias("n")).collect()}
        last = chain.where("winning_row_hash is null").select(*BAR_COLUMNS).withColumns(_places())
        last.repartition("_f", "_c", "_p").write.partitionBy("_f", "_c", "_p").parquet(f"{self.root}/bars/_v={attempt}")
        adds = {}
        for name, _ in self.files.matching(f"bars/_v={attempt}/_f=*/_c=*/_p=*"):
            f, c, p = (unquote(x.split("=", 1)[1]) for x in name.split("/")[-3:])
            adds[f"{f}\t{quote(c, safe='')}\t{p}"] = name
        return adds, fresh

    def _applied(self, incoming: DataFrame, attempt: str, results: list[dict]) -> list[RunResult]:
        """Merge and commit, again while other writers are first with the same periods.

        ``incoming`` has the ``run_id`` and ``place`` of each row; one row per run and key.
        """
        for i in range(ATTEMPTS):
            base, name = self._state(), f"{attempt}{i:02x}"
            adds, new = self._merged(base, incoming, name)
            runs = [r | {"rows_new": new.get(r["run_id"], 0)} for r in results]
            try:
                self._commit(base, {"adds": adds, "audit": name, "runs": runs})
            except CommitConflict:
                if done := self._recorded(results[0]["run_id"]):
                    return [done]
                self._carried(name, f"{attempt}{i + 1:02x}")
                continue
            finally:
                self.files.delete(f"staging/{name}")
            return [RunResult(**r | {"contracts": tuple(r["contracts"])}) for r in runs]
        raise CommitConflict(f"{ATTEMPTS} attempts")

    def _carried(self, old: str, new: str) -> None:
        """The audit rows that a run found in its files, under the name of its next attempt."""
        for name in ("rejected_rows", "superseded_bars"):
            self.files.move(f"{name}/{old}/in-file", f"{name}/{new}/in-file")

    def upsert(self, incoming: DataFrame, run_id: str) -> int:
        """Write bars over stored ones of the same key; returns how many instants are new.

        What is displaced with other values goes to the audit trail.
        """
        if done := self._recorded(run_id):
            return done.rows_new
        names = sorted(r[0] for r in incoming.select("contract").distinct().collect())
        result = {"run_id": run_id, "source": "<upsert>", "frequency": None, "rows_read": incoming.count(), "rows_rejected": 0, "rows_deduplicated": 0, "rows_superseded": 0, "contracts": names, "rejections_by_reason": {}}
        return self._applied(incoming.withColumns({"run_id": F.lit(run_id), "place": F.lit(0)}), uuid.uuid4().hex, [result])[0].rows_new

    def ingest(self, raw: DataFrame, source: str = "<memory>", frequency: str | None = None, settings: Settings = Settings(), run_id: str | None = None) -> RunResult:
        """Normalise a raw frame and store it: bars, rejections, displaced rows and the run, in one commit.

        A run that was recorded under its ``run_id`` at any time is not applied again.
        """
        run_id = run_id or uuid.uuid4().hex
        if done := self._recorded(run_id):
            return done
        done = normalize(raw, frequency, source, settings)
        return self._stored(done, lambda df: df.withColumns({"run_id": F.lit(run_id), "place": F.lit(0)}), [(run_id, source, done.frequency)])[0]

    def _stored(self, done: Normalized, by_run, runs: list[tuple[str, str, str]]) -> list[RunResult]:
        """Store normalised rows; ``by_run`` adds ``run_id`` and ``place`` to a frame with ``source_file``."""
        attempt = uuid.uuid4().hex
        accepted = by_run(done.accepted.select("source_file")).groupBy("run_id").agg(F.count("*").alias("n"))
        clean, rejected, lost = (self._kept(by_run(getattr(done, n)), attempt, n) for n in ("clean", "rejected", "superseded"))
        self._written(rejected.select(*REJECTED.fieldNames()), "rejected_rows", f"{attempt}00", "in-file")
        self._written(lost.withColumn("superseded_at", F.current_timestamp()).select(*SUPERSEDED.fieldNames()), "superseded_bars", f"{attempt}00", "in-file")
        # a row per run, and per run and reason
        read = {r["run_id"]: r["n"] for r in accepted.collect()}
        kept = {r["run_id"]: r for r in clean.groupBy("run_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("contract")).alias("names")).collect()}
        beaten = {r["run_id"]: r["n"] for r in lost.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
        reasons: dict[str, dict[str, int]] = {}
        for r in rejected.groupBy("run_id", "reason").agg(F.count("*").alias("n")).collect():
            reasons.setdefault(r["run_id"], {})[r["reason"]] = r["n"]
        results = []
        for run_id, source, frequency in runs:
            ok, won, less, bad = read.get(run_id, 0), kept.get(run_id), beaten.get(run_id, 0), reasons.get(run_id, {})
            counts = {"rows_read": ok + sum(bad.values()), "rows_rejected": sum(bad.values()), "rows_deduplicated": ok - (won["n"] if won else 0) - less, "rows_superseded": less}
            results.append({"run_id": run_id, "source": source, "frequency": frequency} | counts | {"contracts": won["names"] if won else [], "rejections_by_reason": bad})
        out = self._applied(clean, attempt, results)
        self.files.delete(f"staging/{attempt}")
        return out

    def ingest_paths(self, paths: list[str], frequency: str | None = None, settings: Settings = Settings()) -> list[RunResult]:
        """Store files, folders and patterns: one plan per kind of header, one commit for all, and a run per file.

        Files count in the order of their names: what a later one says of an
        instant displaces what an earlier one said, as if they had come one by one.
        """
        files = expand(self.spark, paths)
        if not files:
            raise FileNotFoundError(f"no files match {', '.join(map(str, paths))}")
        parts, runs = [], {}
        for group in by_header(self.spark, files, lambda columns, path: detect_frequency(columns, path, frequency)):
            parts.append(normalize(read_files(self.spark, group.files), group.kind, "", settings, per_file=True))
            runs |= {f: (uuid.uuid4().hex, f, group.kind) for f in group.files}
        done = Normalized(*(reduce(DataFrame.unionByName, [getattr(p, n) for p in parts]) for n in ("clean", "rejected", "superseded", "accepted")), "")
        known = self.spark.createDataFrame([(f, runs[f][0], i) for i, f in enumerate(files)], "source_file string, run_id string, place int")
        # as many rows as files, whose names the driver holds anyway
        return self._stored(done, lambda df: df.join(F.broadcast(known), "source_file"), [runs[f] for f in files])

    def expire(self, keep: int = 1, older_than_s: float = 86_400) -> int:
        """Remove bar folders that none of the last ``keep`` versions uses, and leftovers of runs that never committed; how many.

        Only what was last changed before ``older_than_s`` seconds goes, so
        that writers and readers at work keep their folders.
        """
        latest = self._state().version
        used = {f for v in range(max(latest - keep + 1, 0), latest + 1) for f in self._state(v).folders.values()}
        before = time.time() - older_than_s
        audits = {r[0] for r in self._ledger().where("audit is not null").select("audit").collect()}
        old = [n for n, at in self.files.matching("bars/*/_f=*/_c=*/_p=*") if n not in used and at <= before]
        old += [n for n, at in self.files.matching("staging/*") if at <= before]
        old += [n for t in ("superseded_bars", "rejected_rows") for n, at in self.files.matching(f"{t}/*") if n.split("/")[1] not in audits and at <= before]
        for name in old:
            self.files.delete(name)
        return len(old)


def _places() -> dict:
    """The folder names of a bar; a key has one place for good."""
    period = F.when(F.col("frequency") == MINUTE, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy"))
    return {"_f": F.col("frequency"), "_c": F.col("contract"), "_p": period}


def _shifted(day: str, by: int) -> str:
    return datetime.fromordinal(datetime.fromisoformat(day).toordinal() + by).date().isoformat()


def _between(rows: DataFrame, start, end) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("trading_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("trading_date") <= F.lit(end).cast("date"))
    return rows


def succession(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of each key in the order in which they took effect: what follows a row, and whether its key is new.

    The last row of a key has no ``winning_row_hash``.
    """
    first = stored.select(*BAR_COLUMNS, F.lit(None).cast("string").alias("run_id"), F.lit(-1).alias("place"))
    every = first.unionByName(incoming.select(*BAR_COLUMNS, "run_id", "place"))
    order = Window.partitionBy(*KEY).orderBy("place")
    return every.select("*", F.lead("row_hash").over(order).alias("winning_row_hash"), F.lead("run_id").over(order).alias("_next_run"), (F.lag("place").over(order).isNull() & (F.col("place") >= 0)).alias("_new"))


def displaced_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows that an incoming row replaces with other values, with its hash and the reason."""
    news = incoming.select(*KEY, F.col("row_hash").alias("winning_row_hash"))
    return stored.join(news, list(KEY)).where("row_hash != winning_row_hash").select(F.lit(SUPERSEDED_BY_RUN).alias("reason"), "winning_row_hash", *BAR_COLUMNS)


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows whose key is not incoming, and all incoming rows."""
    return stored.join(incoming.select(*KEY), list(KEY), "left_anti").select(*BAR_COLUMNS).unionByName(incoming.select(*BAR_COLUMNS))
