"""Patterns and rule suggestions read from evidence by a model behind a port.

The engine computes the evidence; the model is any object with ``model`` and
``complete_json(system, user, schema)``.  What a reply may hold is declared as
Spark struct types with closed sets of values beside them: the JSON schema for
the model and the check of what comes back are both read off these types.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import cube, occurrences
from ..operators import evidence as ev
from ..schema import MINUTE, Settings
from ..shared import written
from . import report

#: The classes, confidences, kinds, codes and settings that a reply may name.
VALUES = {
    "classification": ["expected_market_behavior", "data_source_defect", "threshold_miscalibration", "ingestion_artifact", "unknown"],
    "confidence": ["low", "medium", "high"],
    "kind": ["cleansing", "validation"],
    "window_code": ["intra_session_gap", "volume_spike", "price_return_outlier"],
    "row_code": ["high_lt_low", "open_out_of_range", "close_out_of_range", "non_positive_price", "non_finite_price", "negative_volume", "missing_volume"],
    "dedupe_code": ["exact_duplicate", "repeated_timestamp", "conflicting_duplicate", "resolved_instant_conflict"],
    "policy": ["keep_first", "keep_last", "flag_only"],
    "setting": ["outlier_mad_threshold", "volume_spike_threshold", "gap_min_multiple"],
}
TUNABLE = tuple(VALUES["setting"])

#: The kinds of suggestion, what each says, and its parameters as a struct; a comment names a parameter's closed set.
SUGGESTED = """
expected_window        | validation | a daily window of exchange time in which a finding is expected and not reported       | contract string, code string COMMENT 'window_code', start_ct string, end_ct string
adjust_threshold       | validation | another value for a threshold                                                         | setting string COMMENT 'setting', value double
exclude_from_analytics | cleansing  | leave flagged bars out of daily bars and VWAP, and keep reporting them                | contract string, code string
reject_at_ingest       | validation | reject rows that break a single-row check when they arrive                            | code string COMMENT 'row_code'
dedupe_policy          | cleansing  | which row stays when an instant comes more than once                                  | code string COMMENT 'dedupe_code', policy string COMMENT 'policy'
custom                 |            | a rule that the other types cannot state                                              | description string
"""
PATTERN = (
    "id string, title string, classification string COMMENT 'classification', contracts array<string>, evidence_refs array<string>, explanation string, confidence string COMMENT 'confidence'"
)


def suggestion_types() -> dict[str, tuple[str, T.StructType]]:
    """Per kind of suggestion what it says and the struct that a reply has."""
    out = {}
    for line in SUGGESTED.strip().splitlines():
        name, kind, says, params = (x.strip() for x in line.split("|"))
        of_kind = T.StructField("kind", T.StringType(), True, {"only": [kind] if kind else VALUES["kind"]})
        whole = T.StructType([T.StructField("pattern_id", T.StringType()), T.StructField("type", T.StringType(), True, {"only": [name]}), of_kind, T.StructField("params", T.StructType.fromDDL(params)), T.StructField("rationale", T.StringType())])
        out[name] = says, whole
    return out


def _allowed(field: T.StructField) -> list[str] | None:
    return field.metadata.get("only") or VALUES.get(field.metadata.get("comment", ""))


def json_schema(kind: T.DataType, only: list[str] | None = None) -> dict:
    """The JSON schema of a Spark type; objects are closed."""
    if isinstance(kind, T.StructType):
        inner = {f.name: json_schema(f.dataType, _allowed(f)) for f in kind}
        return {"type": "object", "properties": inner, "required": kind.fieldNames(), "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": "number" if isinstance(kind, T.DoubleType) else "string"} | ({"enum": only} if only else {})


def listed(name: str, kinds: list[T.StructType]) -> dict:
    """The schema of a reply: one list of items, each of one of the kinds."""
    items = [json_schema(k) for k in kinds]
    return {"type": "object", "properties": {name: {"type": "array", "items": items[0] if len(items) == 1 else {"anyOf": items}}}, "required": [name], "additionalProperties": False}


def patterns_schema() -> dict:
    return listed("patterns", [T.StructType.fromDDL(PATTERN)])


def suggestions_schema() -> dict:
    return listed("suggestions", [kind for _, kind in suggestion_types().values()])


def misfit(value: Any, kind: T.DataType, only: list[str] | None = None, at: str = "item") -> str | None:
    """Why a value is not of a Spark type; None where it is."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, Mapping):
            return f"{at}: an object is wanted"
        for f in kind:
            if f.name not in value:
                return f"{f.name}: is missing"
            if why := misfit(value[f.name], f.dataType, _allowed(f), f.name):
                return why
        return None
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return f"{at}: a list is wanted"
        return next((why for x in value if (why := misfit(x, kind.elementType, None, at))), None)
    if isinstance(kind, T.DoubleType):
        return None if isinstance(value, (int, float)) and not isinstance(value, bool) else f"{at}: a number is wanted"
    if not isinstance(value, str):
        return f"{at}: text is wanted"
    return f"{at}: not one of {', '.join(only)}" if only and value not in only else None


class ProviderError(RuntimeError):
    """The model could not be asked, or its reply has not the agreed shape."""


class Client(Protocol):
    model: str

    def complete_json(self, system: str, user: str, schema: dict) -> Any: ...


@dataclass(frozen=True)
class Rejection:
    stage: str
    item: str | None
    reason: str


@dataclass
class InsightsReport:
    scope: dict
    model: str | None
    generated_at: dt.datetime
    evidence: list[dict]
    patterns: list[dict] = field(default_factory=list)
    suggestions: list[dict] = field(default_factory=list)
    rejected: list[Rejection] = field(default_factory=list)


def _sorted_out(stage: str, drafts: Iterable[object], kind_of) -> tuple[list[dict], list[Rejection]]:
    kept, refused = [], []
    for draft in drafts:
        kind = kind_of(draft)
        why = misfit(draft, kind) if kind is not None else "type: is not known"
        if why is None:
            kept.append({name: draft[name] for name in kind.fieldNames()})
        else:
            name = next((draft[k] for k in ("id", "title", "type") if isinstance(draft.get(k), str)), None) if isinstance(draft, Mapping) else None
            refused.append(Rejection(stage, name, why))
    return kept, refused


def verify_patterns(drafts: Iterable[object]) -> tuple[list[dict], list[Rejection]]:
    """Well-formed patterns, and a reason for each of the others; nothing is repaired."""
    kind = T.StructType.fromDDL(PATTERN)
    return _sorted_out("pattern", drafts, lambda _: kind)


def verify_suggestions(drafts: Iterable[object]) -> tuple[list[dict], list[Rejection]]:
    known = suggestion_types()

    def kind_of(draft: object) -> T.StructType | None:
        name = draft.get("type") if isinstance(draft, Mapping) else None
        return known[name][1] if isinstance(name, str) and name in known else None

    return _sorted_out("suggestion", drafts, kind_of)


def patterns_prompt(pack: dict) -> tuple[str, str]:
    system = (
        "You read statistics about quality findings in futures bars and name recurring patterns. "
        "Times are exchange time, America/Chicago. Cite evidence by id, quote its figures as they are, compute none, and answer in JSON."
    )
    return system, json.dumps(pack, default=str, separators=(",", ":"))


def suggestions_prompt(pack: dict, patterns: list[dict]) -> tuple[str, str]:
    types = "\n".join(f"- {name}: {says}; params {', '.join(kind['params'].dataType.fieldNames())}" for name, (says, kind) in suggestion_types().items())
    system = f"You propose rule changes for the patterns given, of these types only, and answer in JSON.\n{types}"
    return system, json.dumps({"evidence": pack, "patterns": patterns}, default=str, separators=(",", ":"))


def _plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def top_findings(cells: DataFrame, frequency: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the findings of a cube in report order."""
    seen = cube.seen(cells).where("occurrences > 0").withColumns({"category": occurrences.category(), "severity": occurrences.severity(frequency)})
    return report.ordered(seen).offset(offset).limit(limit).select(*cube.FINDING, "category", "severity")


def evidence_pack(
    bars: DataFrame, superseded: DataFrame | None = None, frequency: str = MINUTE, settings: Settings = Settings(), contract: str | None = None, start=None, end=None, offset: int = 0
) -> dict:
    """Scope, thresholds and one entry per finding, E1, E2, ... in report order.

    The rules run once, for the count cube.  At most ``settings.pack_limit``
    findings come to the driver, from ``offset`` on (a duplicated bar is a
    finding of its own, so their number grows with the data); the scope says
    how many there are.
    """
    cells = written(cube.cells(occurrences.of_bars(bars, frequency, settings, superseded), frequency, settings), "evidence-cube")
    scope_row = ev.scope_of(bars)
    page = top_findings(cells, frequency, settings.pack_limit, offset)
    named = ev.figures(cells, scope_row, frequency, page.select(*cube.FINDING)).withColumns({"category": occurrences.category(), "severity": occurrences.severity(frequency)})
    rows = report.ordered(named).limit(settings.pack_limit).collect()
    scope = scope_row.first().asDict() | {"findings": cube.seen(cells).where("occurrences > 0").count(), "offset": offset}
    entries = [{"id": f"E{offset + i}"} | {k: v for k, v in _plain(r).items() if k not in ("group", "bars_checked", "trading_days")} for i, r in enumerate(rows, 1)]
    scope |= {"contract": contract, "frequency": frequency, "start": start, "end": end, "timezone": settings.daily_bar_tz, "after_gap_window_min": cube.AFTER_GAP_MINUTES}
    return {"scope": scope, "thresholds": {n: float(getattr(settings, n)) for n in TUNABLE}, "evidence": entries}


def _ask(client: Client, name: str, prompt: tuple[str, str], schema: dict) -> list:
    reply = client.complete_json(*prompt, schema)
    items = reply.get(name) if isinstance(reply, Mapping) else None
    if not isinstance(items, list):
        raise ProviderError(f"the reply has no list of {name}")
    return items


def insights(pack: dict, client: Client) -> InsightsReport:
    """Ask for patterns, then for suggestions; without findings or patterns nothing is asked."""
    out = InsightsReport(pack["scope"], client.model, dt.datetime.now(dt.UTC), pack["evidence"])
    if not pack["evidence"]:
        return out
    out.patterns, refused = verify_patterns(_ask(client, "patterns", patterns_prompt(pack), patterns_schema()))
    out.rejected += refused
    if out.patterns:
        out.suggestions, refused = verify_suggestions(_ask(client, "suggestions", suggestions_prompt(pack, out.patterns), suggestions_schema()))
        out.rejected += refused
    return out


def fact_lines(entry: dict) -> list[str]:
    """One line per figure that an entry has."""
    def percent(x: float) -> str:
        return f"{x * 100:.1f}%"

    lines = [f"{entry['occurrences']:,} occurrences", f"{entry['per_1k_bars']:g} per 1,000 bars"]
    if entry.get("days_affected"):
        share = f" ({percent(entry['days_affected_share'])} of trading days)" if entry.get("days_affected_share") is not None else ""
        lines.append(f"on {entry['days_affected']:,} days{share}")
    if entry.get("top_hours"):
        lines.append("busiest hours CT: " + ", ".join(f"{h['hour']:02d}:00 {percent(h['share'])}" for h in entry["top_hours"]))
    for key, text in (("median_duration_min", "median gap {:g} min"), ("p90_duration_min", "90th percentile gap {:g} min"), ("max_magnitude", "most extreme {:g}")):
        if entry.get(key) is not None:
            lines.append(text.format(entry[key]))
    if entry.get("share_after_gap") is not None:
        lines.append(f"{percent(entry['share_after_gap'])} just after a gap")
    return lines


def joined(result: InsightsReport) -> list[dict]:
    """Each pattern with its evidence entries and suggestions."""
    by_id = {e["id"]: e for e in result.evidence}
    return [p | {"evidence": [by_id[i] for i in p["evidence_refs"] if i in by_id], "suggestions": [s for s in result.suggestions if s["pattern_id"] == p["id"]]} for p in result.patterns]
