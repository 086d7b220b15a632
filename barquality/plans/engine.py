"""The engine's front: what a caller of the service would use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..operators import analytics, occurrences
from ..schema import DAILY, FREQUENCIES, MINUTE, Settings
from . import insights as ins
from . import report
from .store import BarStore


class Engine:
    version = __version__

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.settings, self.store = spark, settings or Settings.from_environment(), BarStore(spark, root)

    def health(self) -> dict:
        return {"status": "ok", "version": self.version}

    def contracts(self) -> DataFrame:
        return analytics.catalogue(self.store.bars()).orderBy("contract", "frequency")

    def daily_ohlcv(self, contract: str | None = None, start=None, end=None, source: str = MINUTE) -> DataFrame:
        bars = self.store.bars(self._known(source), contract, start, end)
        out = analytics.daily_ohlcv(bars) if source == MINUTE else analytics.daily_passthrough(bars)
        return out.orderBy("contract", "trading_date")

    def vwap(self, contract: str | None = None, start=None, end=None, window: int | None = None, limit: int = 50_000) -> DataFrame:
        if not 1 <= limit <= 200_000:
            raise ValueError("limit must be from 1 to 200000")
        points = analytics.rolling_vwap(self.store.bars(MINUTE, contract, start, end), window or self.settings.vwap_window_minutes)
        return analytics.latest(points, limit).orderBy("contract", "ts")

    def occurrences(self, contract: str | None = None, frequency: str = MINUTE, start=None, end=None, codes: list[str] | None = None) -> DataFrame:
        scope = (self._known(frequency), contract, start, end)
        return occurrences.of_bars(self.store.bars(*scope), frequency, self.settings, self.store.superseded(*scope), codes=codes)

    def quality_report(self, contract: str | None = None, frequency: str = MINUTE, start=None, end=None) -> dict:
        """bars_checked, issues in report order, and samples of their occurrences."""
        occ = self.occurrences(contract, frequency, start, end)
        return {
            "bars_checked": self.store.bars(frequency, contract, start, end).count(),
            "issues": report.ordered(report.findings(occ, frequency, self.settings)),
            "details": report.samples(occ, self.settings.detail_cap),
        }

    def issue_details(self, code: str, contract: str | None = None, frequency: str = MINUTE, start=None, end=None, limit: int = 100, offset: int = 0) -> dict:
        total, rows = report.issue_details(self.occurrences(contract, frequency, start, end, [code]), code, limit, offset)
        return {"total": total, "offset": offset, "rows": rows, "has_more": offset + limit < total}

    def missing_timestamps(self, contract: str | None = None, frequency: str = MINUTE, start=None, end=None, limit: int = 2000, offset: int = 0) -> dict:
        total, rows = report.missing_timestamps(self.store.bars(self._known(frequency), contract, start, end), frequency, limit, offset, self.settings)
        return {"total": total, "offset": offset, "rows": rows, "has_more": offset + limit < total}

    def insights(self, client: ins.Client, contract: str | None = None, frequency: str = MINUTE, start=None, end=None) -> ins.InsightsReport:
        scope = (self._known(frequency), contract, start, end)
        pack = ins.evidence_pack(self.store.bars(*scope), self.store.superseded(*scope), frequency, self.settings, contract, start, end)
        return ins.insights(pack, client)

    @staticmethod
    def _known(frequency: str) -> str:
        if frequency not in FREQUENCIES:
            raise ValueError(f"frequency must be {MINUTE} or {DAILY}")
        return frequency
