"""Stories: selectors plus an occupancy filter over the catalog."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.operators.catalog import catalog_stats, dedup_clips
from motioncat.operators.occupancy import join_occupancy
from motioncat.plans.selectors import Selector, select_clips

# ---- fixed values ----
STATUSES = ("OCCUPIED", "NOT_OCCUPIED", "UNKNOWN")


@dataclass(frozen=True)
class Story:
    name: str
    selectors: list[Selector] = field(default_factory=list)
    occupancy_status: list[str] | None = None

    def __post_init__(self) -> None:
        bad = [s for s in self.occupancy_status or [] if s not in STATUSES]
        if bad:
            raise ValueError(f"Invalid occupancy status: {', '.join(bad)}")

    @classmethod
    def from_dict(cls, spec: dict[str, Any], known_devices: Iterable[str] | None = None, strict: bool = False) -> Story:
        if not spec.get("name"):
            raise ValueError("Story needs a name")
        raw = spec.get("selectors") or []
        raw = [raw] if isinstance(raw, dict) else raw
        status = spec.get("occupancy_status")
        return cls(
            name=spec["name"],
            selectors=[Selector.from_dict(s, known_devices, strict) for s in raw],
            occupancy_status=[status] if isinstance(status, str) else status,
        )

    def select(self, clips: DataFrame, calendar: DataFrame | None = None, ordered: bool = True) -> DataFrame:
        """Matching clips, unique by (filename, dt); sorted by time when ``ordered``."""
        out = select_clips(clips, self.selectors)
        if self.occupancy_status is not None:
            if calendar is None:
                raise ValueError("an occupancy filter needs a calendar")
            out = filter_occupancy(out, calendar, self.occupancy_status)
        out = dedup_clips(out)
        return out.orderBy("dt", "filename") if ordered else out

    def statistics(self, clips: DataFrame, tags: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
        """One row of totals over the selected clips and their tags."""
        return catalog_stats(self.select(clips, calendar, ordered=False), tags)


def filter_occupancy(clips: DataFrame, calendar: DataFrame, statuses: list[str]) -> DataFrame:
    """Keep clips whose day has one of ``statuses``; days outside the calendar are UNKNOWN."""
    dated = clips.withColumn("date", F.to_date("dt"))
    return join_occupancy(dated, calendar).filter(F.col("status").isin(statuses)).drop("status", "date")
