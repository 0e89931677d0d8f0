"""Dashboard: the settings of one view become one selection, and all its figures come from one small cube."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.functions.clips import hour_bin
from motioncat.operators.catalog import catalog_bounds
from motioncat.operators.rollup import METRICS, cumulative, to_wide
from motioncat.plans.selectors import Selector, select_clips
from motioncat.session import materialize

# ---- fixed values ----
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WHOLE_DAY = ("00:00:00", "23:59:59")


def clock_of(hours: float) -> str:
    """A slider's decimal hour to the nearest minute; the end of the day is its last second."""
    minutes = round(hours * 60)
    return WHOLE_DAY[1] if minutes >= 24 * 60 else f"{minutes // 60:02d}:{minutes % 60:02d}:00"


def _number(text: str | None) -> float | None:
    """What a text field says; anything that is no number says nothing."""
    try:
        return float(text) if text and text.strip() else None
    except ValueError:
        return None


@dataclass(frozen=True)
class Dashboard:
    """Settings of a view; a setting that spans all there is becomes no criterion."""

    start_date: str | None = None
    end_date: str | None = None
    date_regex: str | None = None
    duration_min: str | None = None
    duration_max: str | None = None
    start_hour: float | None = None
    end_hour: float | None = None
    devices: list[str] | None = None
    weekdays: list[str] | None = None
    bins_per_hour: int = 4
    metric: str = "activity"

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric {self.metric!r} is none of {METRICS}")

    def selector(self, bounds: tuple[str | None, str | None], known_devices: Iterable[str]) -> Selector:
        """The criteria of the view, given the first and last date of the catalog and its devices."""
        dates = (self.start_date or bounds[0], self.end_date or bounds[1])
        clock = (
            WHOLE_DAY[0] if self.start_hour is None else clock_of(self.start_hour),
            WHOLE_DAY[1] if self.end_hour is None else clock_of(self.end_hour),
        )
        lengths = (_number(self.duration_min), _number(self.duration_max))

        def some(chosen: list[str] | None, known: Iterable[str]) -> list[str] | None:
            return None if chosen is None or set(known) <= set(chosen) else list(chosen)

        return Selector(
            devices=some(self.devices, known_devices),
            weekdays=some(self.weekdays, WEEKDAYS),
            date_range=None if dates == tuple(bounds) else dates,
            date_regex=self.date_regex or None,
            duration_range=None if lengths == (None, None) else lengths,
            time_range=None if clock == WHOLE_DAY else clock,
        )

    def frames(self, clips: DataFrame, known_devices: Iterable[str], columns: list[str]) -> dict[str, DataFrame]:
        """``totals``, ``daily``, ``hourly`` and ``cumulative`` of the selected clips.

        Clips are read once, into a written cube with a row per date, hour bin and device; every
        figure sums rows of it. An empty selection gives totals of zero and charts without rows.
        """
        low, high = catalog_bounds(clips).first()
        bounds = (low.isoformat(), high.isoformat()) if low else (None, None)
        chosen = select_clips(clips, self.selector(bounds, known_devices))
        cube = chosen.groupBy(F.to_date("dt").alias("date"), hour_bin(F.col("dt"), self.bins_per_hour).alias("hour"), "device").agg(
            F.count("*").alias("videos"), F.sum("frame_count").alias("frames"),
            F.sum("duration_s").alias("seconds"), F.sum("file_size").alias("size_mb"),
        )
        cube = materialize(cube, "cube")
        value = {"activity": F.sum("videos"), "duration": F.sum(F.col("seconds") / 60), "filesize": F.sum("size_mb")}[self.metric]

        def chart(name: str) -> DataFrame:
            return to_wide(cube.groupBy(name, "device").agg(value.alias("value")), name, columns)

        days = cube.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("videos", "frames", "seconds", "size_mb")])
        zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
        totals = days.agg(
            F.coalesce(F.sum("videos"), zero).alias("num_videos"), F.count("*").alias("num_days"), F.coalesce(F.sum("frames"), zero).alias("num_frames"),
            F.coalesce(F.sum("seconds"), none).alias("seconds"), F.coalesce(F.sum("size_mb"), none).alias("size_mb"),
        )
        daily = chart("date")
        return {"totals": totals, "daily": daily, "hourly": chart("hour"), "cumulative": cumulative(daily, columns)}
