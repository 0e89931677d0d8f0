"""Selectors: declarative criteria compiled to one Column predicate."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncat.functions.clips import seconds_of_day

Range = tuple[Any, Any]


def _parse_clock(text: str) -> int:
    try:
        t = datetime.strptime(text, "%H:%M:%S")
    except ValueError as exc:
        raise ValueError(f"time_range needs HH:MM:SS, got {text!r}") from exc
    return t.hour * 3600 + t.minute * 60 + t.second


def _as_list(value: Any) -> list[str] | None:
    return [value] if isinstance(value, str) else value


def _as_range(value: Any, low: str, high: str) -> Range | None:
    return (value.get(low), value.get(high)) if isinstance(value, dict) else None


@dataclass(frozen=True)
class Selector:
    """Criteria joined by AND; a list of selectors is joined by OR.

    An empty ``devices``, ``filenames`` or ``weekdays`` list accepts the row at that point
    and ignores every later criterion, in the order of the fields below.
    """

    devices: list[str] | None = None
    filenames: list[str] | None = None
    weekdays: list[str] | None = None
    date_range: Range | None = None
    date_regex: str | None = None
    duration_range: Range | None = None
    time_range: Range | None = None

    def __post_init__(self) -> None:
        for name, ends in (("duration_range", "min or max"), ("date_range", "start or end"), ("time_range", "start or end")):
            bounds = getattr(self, name)
            if bounds is not None and bounds[0] is None and bounds[1] is None:
                raise ValueError(f"{name} needs {ends}")
        if self.date_regex is not None:
            try:
                re.compile(f"^{self.date_regex}$")
            except re.error as exc:
                raise ValueError(f"date_regex {self.date_regex!r} does not compile: {exc}") from exc
        for text in filter(None, self.time_range or ()):
            _parse_clock(text)
        for text in filter(None, self.date_range or ()):
            datetime.strptime(text, "%Y-%m-%d")

    @classmethod
    def from_dict(cls, spec: dict[str, Any], known_devices: Iterable[str] | None = None, strict: bool = False) -> Selector:
        """Build from a parsed story file; unknown keys are ignored unless ``strict``."""
        unknown_keys = set(spec) - {f.name for f in fields(cls)}
        if strict and unknown_keys:
            raise ValueError(f"Unknown selector keys: {', '.join(sorted(unknown_keys))}")
        devices = _as_list(spec.get("devices"))
        if devices and known_devices is not None:
            known = set(known_devices)
            unknown = [d for d in devices if d not in known]
            if unknown:
                raise ValueError(f"Unknown devices: {', '.join(unknown)}")
        return cls(
            devices=devices,
            filenames=_as_list(spec.get("filenames")),
            weekdays=_as_list(spec.get("weekdays")),
            date_range=_as_range(spec.get("date_range"), "start", "end"),
            date_regex=spec.get("date_regex"),
            duration_range=_as_range(spec.get("duration_range"), "min", "max"),
            time_range=_as_range(spec.get("time_range"), "start", "end"),
        )

    def predicate(self, day: str | None = None) -> Column:
        """Predicate over clip columns; name a partition column ``day`` to prune by it too."""
        parts: list[Column] = []
        for values, test in (
            (self.devices, lambda v: F.col("device").isin(v)),
            (self.filenames, lambda v: F.col("filename").isin(v)),
            (self.weekdays, lambda v: F.lower(F.date_format("dt", "EEEE")).isin([d.lower() for d in v])),
        ):
            if values is None:
                continue
            if not values:
                return _all(parts)
            parts.append(test(values))
        if self.date_range is not None:
            parts.extend(_date_bounds(self.date_range, day))
        if self.date_regex is not None:
            # anchored at the start only as a whole, so that a top-level alternation keeps its branches
            parts.append(F.date_format("dt", "yyyy-MM-dd").rlike(f"^(?:^{self.date_regex}$)"))
        if self.duration_range is not None:
            low, high = self.duration_range
            parts += [F.col("duration_s") >= low] if low is not None else []
            parts += [F.col("duration_s") <= high] if high is not None else []
        if self.time_range is not None:
            parts.append(_clock_bounds(self.time_range))
        return _all(parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _date_bounds(bounds: Range, day: str | None) -> list[Column]:
    """Inclusive dates as bare comparisons on ``dt`` (and ``day``), which reach the scan."""
    start, end = bounds
    parts = []
    if start is not None:
        parts.append(F.col("dt") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        after = date.fromisoformat(end) + timedelta(days=1)
        parts.append(F.col("dt") < F.lit(after.isoformat()).cast("timestamp_ntz"))
    if day is not None:
        parts += [F.col(day) >= F.lit(start).cast("date")] if start is not None else []
        parts += [F.col(day) <= F.lit(end).cast("date")] if end is not None else []
    return parts


def _clock_bounds(bounds: Range) -> Column:
    start, end = (None if b is None else _parse_clock(b) for b in bounds)
    t = seconds_of_day(F.col("dt"))
    if start is None:
        return t <= end
    if end is None:
        return t >= start
    return t.between(start, end) if start <= end else (t >= start) | (t <= end)


def select_clips(clips: DataFrame, selectors: Selector | list[Selector] | None, day: str | None = None) -> DataFrame:
    """Rows matching any selector; none given keeps all rows."""
    if isinstance(selectors, Selector):
        selectors = [selectors]
    if not selectors:
        return clips
    return clips.filter(reduce(lambda a, b: a | b, [s.predicate(day) for s in selectors]))


def selector_devices(selectors: list[Selector]) -> list[str]:
    """Device names used by any selector, in order of first use."""
    return list(dict.fromkeys(d for s in selectors for d in (s.devices or [])))


def with_names(clips: DataFrame, names: DataFrame) -> DataFrame:
    """Clips whose file name is in a table of names, for lists too long for a criterion."""
    return clips.join(names, "filename", "left_semi")
