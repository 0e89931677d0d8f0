"""Figures of one dashboard view, all from one selection."""

from __future__ import annotations

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.plans.dashboard import WEEKDAYS, Dashboard
from motioncat.registry import query
from motioncat.registry.common import clipd, rounded, sql_wide

COLS = sorted(fx.PIVOT_DEVICES)
Q = [f'"{c}"' for c in COLS]
# all weekdays and a text that is no number say nothing; the slider ends at 21:30
VIEW = Dashboard(
    start_date="2024-01-03", devices=["Backyard", "Garage", "Walkway"], weekdays=list(WEEKDAYS), duration_min="5", duration_max="long",
    start_hour=6.25, end_hour=21.5, bins_per_hour=2, metric="duration",
)
VIEW_SQL = """v AS (SELECT * FROM clipd WHERE device IN ('Backyard', 'Garage', 'Walkway') AND CAST(dt AS DATE) >= DATE '2024-01-03' AND duration_s >= 5
  AND CAST(dt AS TIME) BETWEEN TIME '06:15:00' AND TIME '21:30:00')"""
DAILY = f"d AS ({sql_wide('duration', 'CAST(dt AS DATE)', 'date', 'v')})"
HOUR = "round(hour(dt) + floor((minute(dt) + second(dt) / 60.0::DOUBLE) / 30.0::DOUBLE) / 2.0::DOUBLE + 0.25::DOUBLE, 9)"


def view(spark, sf, name):
    return VIEW.frames(clipd(spark, sf), fx.ALL_DEVICES, fx.PIVOT_DEVICES)[name]


@query("dashboard_view_totals", with_ctes("clipd", f"""WITH {VIEW_SQL} SELECT count(*) AS num_videos, count(DISTINCT CAST(dt AS DATE)) AS num_days,
  CAST(coalesce(sum(frame_count), 0) AS BIGINT) AS num_frames, round(coalesce(sum(duration_s), 0), 4) AS seconds, round(coalesce(sum(file_size), 0), 4) AS size_mb FROM v"""))
def dashboard_view_totals(spark, sf):
    return rounded(view(spark, sf, "totals"), "seconds", "size_mb", digits=4)


@query("dashboard_view_daily", with_ctes("clipd", f"WITH {VIEW_SQL}, {DAILY} SELECT * FROM d"))
def dashboard_view_daily(spark, sf):
    return rounded(view(spark, sf, "daily"), *COLS)


@query("dashboard_view_hourly", with_ctes("clipd", f"WITH {VIEW_SQL} {sql_wide('duration', HOUR, 'hour', 'v')}"))
def dashboard_view_hourly(spark, sf):
    return rounded(rounded(view(spark, sf, "hourly"), *COLS), "hour", digits=9)


@query("dashboard_view_cumulative", with_ctes("clipd", f"""WITH {VIEW_SQL}, {DAILY}, c AS (SELECT date, {', '.join(f'sum({c}) OVER (ORDER BY date) AS {c}' for c in Q)} FROM d),
  g AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
  SELECT g.date, {', '.join(f'round(coalesce({c}, 0), 4) AS {c}' for c in Q)} FROM g LEFT JOIN c USING (date)"""))
def dashboard_view_cumulative(spark, sf):
    return rounded(view(spark, sf, "cumulative"), *COLS, digits=4)
