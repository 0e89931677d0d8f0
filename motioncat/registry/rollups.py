"""Daily, hourly, cumulative and projected counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.operators import rollup
from motioncat.registry import query
from motioncat.registry.common import clipd, rounded, sql_day, sql_wide

COLS = sorted(fx.PIVOT_DEVICES)
Q = [f'"{c}"' for c in COLS]


def daily_query(metric: str) -> None:
    @query(f"daily_{metric}", with_ctes("clipd", sql_day(metric)))
    def run(spark, sf):
        out = rollup.daily(clipd(spark, sf), metric, fx.PIVOT_DEVICES)
        return out if metric == "activity" else rounded(out, *COLS)


def hourly_query(metric: str, bins: int) -> None:
    key = f"round(hour(dt) + floor((minute(dt) + second(dt) / 60.0::DOUBLE) / {60.0 / bins}::DOUBLE) / {float(bins)}::DOUBLE + {1.0 / (2 * bins)}::DOUBLE, 9)"

    @query(f"hourly_{metric}", with_ctes("clipd", sql_wide(metric, key, "hour")))
    def run(spark, sf):
        out = rollup.hourly(clipd(spark, sf), metric, fx.PIVOT_DEVICES, bins)
        out = out if metric == "activity" else rounded(out, *COLS)
        return rounded(out, "hour", digits=9)


for _metric, _bins in (("activity", 4), ("duration", 12), ("filesize", 6)):
    daily_query(_metric)
    hourly_query(_metric, _bins)

SQL_DENSE = "d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM w)"
SQL_SPREAD = "SELECT * REPLACE (dt + (CAST(dt AS DATE) - DATE '2024-01-01') * INTERVAL 1 DAY AS dt) FROM clipd"


def every_other_day(spark, sf):
    """All clips, their dates moved apart so that every other day has none."""
    return clipd(spark, sf).withColumn("dt", F.expr("dt + make_dt_interval(datediff(dt, DATE'2024-01-01'))"))



@query("densify_dates", with_ctes("clipd", f"""WITH lc AS ({SQL_SPREAD}), w AS ({sql_wide('activity', 'CAST(dt AS DATE)', 'date', 'lc')}),
  {SQL_DENSE} SELECT d.date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in Q)} FROM d LEFT JOIN w USING (date)"""))
def densify_dates(spark, sf):
    return rollup.densify_dates(rollup.daily(every_other_day(spark, sf), "activity", fx.PIVOT_DEVICES))


@query("row_total", with_ctes("clipd", f"""WITH lc AS ({SQL_SPREAD}), w AS ({sql_wide('activity', 'CAST(dt AS DATE)', 'date', 'lc')}),
  {SQL_DENSE} SELECT d.date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in Q)},
    nullif({' + '.join(f'coalesce({c}, 0)' for c in Q if c != '"S007"')}, 0) AS total FROM d LEFT JOIN w USING (date)"""))
def row_total(spark, sf):
    """The serial without a name is a column but no known device, so the total leaves it out."""
    wide = rollup.daily(every_other_day(spark, sf), "activity", fx.PIVOT_DEVICES)
    return rollup.row_total(rollup.densify_dates(wide), fx.ALL_DEVICES)


@query("cumulative_daily", with_ctes("clipd", f"""WITH lc AS ({SQL_SPREAD}), w AS ({sql_wide('activity', 'CAST(dt AS DATE)', 'date', 'lc')}),
  c AS (SELECT date, {', '.join(f'CAST(sum({c}) OVER (ORDER BY date) AS BIGINT) AS {c}' for c in Q)} FROM w),
  {SQL_DENSE} SELECT d.date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in Q)} FROM d LEFT JOIN c USING (date)"""))
def cumulative_daily(spark, sf):
    return rollup.cumulative_daily(every_other_day(spark, sf), "activity", fx.PIVOT_DEVICES)


FORECAST = """WITH n AS (SELECT device, CAST(dt AS DATE) AS date, count(*) AS value FROM clipd GROUP BY 1, 2),
  g AS (SELECT device, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM n GROUP BY device),
  x AS (SELECT g.device, g.date, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM g LEFT JOIN n USING (device, date)),
  l AS (SELECT device, max(date) AS last_date, sum(value) AS total FROM x GROUP BY device),
  s AS (SELECT device, last_date, total, avg(value) AS m, stddev_pop(value) AS sd FROM x JOIN l USING (device) WHERE last_date - date < 14 GROUP BY 1, 2, 3),
  p AS (SELECT *, unnest(generate_series(1, 10)) AS i FROM s)
  SELECT device, date, 'actual' AS kind, value AS count, NULL AS count_lower, NULL AS count_upper,
    sum(value) OVER (PARTITION BY device ORDER BY date) AS cumulative, NULL AS cumulative_lower, NULL AS cumulative_upper FROM x
  UNION ALL SELECT device, last_date + CAST(i AS INT), 'projected', round(m, 6), round(greatest(0, m - sd), 6), round(m + sd, 6),
    round(total + m * i, 6), round(greatest(0, total + m * i - sd * sqrt(i)), 6), round(total + m * i + sd * sqrt(i), 6) FROM p"""


@query("forecast_counts", with_ctes("clipd", FORECAST))
def forecast_counts(spark, sf):
    counts = rollup.rollup_long(clipd(spark, sf), "activity", F.to_date("dt"), "date")
    out = rollup.forecast_counts(counts, ["device"], days_ahead=10, max_days=14)
    return rounded(out, "count", "count_lower", "count_upper", "cumulative", "cumulative_lower", "cumulative_upper")


@query("forecast_series", with_ctes("clipd", FORECAST + """
  UNION ALL SELECT l.device, last_date, 'projected', value, value, value, total, total, total FROM l JOIN x ON x.device = l.device AND x.date = l.last_date"""))
def forecast_series(spark, sf):
    """With the bridge: each projected series starts at the last actual day."""
    counts = rollup.rollup_long(clipd(spark, sf), "activity", F.to_date("dt"), "date")
    out = rollup.forecast_counts(counts, ["device"], days_ahead=10, max_days=14, bridge=True)
    return rounded(out, "count", "count_lower", "count_upper", "cumulative", "cumulative_lower", "cumulative_upper")
