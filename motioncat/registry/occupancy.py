"""Occupancy of the place: calendar, rule, tree and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.operators import occupancy as occ
from motioncat.operators import rollup
from motioncat.registry import query
from motioncat.registry.common import clipd, rounded, sql_day
from motioncat.session import materialize, scratch_path

FEATURES = ["Backyard", "Front Door", "Walkway"]
F_SQL = ", ".join(f'"{f}"' for f in FEATURES)


def threshold_sql() -> str:
    """Half-integer nearest the mean daily count, so that both classes occur at every scale."""
    return '(SELECT floor(avg("Backyard")) + 0.5 FROM w)'


def daily(spark, sf):
    return rollup.daily(clipd(spark, sf), "activity", fx.PIVOT_DEVICES)


def heuristic(spark, sf, wide):
    level = wide.agg((F.floor(F.avg("Backyard")) + 0.5).alias("t")).first().t
    return occ.occupancy_heuristic(wide, "Backyard", level)


def three_way(spark, sf):
    """Calendar, rule, and a tree that was taught to split the front door's counts near their mean."""
    wide = materialize(daily(spark, sf), "daily")
    front = wide.agg((F.floor(F.avg("Front Door")) + 0.5).alias("t")).first().t
    taught = wide.withColumn("label", (F.col("Front Door") > front).cast("double"))
    fitted = occ.tree_pipeline(["Front Door"], max_bins=max(2, wide.select("Front Door").distinct().count())).fit(taught)
    tree = occ.apply_tree(wide, fitted.stages[-1], ["Front Door"])
    return occ.compare_occupancy(occ.calendar_expand(fx.calendar(spark)), heuristic(spark, sf, wide), tree, wide.select("date", *FEATURES))


SQL_THREE = f"""w AS ({sql_day('activity')}),
  h AS (SELECT date, CASE WHEN "Backyard" > {threshold_sql()} THEN 'OCCUPIED' ELSE 'NOT_OCCUPIED' END AS status FROM w),
  m AS (SELECT date, CASE WHEN "Front Door" > (SELECT floor(avg("Front Door")) + 0.5 FROM w) THEN 'OCCUPIED' ELSE 'NOT_OCCUPIED' END AS status FROM w),
  alld AS (SELECT date FROM caldays UNION SELECT date FROM h UNION SELECT date FROM m),
  cmp AS (SELECT a.date, coalesce(c.status, 'UNKNOWN') AS calendar, coalesce(h.status, 'UNKNOWN') AS heuristic, coalesce(m.status, 'UNKNOWN') AS ml_model, {F_SQL}
    FROM alld a LEFT JOIN caldays c USING (date) LEFT JOIN h USING (date) LEFT JOIN m USING (date) LEFT JOIN w USING (date))"""


def order_ranges(spark, sf):
    return fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS ord", "CAST(o_orderdate AS DATE) AS start_date", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 5 AS INT)) AS end_date",
        "CASE o_orderstatus WHEN 'F' THEN 'OCCUPIED' WHEN 'O' THEN 'NOT_OCCUPIED' ELSE 'UNKNOWN' END AS status",
    )


SQL_RANGES = """WITH r AS (SELECT o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'OCCUPIED' WHEN 'O' THEN 'NOT_OCCUPIED' ELSE 'UNKNOWN' END AS status,
    CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT), INTERVAL 1 DAY)) AS DATE) AS date FROM orders)
  SELECT date, arg_max(status, ord) AS status FROM r GROUP BY date"""


@query("calendar_expand", SQL_RANGES)
def calendar_expand(spark, sf):
    """Ranges taken from the orders: several thousand overlapping ones."""
    return occ.calendar_expand(order_ranges(spark, sf))


@query("write_occupancy_csv", f"WITH c AS ({SQL_RANGES}) SELECT CAST(date AS VARCHAR) AS date, status AS occupancy_status FROM c")
def write_occupancy_csv(spark, sf):
    from motioncat.sources.tables import read_occupancy_csv, write_occupancy_csv as write

    path = scratch_path(spark, "occupancy")
    write(occ.calendar_expand(order_ranges(spark, sf)), path)
    return read_occupancy_csv(spark, path).select(F.col("date").cast("string").alias("date"), "occupancy_status")


@query("join_occupancy", with_ctes("clipd caldays", f"""WITH w AS ({sql_day('activity')}) SELECT w.*, coalesce(status, 'UNKNOWN') AS status FROM w LEFT JOIN caldays USING (date)"""))
def join_occupancy(spark, sf):
    return occ.join_occupancy(daily(spark, sf), fx.calendar(spark))


@query("join_training", with_ctes("clipd caldays", f"""WITH w AS ({sql_day('activity')}) SELECT w.*, status, CASE WHEN status = 'OCCUPIED' THEN 1 ELSE 0 END AS label FROM w JOIN caldays USING (date)"""))
def join_training(spark, sf):
    return occ.join_training(daily(spark, sf), fx.calendar(spark))


@query("select_feature_columns", with_ctes("clipd", f"WITH w AS ({sql_day('activity')}) SELECT date, {F_SQL} FROM w"))
def select_feature_columns(spark, sf):
    """The pivot lists only the wanted devices; days without any of them stay, as zeros."""
    return rollup.daily(clipd(spark, sf), "activity", FEATURES)


@query("occupancy_heuristic", with_ctes("clipd caldays", f"WITH {SQL_THREE} SELECT date, status FROM h"))
def occupancy_heuristic(spark, sf):
    return heuristic(spark, sf, daily(spark, sf))


@query("dates_union", with_ctes("clipd caldays", f"WITH {SQL_THREE} SELECT date FROM alld"))
def dates_union(spark, sf):
    wide = daily(spark, sf)
    return occ.dates_union(occ.calendar_expand(fx.calendar(spark)), heuristic(spark, sf, wide), wide)


@query("compare_occupancy", with_ctes("clipd caldays", f"WITH {SQL_THREE} SELECT * FROM cmp"))
def compare_occupancy(spark, sf):
    return three_way(spark, sf)


@query("occupancy_errors", with_ctes("clipd caldays", f"WITH {SQL_THREE} SELECT * FROM cmp WHERE calendar <> heuristic OR calendar <> ml_model"))
def occupancy_errors(spark, sf):
    return occ.disagreements(three_way(spark, sf))


@query("occupancy_accuracy", with_ctes("clipd caldays", f"""WITH {SQL_THREE}, k AS (SELECT * FROM cmp WHERE calendar <> 'UNKNOWN')
  SELECT count(*) AS total_samples, count(*) FILTER (WHERE calendar = heuristic) AS heuristic_correct, count(*) FILTER (WHERE calendar = ml_model) AS ml_correct,
    round(count(*) FILTER (WHERE calendar = heuristic) / count(*), 6) AS heuristic_accuracy, round(count(*) FILTER (WHERE calendar = ml_model) / count(*), 6) AS ml_accuracy FROM k"""))
def occupancy_accuracy(spark, sf):
    return rounded(occ.occupancy_accuracy(three_way(spark, sf)), "heuristic_accuracy", "ml_accuracy")


@query("misclassified_by_point", with_ctes("clipd caldays", f"""WITH {SQL_THREE} SELECT "Front Door", "Walkway", ml_model, count(*) AS total_count,
  count(*) FILTER (WHERE ml_model = calendar) AS correct_count, count(*) FILTER (WHERE ml_model <> calendar) AS misclassified_count,
  coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE ml_model <> calendar), '') AS wrong_dates
  FROM cmp WHERE calendar <> 'UNKNOWN' GROUP BY 1, 2, 3"""))
def misclassified_by_point(spark, sf):
    return occ.misclassified_by_point(three_way(spark, sf), ["Front Door", "Walkway"])


SQL_TRAINED = f"""w AS ({sql_day('activity')}),
  t AS (SELECT count(DISTINCT "Backyard" > {threshold_sql()}) AS classes FROM w)
  SELECT method, feature, CAST(1 AS DOUBLE) AS accuracy, CAST(CASE WHEN feature = 'Backyard' AND classes = 2 THEN 1 ELSE 0 END AS DOUBLE) AS importance
  FROM t, (SELECT unnest(['simple', 'cross_validation', 'leave_one_out', 'grid_search']) AS method), (SELECT unnest(['Backyard', 'Front Door', 'Walkway']) AS feature)"""


@query("occupancy_tree_train", with_ctes("clipd", f"WITH {SQL_TRAINED}"))
def occupancy_tree_train(spark, sf):
    """All four methods on labels that a gap in one feature separates: each must find that feature alone and make no error."""
    wide = daily(spark, sf)
    taught = heuristic(spark, sf, wide).select("date", (F.col("status") == "OCCUPIED").cast("int").alias("label"))
    training = wide.join(taught, "date").withColumn("Backyard", F.col("Backyard") + 1000 * F.col("label"))
    training = materialize(training.select("date", *FEATURES, "label"), "taught")
    rows = []
    for method in occ.TRAINING_METHODS:
        fit = occ.train_occupancy(training, FEATURES, method)
        for feature, weight in occ.feature_importances(fit["model"], FEATURES).items():
            rows.append((method, feature, float(fit["accuracy"]), weight))
    return spark.createDataFrame(rows, "method string, feature string, accuracy double, importance double")


def taught_by_rule(spark, sf, wide):
    taught = heuristic(spark, sf, wide).withColumn("label", (F.col("status") == "OCCUPIED").cast("double"))
    return occ.tree_pipeline(FEATURES, maxDepth=3).fit(materialize(wide.join(taught.select("date", "label"), "date"), "taught"))


@query("occupancy_tree_apply", with_ctes("clipd caldays", f"WITH {SQL_THREE} SELECT date, status FROM h"))
def occupancy_tree_apply(spark, sf):
    """A tree trained on the rule's own verdicts must repeat them when applied as an expression."""
    wide = daily(spark, sf)
    return occ.apply_tree(wide, taught_by_rule(spark, sf, wide).stages[-1], FEATURES)


@query("occupancy_model_io", with_ctes("clipd caldays", f"WITH {SQL_THREE} SELECT date, status FROM h"))
def occupancy_model_io(spark, sf):
    """The same tree saved, loaded and applied."""
    wide = daily(spark, sf)
    path = scratch_path(spark, "occupancy-model")
    occ.save_model(taught_by_rule(spark, sf, wide), path)
    return occ.load_model_or_calendar(path, wide, FEATURES, fx.calendar(spark))
