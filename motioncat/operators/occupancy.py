"""Occupancy of the place per day: calendar, rule, decision tree and their comparison."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncat.operators.ordered import running
from motioncat.session import materialize, small_side

# ---- fixed values ----
OCCUPIED, NOT_OCCUPIED, UNKNOWN = "OCCUPIED", "NOT_OCCUPIED", "UNKNOWN"
RULE_DEVICE, RULE_THRESHOLD = "Backyard", 15.5
DEEPEST = 30  # of the library, standing for no limit
GRID_MAX_DEPTH = [DEEPEST, 3, 4, 5]
GRID_MIN_LEAF = [1, 2, 4]
GRID_IMPURITY = ["gini", "entropy"]
GRID_MIN_SPLIT = [2, 3, 5]  # no counterpart in the library
TRAINING_METHODS = ["simple", "cross_validation", "leave_one_out", "grid_search"]


def calendar_expand(calendar: DataFrame) -> DataFrame:
    """One row per date; a later range overrides an earlier one."""
    days = calendar.select("ord", "status", F.explode(F.expr("sequence(start_date, end_date, INTERVAL 1 DAY)")).alias("date"))
    return days.groupBy("date").agg(F.max_by("status", "ord").alias("status"))


def join_occupancy(dated: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add ``status`` to rows with a ``date``; UNKNOWN outside the calendar."""
    out = dated.join(small_side(calendar_expand(calendar)), "date", "left")
    return out.withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))


def join_training(daily: DataFrame, calendar: DataFrame, check: bool = True) -> DataFrame:
    """Daily features of dates with a known status, with label 1 for OCCUPIED."""
    known = calendar_expand(calendar.filter(F.col("status") != UNKNOWN))
    out = daily.join(known, "date").withColumn("label", (F.col("status") == OCCUPIED).cast("int"))
    if check and out.isEmpty():
        raise ValueError("the calendar and the daily data share no date")
    return out


def _verdict(occupied: Column) -> Column:
    return F.when(occupied, OCCUPIED).otherwise(NOT_OCCUPIED)


def occupancy_heuristic(daily: DataFrame, device: str = RULE_DEVICE, threshold: float = RULE_THRESHOLD) -> DataFrame:
    """Status by one device's daily count; a missing column counts as 0."""
    seen = F.col(f"`{device}`") if device in daily.columns else F.lit(0)
    return daily.select("date", _verdict(seen > threshold).alias("status"))


def tree_as_expression(model: DecisionTreeClassificationModel, features: list[str], columns: list[str]) -> Column:
    """The trained tree as a CASE expression, so that applying it needs no model on the executors."""
    lines = [ln for ln in model.toDebugString.splitlines()[1:] if ln.strip()]

    def build(pos: int) -> tuple[Column, int]:
        text = lines[pos].strip()
        if text.startswith("Predict:"):
            return F.lit(float(text.split(":")[1])), pos + 1
        inside = text[text.index("(") + 1 : text.rindex(")")].split()
        name, bound = features[int(inside[1])], float(inside[3])
        column = F.col(f"`{name}`") if name in columns else F.lit(0)
        low, nxt = build(pos + 1)
        high, nxt = build(nxt + 1)
        return F.when(column <= bound, low).otherwise(high), nxt

    return build(0)[0]


def apply_tree(daily: DataFrame, model: DecisionTreeClassificationModel, features: list[str]) -> DataFrame:
    label = tree_as_expression(model, features, daily.columns)
    return daily.select("date", _verdict(label == 1.0).alias("status"))


def tree_pipeline(features: list[str], max_bins: int = 256, seed: int = 1000, **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, DecisionTreeClassifier(labelCol="label", maxBins=max_bins, seed=seed, **params)])


def train_occupancy(
    training: DataFrame, features: list[str], method: str = "simple", folds: int = 5, max_depth: int | None = None,
    test_size: float = 0.2, random_state: int = 42, max_bins: int | None = None,
) -> dict:
    """Fit the tree and score it: simple (a part held out), cross_validation, leave_one_out or grid_search.

    Days are dealt by the rank of a hash of their date, so folds are even whatever dates there
    are, and a repeated run scores the same split. ``max_depth`` None is the deepest tree of
    the library; ``max_bins`` None makes every distinct value of a feature a split candidate.
    ``skipped`` in the result names parameters of a grid that the library does not have.
    """
    if method not in TRAINING_METHODS:
        raise ValueError(f"training method {method!r} is not known")
    days = training.select("date", *features, F.col("label").cast("double").alias("label"), F.xxhash64("date", F.lit(random_state)).alias("_hash"))
    data = materialize(running(days, [], ["_hash", "date"], {"_rank": F.lit(1)}), "training-days")
    score = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    rows, *values = data.agg(F.count("*"), *[F.countDistinct(f"`{f}`") for f in features]).first()
    if rows < 2:
        raise ValueError("training needs two days at least")
    bins = max_bins or max(2, *values)
    pipe = tree_pipeline(features, bins, random_state, maxDepth=DEEPEST if max_depth is None else max_depth)
    if method == "simple":
        held = F.col("_rank") <= max(1, round(rows * test_size))
        model = pipe.fit(data.filter(~held))
        return {"model": model, "accuracy": score.evaluate(model.transform(data.filter(held))), "skipped": {}}
    folds = rows if method == "leave_one_out" else min(folds, rows)
    data = data.withColumn("fold", (F.col("_rank") % folds).cast("int"))
    tree = pipe.getStages()[1]
    grid = ParamGridBuilder()
    if method == "grid_search":
        grid = grid.addGrid(tree.maxDepth, GRID_MAX_DEPTH).addGrid(tree.minInstancesPerNode, GRID_MIN_LEAF).addGrid(tree.impurity, GRID_IMPURITY)
    cv = CrossValidator(
        estimator=pipe, estimatorParamMaps=grid.build(), evaluator=score, numFolds=folds, foldCol="fold", parallelism=4
    ).fit(data)
    skipped = {"min_samples_split": GRID_MIN_SPLIT} if method == "grid_search" else {}
    return {"model": cv.bestModel, "accuracy": max(cv.avgMetrics), "cv_scores": cv.avgMetrics, "skipped": skipped}


def feature_importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    return dict(zip(features, (float(v) for v in model.stages[-1].featureImportances.toArray())))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model_or_calendar(path: str, daily: DataFrame, features: list[str], calendar: DataFrame) -> DataFrame:
    """Statuses by the saved tree; when it cannot be loaded, those of the calendar."""
    try:
        model = PipelineModel.load(path)
    except Exception:  # a missing or broken model must not stop the run
        return calendar_expand(calendar)
    return apply_tree(daily, model.stages[-1], features)


def dates_union(*statuses: DataFrame) -> DataFrame:
    out = statuses[0].select("date")
    for s in statuses[1:]:
        out = out.union(s.select("date"))
    return out.distinct()


def compare_occupancy(calendar: DataFrame, heuristic: DataFrame, model: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Statuses of the three sources side by side for every date any of them has."""
    out = calendar.select("date", F.col("status").alias("calendar"))
    for name, frame in (("heuristic", heuristic), ("ml_model", model)):
        out = out.join(frame.select("date", F.col("status").alias(name)), "date", "full")
    out = out.fillna(UNKNOWN, ["calendar", "heuristic", "ml_model"])
    return out if daily is None else out.join(daily, "date", "left")


def disagreements(compared: DataFrame) -> DataFrame:
    """Dates on which the rule or the model differs from the calendar."""
    return compared.filter((F.col("calendar") != F.col("heuristic")) | (F.col("calendar") != F.col("ml_model")))


def occupancy_accuracy(compared: DataFrame) -> DataFrame:
    known = compared.filter(F.col("calendar") != UNKNOWN)
    hit = lambda c: F.coalesce(F.sum((F.col("calendar") == F.col(c)).cast("bigint")), F.lit(0))
    totals = known.agg(F.count("*").alias("total_samples"), hit("heuristic").alias("heuristic_correct"), hit("ml_model").alias("ml_correct"))
    share = lambda c: F.when(F.col("total_samples") > 0, F.col(c) / F.col("total_samples")).otherwise(0.0)
    return totals.select("*", share("heuristic_correct").alias("heuristic_accuracy"), share("ml_correct").alias("ml_accuracy"))


def misclassified_by_point(compared: DataFrame, features: list[str]) -> DataFrame:
    """Per feature point and prediction: totals and the dates that were wrong (one entry per day)."""
    wrong = F.col("ml_model") != F.col("calendar")
    known = compared.filter(F.col("calendar") != UNKNOWN)
    return known.groupBy(*[F.col(f"`{f}`") for f in features], "ml_model").agg(
        F.count("*").alias("total_count"),
        F.sum((~wrong).cast("bigint")).alias("correct_count"),
        F.sum(wrong.cast("bigint")).alias("misclassified_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(wrong, F.col("date").cast("string")))), ",").alias("wrong_dates"),
    )
