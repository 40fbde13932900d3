"""Denial risk with MLlib's features and models: a weighted random forest, scores and their reasons."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import fmean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_error, ratio
from ..functions.text import first_digits, has
from ..operators.quantiles import exact_quantiles
from .forest import grow

CATEGORIES = ["service_type", "drg", "main_fund", "main_inscl", "ptype"]
FROM_ERROR = ["error_code_num", "high_risk_error"]
NUMBERS = ["claim_amount", "claim_amount_log", "rw", "adjrw"]
#: Rows of a task that learns, and tasks at least.  They follow from the rows alone, so that every cluster learns the same forest.
LEARN_ROWS, LEARN_PARTS = 500_000, 24


def training_frame(claims: DataFrame) -> DataFrame:
    """One row per positive claim with defaults filled and the denial label."""

    def text(c: str, default: str):
        return F.coalesce(c, F.lit(default)).alias(c)

    denied = F.when(F.col("reimb_nhso") > 0, 0).when(is_error(exclude=("0",)), 1).otherwise(0)
    number = lambda c, n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n)
    code = F.coalesce("error_code", F.lit("0"))
    return claims.filter(F.col("claim_drg") > 0).select(
        "tran_id", "hn", text("service_type", "UN"), code.alias("error_code"), text("drg", "UNKNOWN"), text("main_fund", "UNKNOWN"),
        text("main_inscl", "UNKNOWN"), text("ptype", "UNKNOWN"), number("claim_drg", "claim_amount"), number("rw", "rw"),
        number("adjrw_nhso", "adjrw"), denied.alias("is_denied"), first_digits(code).alias("error_code_num"),
        has(code, "998").cast("int").alias("high_risk_error"), F.log1p(F.col("claim_drg").cast("double")).alias("claim_amount_log"),
    )


def feature_names(with_error: bool = True) -> list[str]:
    return [f"{c}_code" for c in CATEGORIES] + (FROM_ERROR if with_error else []) + NUMBERS


def feature_stages(with_error: bool = True) -> list:
    """Label codes in alphabetical order, read as numbers, beside the numeric features.

    The plain addition drops the nominal attribute, so a tree splits a code by order and is not
    limited by its number of values.  A value not seen in training gets the code after the last.
    """
    indexed = StringIndexer(inputCols=CATEGORIES, outputCols=[f"{c}_idx" for c in CATEGORIES], stringOrderType="alphabetAsc", handleInvalid="keep")
    plain = SQLTransformer(statement="SELECT *, " + ", ".join(f"{c}_idx + 0.0D AS {c}_code" for c in CATEGORIES) + " FROM __THIS__")
    return [indexed, plain, VectorAssembler(inputCols=feature_names(with_error), outputCol="features")]


def split(frame: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the claim id, so the split is stable.

    Each label is cut at its own quantile of the hash, so ``share`` of the denied and of the paid claims
    train, to a row.
    """
    place = F.pmod(F.xxhash64("tran_id", F.lit(seed)), F.lit(1 << 31))

    def cut(label: int) -> Column:
        own = frame.filter(F.col("is_denied") == label).select(place.alias("place"))
        return exact_quantiles(own, "place", [share]).select("value").scalar()

    trains = place <= F.when(F.col("is_denied") == 1, cut(1)).otherwise(cut(0))
    return frame.filter(trains), frame.filter(~trains)


def weighted(train: DataFrame) -> DataFrame:
    """Weight denied rows by how rare they are."""
    rate = train.agg(F.avg("is_denied")).scalar()
    return train.withColumn("_rate", rate).withColumn(
        "weight", F.when(F.col("is_denied") == 1, (1 - F.col("_rate")) / F.col("_rate")).otherwise(F.lit(1.0))
    ).drop("_rate")


def fitted(rows: DataFrame, with_error: bool = True, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Features and a forest that learned from rows with their weight."""
    coded = Pipeline(stages=feature_stages(with_error)).fit(rows)
    forest = grow(coded.transform(rows), "is_denied", "features", "weight", trees=trees, depth=depth, min_rows=2, seed=seed)
    return PipelineModel(stages=[*coded.stages, forest])


def spread(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows dealt over the cluster: files come in few large row groups, and a task a row group is too few for trees."""
    place = F.xxhash64(*rows.columns)
    return rows.repartition(place) if parts is None else rows.repartition(parts, place).sortWithinPartitions(*rows.columns)


def learning_rows(frame: DataFrame, *more: str) -> DataFrame:
    """What a forest learns from, read once and kept, in tasks of bounded size; the caller lets it go."""
    read = weighted(frame).select(*CATEGORIES, *FROM_ERROR, *NUMBERS, "is_denied", "weight", *more).persist()
    try:
        dealt = spread(read, max(LEARN_PARTS, -(-read.count() // LEARN_ROWS))).persist()
        dealt.count()
    finally:
        read.unpersist()
    return dealt


def train(frame: DataFrame, with_error: bool = True, **forest) -> PipelineModel:
    """Fit on a training split.  ``with_error=False`` leaves out the features the label is made from."""
    rows = learning_rows(frame)
    try:
        return fitted(rows, with_error, **forest)
    finally:
        rows.unpersist()


def metrics(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and AUC on held-out rows, as one row."""
    scored = model.transform(spread(test)).select(F.col("is_denied").cast("double").alias("is_denied"), "rawPrediction", "prediction").persist()
    y, p = F.col("is_denied") == 1, F.col("prediction") == 1
    try:
        auc = BinaryClassificationEvaluator(labelCol="is_denied", metricName="areaUnderROC").evaluate(scored)
        counts = scored.agg(
            F.count_if(y & p).alias("true_positive"), F.count_if(~y & p).alias("false_positive"),
            F.count_if(~y & ~p).alias("true_negative"), F.count_if(y & ~p).alias("false_negative"),
        )
        out = test.sparkSession.createDataFrame(counts.collect(), counts.schema)  # four numbers
    finally:
        scored.unpersist()
    c = F.col
    n = c("true_positive") + c("false_positive") + c("true_negative") + c("false_negative")
    out = out.withColumns(
        {
            "accuracy": ratio(c("true_positive") + c("true_negative"), n, 6, 1),
            "precision": ratio(c("true_positive"), c("true_positive") + c("false_positive"), 6, 1),
            "recall": ratio(c("true_positive"), c("true_positive") + c("false_negative"), 6, 1),
            "test_size": n,
        }
    )
    f1 = ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"), 6, 1)
    return out.withColumns({"f1_score": f1, "auc_roc": F.lit(float(auc))})


def with_folds(frame: DataFrame, folds: int = 5, seed: int = 7) -> DataFrame:
    """Add ``fold``, by a hash of the claim id cut at each label's own quantiles: every fold has its share of denied claims."""
    place = F.pmod(F.xxhash64("tran_id", F.lit(seed)), F.lit(1 << 31))

    def cuts(label: int) -> Column:
        own = frame.filter(F.col("is_denied") == label).select(place.alias("place"))
        found = exact_quantiles(own, "place", [k / folds for k in range(1, folds)])
        return found.agg(F.collect_list("value")).scalar()  # one number a fold

    cut = F.when(F.col("is_denied") == 1, cuts(1)).otherwise(cuts(0))
    return frame.withColumns({"_cuts": cut, "_place": place}).withColumn("fold", F.size(F.filter("_cuts", lambda x: F.col("_place") > x)).cast("int")).drop("_cuts", "_place")


def cross_validate(frame: DataFrame, folds: int = 5, with_error: bool = True, **forest) -> list[float]:
    """Mean F1 of the denied class over folds that are stratified by label."""
    rows = learning_rows(with_folds(frame, folds), "fold")
    judge = MulticlassClassificationEvaluator(labelCol="is_denied", metricName="fMeasureByLabel", metricLabel=1.0)
    try:
        if rows.select("fold").distinct().count() < folds:
            raise ValueError("a fold has no row")
        rows = rows.withColumn("is_denied", F.col("is_denied").cast("double"))
        found = [judge.evaluate(fitted(rows.filter(F.col("fold") != k), with_error, **forest).transform(rows.filter(F.col("fold") == k))) for k in range(folds)]
    finally:
        rows.unpersist()
    return [fmean(found), pstdev(found)]


def importances(model: PipelineModel, frame: DataFrame, names: Sequence[str]) -> DataFrame:
    weights = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    return frame.sparkSession.createDataFrame(list(zip(names, weights)), "feature string, importance double")


def score(frame: DataFrame, model: PipelineModel) -> DataFrame:
    """Risk score, level, confidence and the rule-based reasons per claim."""
    both = vector_to_array("probability")
    risk = F.get(both, F.lit(1))
    c = F.col

    def reason(name: str, impact: str):
        return F.struct(F.lit(name).alias("factor"), F.lit(impact).alias("impact"))

    found = F.array_compact(F.array(
        F.when(c("high_risk_error") == 1, reason("High Risk Error Code", "high")),
        F.when((c("claim_amount") > 0) & (c("claim_amount") < 3500), reason("Low Claim Amount", "medium")),
        F.when((c("rw") > 0) & (c("rw") < 0.5), reason("Low Relative Weight", "low")),
    ))
    fallback = F.array(reason("Pattern Match", "medium"))
    scored = model.transform(spread(frame).withColumn("weight", F.lit(1.0))).withColumn("_p", risk).withColumn("confidence", F.round(F.array_max(both), 4))
    level = F.when(c("_p") >= 0.7, "high").when(c("_p") >= 0.4, "medium").otherwise("low")
    return scored.select(
        "tran_id", "hn", "service_type", "drg", "main_fund", "claim_amount", F.round("_p", 4).alias("risk_score"), level.alias("risk_level"),
        "confidence", F.when((F.size(found) == 0) & (c("_p") > 0.5), fallback).otherwise(found).alias("factors"),
    )


def high_risk(claims: DataFrame, model: PipelineModel, looked_at: int | None = None, threshold: float = 0.3, k: int = 20) -> DataFrame:
    """The ``k`` riskiest of all error-free claims, or of the ``looked_at`` largest."""
    clean = claims.filter((F.col("claim_drg") > 0) & ~is_error(exclude=("0",)))
    if looked_at is not None:
        clean = clean.orderBy(F.desc("claim_drg"), "tran_id").limit(looked_at)
    # The threshold comes last: in front of the order it would be pushed down to the features and every claim be scored twice.
    return score(training_frame(clean), model).orderBy(F.desc("risk_score"), "tran_id").limit(k).filter(F.col("risk_score") >= threshold)


def save(model: PipelineModel, path: str, metrics: DataFrame, importance: DataFrame) -> None:
    """The fitted pipeline with its metrics and importances beside it."""
    model.write().save(f"{path}/model")
    metrics.coalesce(1).write.json(f"{path}/metrics")
    importance.coalesce(1).write.json(f"{path}/importances")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


__all__ = ["training_frame", "train", "metrics", "cross_validate", "score", "high_risk", "save", "load", "split"]
