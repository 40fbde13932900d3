"""Distribution, outliers, forecast and the denial model."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import functions as F

from ..plans import denial_model, outliers
from .base import AS_OF, AS_OF_SQL, YM, _tables, d, hu, n, query, s, txt

_STATS = """SELECT CAST(sum(claim_drg) AS DOUBLE) / count(claim_drg) AS mean, stddev_samp(CAST(claim_drg AS DOUBLE)) AS std, CAST(min(claim_drg) AS DOUBLE) AS min, CAST(max(claim_drg) AS DOUBLE) AS max,
  count(claim_drg) AS n, quantile_cont(CAST(claim_drg AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(claim_drg AS DOUBLE), 0.5) AS median, quantile_cont(CAST(claim_drg AS DOUBLE), 0.75) AS q3 FROM claims_core"""
_FENCE = f"SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM ({_STATS})"


@query("st01_distribution", f"SELECT n, {', '.join(f'round({c}, 4) AS {c}' for c in ('mean', 'median', 'std', 'min', 'max', 'q1', 'q3', 'iqr', 'lower', 'upper'))} FROM ({_FENCE})")
def _(t):
    out = outliers.amount_statistics(t.claims_core)
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q1", "q3", "iqr", "lower", "upper")])


# Claims over 49,000 are stretched fourfold so that the fences cut something.
_SFENCE = _FENCE.replace("FROM claims_core", "FROM sk")
_SK = "WITH sk AS (SELECT * REPLACE (CAST(CASE WHEN claim_drg > 49000 THEN claim_drg * 4 ELSE claim_drg END AS DECIMAL(12,2)) AS claim_drg) FROM claims_core)"


def _stretched(t):
    big = F.when(F.col("claim_drg") > 49000, F.col("claim_drg") * 4).otherwise(F.col("claim_drg"))
    return t.claims_core.withColumn("claim_drg", big.cast("decimal(12,2)"))


_SHOWN = f"tran_id, hn, {txt('dateadm')} AS dateadm, service_type, drg"


@query("st02_high_value", f"""{_SK}, f AS ({_SFENCE}) SELECT {_SHOWN}, {d('claim_drg')} AS claim_drg, {d('reimb_nhso')} AS reimb_nhso, error_code, {hu('(CAST(claim_drg AS DOUBLE) - mean) / std')} AS deviation
  FROM sk, f WHERE sk.claim_drg > upper ORDER BY sk.claim_drg DESC, tran_id LIMIT 20""")
def _(t):
    return outliers.high_value(_stretched(t))


@query("st02_outlier_counts", f"""{_SK}, f AS ({_SFENCE}) SELECT count(*) AS total_claims, {n('coalesce(claim_drg, 0) > upper')} AS high_value_anomalies, {n('coalesce(claim_drg, 0) < greatest(lower, 0)')} AS low_value_anomalies FROM sk, f""")
def _(t):
    return outliers.outlier_counts(_stretched(t))


@query("jn23_variance_outliers", f"""WITH v AS (SELECT *, claim_drg - reimb_nhso AS variance FROM claims_core WHERE claim_drg IS NOT NULL AND reimb_nhso IS NOT NULL)
  SELECT {_SHOWN}, {d('claim_drg')} AS claim_drg, {d('reimb_nhso')} AS reimb_nhso, {d('paid')} AS paid, {d('variance')} AS variance FROM v
  WHERE abs(v.variance) > (SELECT CAST(sum(abs(variance)) AS DOUBLE) / count(*) * 3 FROM v) ORDER BY abs(v.variance) DESC, tran_id LIMIT 20""")
def _(t):
    return outliers.variance_outliers(t.claims_core)


@query("st03_rw_outliers", f"""SELECT tran_id, hn, {txt('dateadm')} AS dateadm, drg, {d('rw')} AS rw, {d('claim_drg')} AS claim_drg FROM (SELECT * REPLACE (CASE WHEN claim_drg > 49000 THEN CAST(rw * 3 AS DECIMAL(7,4)) ELSE rw END AS rw) FROM claims_core) x
  WHERE CAST(x.rw AS DOUBLE) > (SELECT CAST(sum(r) AS DOUBLE) / count(r) + 2 * stddev_samp(CAST(r AS DOUBLE)) FROM (SELECT CASE WHEN claim_drg > 49000 THEN CAST(rw * 3 AS DECIMAL(7,4)) ELSE rw END AS r FROM claims_core))
  ORDER BY x.rw DESC, tran_id LIMIT 15""")
def _(t):
    big = F.when(F.col("claim_drg") > 49000, F.col("rw") * 3).otherwise(F.col("rw"))
    return outliers.rw_outliers(t.claims_core.withColumn("rw", big.cast("decimal(7,4)")))


@query("st04_history", f"SELECT {YM} AS month, count(*) AS claims, {s('claim_drg')} AS claimed, {s('reimb_nhso')} AS reimb, {s('paid')} AS paid FROM claims_core WHERE dateadm >= DATE '1999-07-15' GROUP BY 1")
def _(t):
    return outliers.monthly_history(t.claims_core, AS_OF)


def _forecast(origin: str) -> str:
    return f"""WITH h AS (SELECT {YM} AS month, count(*) AS claims, CAST(sum(reimb_nhso) AS DOUBLE) AS reimb FROM claims_core WHERE dateadm >= {AS_OF_SQL} - INTERVAL 24 MONTH GROUP BY 1),
      six AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT * FROM h ORDER BY month DESC LIMIT 6)),
      b AS (SELECT avg(reimb) AS a, regr_slope(reimb, i) AS sl, avg(claims) AS c, max(month) AS last FROM six),
      f AS (SELECT *, CAST(unnest(range(1, 7)) AS INT) AS k FROM b),
      g AS (SELECT *, strftime(CAST(last || '-01' AS DATE) + to_months(k), '%Y-%m') AS month, strftime(CAST(last || '-01' AS DATE) + to_months(k - 12), '%Y-%m') AS ago FROM f),
      p AS (SELECT g.month, k, c, ({origin} + sl * (6 + k - 1)) * coalesce(h.reimb / a, 1) AS v FROM g LEFT JOIN h ON h.month = ago)
      SELECT month, round(v, 2) AS projected_reimb, CAST(round(c) AS BIGINT) AS projected_claims, CAST(greatest(50, 95 - k * 7) AS INT) AS confidence, round(v * 0.85, 2) AS lower_bound, round(v * 1.15, 2) AS upper_bound FROM p"""


@query("st04_forecast", _forecast("a"))
def _(t):
    return outliers.forecast(t.claims_core, AS_OF)


@query("st04_forecast_intercept", _forecast("a - sl * 2.5"))
def _(t):
    return outliers.forecast(t.claims_core, AS_OF, from_intercept=True)


_DIG = "nullif(regexp_extract(coalesce(error_code, '0'), '(\\d+)', 1), '')"


@query("ml01_training_frame", f"""SELECT tran_id, hn, coalesce(service_type, 'UN') AS service_type, coalesce(error_code, '0') AS error_code, coalesce(drg, 'UNKNOWN') AS drg, coalesce(main_fund, 'UNKNOWN') AS main_fund,
  coalesce(main_inscl, 'UNKNOWN') AS main_inscl, coalesce(ptype, 'UNKNOWN') AS ptype, {d('claim_drg')} AS claim_amount, {d('coalesce(rw, 0)')} AS rw, {d('coalesce(adjrw_nhso, 0)')} AS adjrw,
  CAST(CASE WHEN reimb_nhso > 0 THEN 0 WHEN error_code NOT IN ('', '0') THEN 1 ELSE 0 END AS INT) AS is_denied, coalesce(CAST({_DIG} AS INT), 0) AS error_code_num,
  CAST(contains(coalesce(error_code, '0'), '998') AS INT) AS high_risk_error, round(ln(1 + CAST(claim_drg AS DOUBLE)), 6) AS claim_amount_log FROM claims_core WHERE claims_core.claim_drg > 0""")
def _(t):
    return denial_model.training_frame(t.claims_core).withColumn("claim_amount_log", F.round("claim_amount_log", 6))


# One fitted model per folder serves the queries below; fitting is the costly part.
@lru_cache(maxsize=4)
def _fitted(spark, folder: str, with_error: bool):
    train, _ = denial_model.split(denial_model.training_frame(_tables(spark, folder).claims_core))
    return denial_model.train(train, with_error)


def _model(t, with_error: bool = True):
    return _fitted(t.spark, t.folder, with_error)


def _code(c: str, default: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, '{default}')) - 1 AS DOUBLE) AS {c}_code"


@query("ml02_features", f"""SELECT tran_id, {_code('service_type', 'UN')}, {', '.join(_code(c, 'UNKNOWN') for c in ('drg', 'main_fund', 'main_inscl', 'ptype'))},
  coalesce(CAST({_DIG} AS INT), 0) AS error_code_num, CAST(contains(coalesce(error_code, '0'), '998') AS INT) AS high_risk_error, {d('claim_drg')} AS claim_amount,
  round(ln(1 + CAST(claim_drg AS DOUBLE)), 6) AS claim_amount_log, {d('coalesce(rw, 0)')} AS rw, {d('coalesce(adjrw_nhso, 0)')} AS adjrw FROM claims_core WHERE claims_core.claim_drg > 0""")
def _(t):
    frame = denial_model.training_frame(t.claims_core)
    fitted = denial_model.Pipeline(stages=denial_model.feature_stages()).fit(frame)
    return fitted.transform(frame).select("tran_id", *denial_model.feature_names()).withColumn("claim_amount_log", F.round("claim_amount_log", 6))


@query("ml03_metrics")
def _(t):
    _, test = denial_model.split(denial_model.training_frame(t.claims_core))
    return denial_model.metrics(_model(t), test)


@query("ml03_metrics_leak_free")
def _(t):
    _, test = denial_model.split(denial_model.training_frame(t.claims_core))
    return denial_model.metrics(_model(t, False), test)


_DENIED = "CASE WHEN reimb_nhso > 0 THEN 0 WHEN error_code NOT IN ('', '0') THEN 1 ELSE 0 END"


@query("ml03_confusion", f"""SELECT sum({_DENIED})::BIGINT AS denied, (count(*) - sum({_DENIED}))::BIGINT AS paid, count(*) AS test_size, true AS in_range FROM claims_core WHERE claim_drg > 0""")
def _(t):
    c, out = F.col, denial_model.metrics(_model(t), denial_model.training_frame(t.claims_core))
    scores = [c(k).between(0, 1) for k in ("accuracy", "precision", "recall", "f1_score", "auc_roc")]
    return out.select((c("true_positive") + c("false_negative")).alias("denied"), (c("false_positive") + c("true_negative")).alias("paid"), "test_size", reduce(and_, scores).alias("in_range"))


@query("ml03_folds", f"SELECT {_DENIED} AS is_denied, 5 AS folds, true AS even FROM claims_core WHERE claim_drg > 0 GROUP BY 1")
def _(t):
    """Every label is dealt evenly to the folds."""
    sizes = denial_model.with_folds(denial_model.training_frame(t.claims_core)).groupBy("is_denied", "fold").agg(F.count("*").alias("n"))
    even = (F.max("n") - F.min("n") <= 2).alias("even")
    return sizes.groupBy("is_denied").agg(F.count("*").cast("int").alias("folds"), even)


@query("ml03_cross_validation")
def _(t):
    mean, deviation = denial_model.cross_validate(denial_model.training_frame(t.claims_core), folds=5, trees=20, depth=8)
    return t.spark.createDataFrame([(5, mean, deviation)], "folds int, mean_f1 double, deviation double")


@query("ml04_scores_hold", "SELECT count(*) AS claims, 0::BIGINT AS out_of_range, 0::BIGINT AS wrong_level FROM claims_core WHERE claim_drg > 0")
def _(t):
    out, p = denial_model.score(denial_model.training_frame(t.claims_core), _model(t)), F.col("risk_score")
    level = F.when(p > 0.70005, "high").when(p < 0.39995, "low").when(p.between(0.40005, 0.69995), "medium").otherwise(F.col("risk_level"))
    return out.agg(F.count("*").alias("claims"), F.count_if(~p.between(0, 1)).alias("out_of_range"), F.count_if(level != F.col("risk_level")).alias("wrong_level"))


@query("ml03_importances")
def _(t):
    return denial_model.importances(_model(t), t.claims_core, denial_model.feature_names())


@query("ml04_scores")
def _(t):
    out = denial_model.score(denial_model.training_frame(t.claims_core), _model(t))
    return out.withColumn("factors", F.col("factors.factor"))


@query("ml05_high_risk")
def _(t):
    out = denial_model.high_risk(t.claims_core, _model(t, False), threshold=0.0)
    return out.withColumn("factors", F.col("factors.factor"))


@query("ml06_saved_model")
def _(t):
    from ..session import fresh_path

    frame = denial_model.training_frame(t.claims_core)
    _, test = denial_model.split(frame)
    path = fresh_path(t.spark, "denial-model")
    model = _model(t)
    denial_model.save(model, path, denial_model.metrics(model, test), denial_model.importances(model, frame, denial_model.feature_names()))
    return denial_model.score(test, denial_model.load(path)).groupBy("risk_level").agg(F.count("*").alias("claims"))
