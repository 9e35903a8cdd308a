"""The registered queries of the learning jobs and their DuckDB SQL.

Outputs are rounded so that the order of floating-point sums doesn't show, to nine digits where inputs
end at the seventh.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.functions import activations as act
from loomgrad.functions import metrics
from loomgrad.functions.kernels import glorot_layers, logistic
from loomgrad.functions.vectors import linear_output
from loomgrad.operators.models import BasicNeuralNetwork, DeepNeuralNetwork, LinearRegression, LogisticBinaryClassifier, NetworkOptions
from loomgrad.operators.ranking import rank_in_groups
from loomgrad.operators.scaling import Scaler, training_statistics_per_fold
from loomgrad.operators.splits import order_key, stratified_kfold, stratified_split, test_of, train_of, train_test_split, training_views
from loomgrad.operators.training import (
    BatchGradientDescent,
    GradientDescentOptions,
    MiniBatchGradientDescent,
    MiniBatchOptions,
    Parameters,
    StochasticGradientDescent,
    StochasticOptions,
    Trained,
)
from loomgrad.operators.validate import class_profile, classify, drop_feature, table_facts
from loomgrad.plans import crossval
from loomgrad.plans.datasets import EVENT_FLAG_SQL, ORDER_VALUE_SQL, doc_label, doc_label_sql, event_flag, order_value, vec_label, vec_label_sql
from loomgrad.plans.pipelines import BinaryClassificationPipeline, RegressionPipeline, score_binary_model
from loomgrad.session import ensure_checkpoint_dir, materialise, settled
from loomgrad.sources.tables import classification_output, read_labelled_csv, regression_output
from loomgrad.streaming.scoring import score_stream, write_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _columns(df: DataFrame, n: int, digits: int = 9, extra: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.select(*extra, *[F.round(F.col("features")[j], digits).alias(f"x{j}") for j in range(n)])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, scale, train and evaluate a binary pipeline."""
    split = train_test_split(event_flag(spark, sf_dir)).persist()
    pipeline = BinaryClassificationPipeline(optimiser=BatchGradientDescent(GradientDescentOptions(0.1, 20)))
    pipeline.fit(split.filter("split = 'train'"))
    return pipeline.evaluate(split.filter("split = 'test'"))


# --- assembling and validating ----------------------------------------------------------------


@query(f"SELECT id, {', '.join(f'round(x{j}, 9) AS x{j}' for j in range(4))}, round(target, 9) AS target FROM ({ORDER_VALUE_SQL})")
def p1_assemble(spark, sf_dir):
    return _columns(order_value(spark, sf_dir).withColumn("target", F.round("target", 9)), 4, extra=("id", "target"))


@query(f"SELECT id, round(x1, 9) AS x0, round(x2, 9) AS x1, round(x3, 9) AS x2 FROM ({ORDER_VALUE_SQL})")
def p2_drop_feature(spark, sf_dir):
    return _columns(drop_feature(order_value(spark, sf_dir), 0), 3)


@query(
    f"""SELECT count(*) AS n_rows, 3 AS least_features, 3 AS most_features,
    count(*) FILTER (NOT (isfinite(x0) AND isfinite(x1) AND isfinite(x2))) AS bad_features,
    count(*) FILTER (NOT isfinite(target)) AS bad_targets, count(*) FILTER (target NOT IN (0, 1)) AS not_binary FROM ({EVENT_FLAG_SQL})"""
)
def p3_p4_table_facts(spark, sf_dir):
    return table_facts(event_flag(spark, sf_dir))


@query(
    f"""SELECT n_rows, positives, round(positives / n_rows, 6) AS positive_rate, round(1 - positives / n_rows, 6) AS majority_accuracy
    FROM (SELECT count(*) AS n_rows, count(*) FILTER (target >= 0.5) AS positives FROM ({EVENT_FLAG_SQL}))"""
)
def p5_class_profile(spark, sf_dir):
    return _rounded(class_profile(event_flag(spark, sf_dir)))


#: A fixed linear model of event_flag, for queries that check scoring and not training.
EVENT_MODEL = Parameters((0.8, -1.2, 0.5), -0.4)
EVENT_Z = "(-0.4 + 0.8 * x0 - 1.2 * x1 + 0.5 * x2)"
EVENT_P = f"(CASE WHEN {EVENT_Z} >= 0 THEN 1 / (1 + exp(-{EVENT_Z})) ELSE exp({EVENT_Z}) / (1 + exp({EVENT_Z})) END)"
EVENT_SCORED_SQL = f"SELECT *, {EVENT_P} AS probability FROM ({EVENT_FLAG_SQL})"


def _event_scored(spark, sf_dir) -> DataFrame:
    model = LogisticBinaryClassifier()
    model.trained = Trained(EVENT_MODEL)
    return model.predict(event_flag(spark, sf_dir))


@query(f"SELECT id, round(probability, 6) AS probability, probability >= 0.45 AS predicted FROM ({EVENT_SCORED_SQL})")
def p6_p7_decision(spark, sf_dir):
    scored = _event_scored(spark, sf_dir)
    return scored.select("id", F.round("probability", 6).alias("probability"), classify(F.col("probability"), 0.45).alias("predicted"))


# --- splits and folds -------------------------------------------------------------------------


def _order(seed: int = 42, epoch: int | None = None) -> str:
    return f"md5(id || ':{seed}{'' if epoch is None else f':{epoch}'}'), id"


SPLIT_SQL = "CASE WHEN row_number() OVER (ORDER BY {order}) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split".format(
    order=_order()
)


def fold_sql(rows: str) -> str:
    return f"""
SELECT d.*, ((lower + row_number() OVER (PARTITION BY d.target ORDER BY {_order()}) - 1) % 5)::INT AS fold
FROM ({rows}) d JOIN (SELECT target AS t, coalesce(sum(n) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lower
  FROM (SELECT target, count(*) AS n FROM ({rows}) GROUP BY 1)) s ON s.t = d.target"""


FOLD_SQL = fold_sql(EVENT_FLAG_SQL)


@query(f"SELECT id, {SPLIT_SQL} FROM ({ORDER_VALUE_SQL})")
def d1_random_split(spark, sf_dir):
    return train_test_split(order_value(spark, sf_dir)).select("id", "split")


@query(
    f"""SELECT id, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY {_order()}) <= floor(count(*) OVER (PARTITION BY target) * 0.8::DOUBLE)
    THEN 'train' ELSE 'test' END AS split FROM ({EVENT_FLAG_SQL})"""
)
def d2_stratified_split(spark, sf_dir):
    return stratified_split(event_flag(spark, sf_dir)).select("id", "target", "split")


@query(f"SELECT id, target, fold FROM ({FOLD_SQL})")
def d3_stratified_kfold(spark, sf_dir):
    return stratified_kfold(event_flag(spark, sf_dir)).select("id", "target", "fold")


@query(
    f"""WITH f AS ({FOLD_SQL})
    SELECT e::INT AS eval_fold, target, count(*) FILTER (fold <> e) AS train_rows, count(*) FILTER (fold = e) AS test_rows
    FROM f, range(5) r(e) GROUP BY 1, 2"""
)
def d4_fold_views(spark, sf_dir):
    folded = stratified_kfold(event_flag(spark, sf_dir))
    train = training_views(folded, 5).groupBy("eval_fold", "target").agg(F.count(F.lit(1)).alias("train_rows"))
    test = folded.groupBy(F.col("fold").alias("eval_fold"), "target").agg(F.count(F.lit(1)).alias("test_rows"))
    return train.join(test, ["eval_fold", "target"])


@query(f"SELECT id, row_number() OVER (ORDER BY {_order(42, 3)}) - 1 AS place FROM ({EVENT_FLAG_SQL})")
def d5_epoch_order(spark, sf_dir):
    keyed = event_flag(spark, sf_dir).select("id", order_key(42, 3).alias("k"))
    return rank_in_groups(keyed, [], F.substring("k", 1, 3), [F.col("k"), F.col("id")], "place").select("id", "place")


# --- scaling ----------------------------------------------------------------------------------


def _scaling_sql(formula: str) -> str:
    """``formula`` of x, lo, hi, mean, sd, top, q1, q2, q3 for each feature."""
    parts = []
    for j in range(4):
        x = f"x{j}"
        named = formula
        for name, sql in (
            ("{x}", x),
            ("{lo}", f"min({x}) OVER ()"),
            ("{hi}", f"max({x}) OVER ()"),
            ("{mean}", f"avg({x}) OVER ()"),
            ("{sd}", f"stddev_pop({x}) OVER ()"),
            ("{top}", f"max(abs({x})) OVER ()"),
            *((f"{{q{i}}}", f"quantile_cont({x}, {i / 4}) OVER ()") for i in (1, 2, 3)),
        ):
            named = named.replace(name, sql)
        parts.append(f"round({named}, 9) AS {x}")
    return f"SELECT id, {', '.join(parts)} FROM ({ORDER_VALUE_SQL})"


def _scaled(spark, sf_dir, scaler: Scaler) -> DataFrame:
    data = order_value(spark, sf_dir)
    return _columns(scaler.fit(data).transform(data), 4)


@query(_scaling_sql("-1 + ({x} - {lo}) * 2 / ({hi} - {lo})"))
def f1_min_max(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("min_max", -1.0, 1.0))


@query(_scaling_sql("({x} - {mean}) / ({hi} - {lo})"))
def f2_mean_normalisation(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("mean"))


@query(_scaling_sql("({x} - {mean}) / {sd}"))
def f3_z_score(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("z_score"))


@query(_scaling_sql("{x} / {top}"))
def f4_max_abs(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("max_abs"))


@query(_scaling_sql("({x} - {q2}) / ({q3} - {q1})"))
def f5_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("robust"))


@query(_scaling_sql("({x} - {q2}) / ({q3} - {q1})"))
def f5_h3_robust_distributed(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("robust", percentiles="distributed"))


@query(_scaling_sql("{x}"))
def f6_no_scaling(spark, sf_dir):
    return _scaled(spark, sf_dir, Scaler("none"))


@query(
    f"""WITH f AS ({FOLD_SQL})
    SELECT e::INT AS eval_fold, count(*) AS n, {', '.join(f'round(avg(x{j}), 11) AS mean{j}, round(stddev_pop(x{j}), 11) AS sd{j}, round(min(x{j}), 11) AS low{j}, round(max(x{j}), 11) AS high{j}' for j in range(3))}
    FROM f, range(5) r(e) WHERE fold <> e GROUP BY 1"""
)
def h2_fold_statistics(spark, sf_dir):
    found = training_statistics_per_fold(stratified_kfold(event_flag(spark, sf_dir)), 3)
    parts = []
    for j in range(3):
        parts += [
            F.round(F.col("means")[j], 11).alias(f"mean{j}"),
            F.round(F.sqrt(F.col("variances")[j]), 11).alias(f"sd{j}"),
            F.round(F.col("lows")[j], 11).alias(f"low{j}"),
            F.round(F.col("highs")[j], 11).alias(f"high{j}"),
        ]
    return found.select("eval_fold", "n", *parts)


# --- scalar functions -------------------------------------------------------------------------

Z_SQL = "SELECT event_id AS id, (value - 50) / 25 AS z, event_type FROM events"


@query(
    f"""WITH d AS ({Z_SQL}), a AS (SELECT *, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS s,
      CASE WHEN z > 0 THEN z ELSE exp(z) - 1 END AS e FROM d)
    SELECT id, round(s, 6) AS sigmoid, round(s * (1 - s), 6) AS sigmoid_d, round(tanh(z), 6) AS tanh, round(1 - tanh(z) * tanh(z), 6) AS tanh_d,
      round(greatest(0, z), 6) AS relu, (z > 0)::INT::DOUBLE AS relu_d, round(CASE WHEN z > 0 THEN z ELSE 0.01 * z END, 6) AS leaky,
      CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS leaky_d, round(CASE WHEN z > 0 THEN z ELSE 0.25 * z END, 6) AS prelu,
      CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS prelu_d, round(e, 6) AS elu,
      round(CASE WHEN z > 0 THEN 1 ELSE e + 1 END, 6) AS elu_d FROM a"""
)
def m1_m6_activations(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), ((F.col("value") - 50) / 25).alias("z"))
    z = F.col("z")
    found = d.select(
        "id",
        act.sigmoid(z).alias("sigmoid"),
        act.sigmoid_derivative(act.sigmoid(z)).alias("sigmoid_d"),
        act.tanh(z).alias("tanh"),
        act.tanh_derivative(act.tanh(z)).alias("tanh_d"),
        act.relu(z).alias("relu"),
        act.relu_derivative(z).alias("relu_d"),
        act.leaky_relu(z).alias("leaky"),
        act.leaky_relu_derivative(z).alias("leaky_d"),
        act.prelu(z, 0.25).alias("prelu"),
        act.prelu_derivative(z, 0.25).alias("prelu_d"),
        act.elu(z).alias("elu"),
        act.elu_derivative(z, act.elu(z)).alias("elu_d"),
    )
    return _rounded(found)


@query(
    f"SELECT id, round(greatest(z, 0) - z * (event_type = 'error')::INT + ln(1 + exp(-abs(z))), 6) AS loss FROM ({Z_SQL})"
)
def m7_bce_from_logit(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    y = (F.col("event_type") == "error").cast("double")
    return d.select(F.col("event_id").alias("id"), F.round(act.bce_from_logit((F.col("value") - 50) / 25, y), 6).alias("loss"))


@query(f"SELECT id, round(0.25 + {' + '.join(f'x{j} * {(j % 7 - 3) / 4}' for j in range(64))}, 6) AS z FROM ({vec_label_sql(64)})")
def m8_linear_output(spark, sf_dir):
    weights = [(j % 7 - 3) / 4 for j in range(64)]
    return vec_label(spark, sf_dir).select("id", F.round(linear_output(F.col("features"), weights, 0.25), 6).alias("z"))


# --- metrics ----------------------------------------------------------------------------------

REGRESSION_METRICS_SQL = """
round(avg((p - t) ** 2), 6) AS mse, round(sqrt(avg((p - t) ** 2)), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae,
round(CASE WHEN min(t) = max(t) THEN 0 ELSE 1 - sum((p - t) ** 2) / (var_pop(t) * count(*)) END, 6) AS r_squared,
round(avg((abs(p - t) <= 0.1::DOUBLE * greatest(abs(t), 1))::INT), 6) AS within_tolerance_ratio"""
BINARY_METRICS_SQL = """
round(avg(-(t * ln(q) + (1 - t) * ln(1 - q))), 6) AS binary_cross_entropy, round(avg((hit = yes)::INT), 6) AS accuracy,
round(coalesce(count(*) FILTER (hit AND yes) / nullif(count(*) FILTER (hit), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (hit AND yes) / nullif(count(*) FILTER (yes), 0), 0), 6) AS recall,
round(coalesce(2 * count(*) FILTER (hit AND yes) / nullif(count(*) FILTER (hit) + count(*) FILTER (yes), 0), 0), 6) AS f1_score"""


def _binary_rows(scored: str, threshold: float = 0.5) -> str:
    return f"SELECT *, target AS t, greatest(1e-12, least(1 - 1e-12, probability)) AS q, probability >= {threshold}::DOUBLE AS hit, target >= 0.5 AS yes FROM ({scored})"


@query(f"SELECT (id % 7)::INT AS part, {REGRESSION_METRICS_SQL} FROM (SELECT id, x1 AS p, target AS t FROM ({ORDER_VALUE_SQL})) GROUP BY 1")
def k1_k5_regression_metrics(spark, sf_dir):
    rows = order_value(spark, sf_dir).select((F.col("id") % 7).cast("int").alias("part"), F.col("features")[1].alias("prediction"), "target")
    return _rounded(metrics.regression_metrics(rows, group_cols=("part",)))


@query(f"SELECT (id % 7)::INT AS part, {BINARY_METRICS_SQL} FROM ({_binary_rows(EVENT_SCORED_SQL, 0.45)}) GROUP BY 1")
def k6_k7_binary_metrics(spark, sf_dir):
    rows = _event_scored(spark, sf_dir).withColumn("part", (F.col("id") % 7).cast("int"))
    return _rounded(metrics.binary_metrics(rows, threshold=0.45, group_cols=("part",)))


@query(
    f"""SELECT 'fixed' AS model, count(*) AS folds, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std' for m in metrics.METRIC_COLUMNS)}
    FROM (SELECT fold, {BINARY_METRICS_SQL.replace('round(', '(').replace(', 6)', ')')} FROM ({_binary_rows(f"SELECT *, {EVENT_P} AS probability FROM ({FOLD_SQL})", 0.45)}) GROUP BY 1)"""
)
def k8_fold_summary(spark, sf_dir):
    model = LogisticBinaryClassifier()
    model.trained = Trained(EVENT_MODEL)
    scored = model.predict(stratified_kfold(event_flag(spark, sf_dir)))
    per_fold = metrics.binary_metrics(scored, threshold=0.45, group_cols=("fold",)).withColumn("model", F.lit("fixed"))
    return _rounded(metrics.fold_summary(per_fold))


# --- sources, sinks, streams ------------------------------------------------------------------

ORDER_MODEL = Parameters((0.2, 0.9, -0.1, 0.3), 0.5)


def _order_scored(spark, sf_dir) -> DataFrame:
    model = LinearRegression()
    model.trained = Trained(ORDER_MODEL)
    return model.predict(order_value(spark, sf_dir))


def _shared_path(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT round(target, 9) AS target, {', '.join(f'round(x{j}, 9) AS x{j}' for j in range(4))} FROM ({ORDER_VALUE_SQL})")
def s1_labelled_csv(spark, sf_dir):
    """Writes the learning table as CSV and reads it with the strict reader."""
    path = _shared_path(spark, "labelled-csv")
    order_value(spark, sf_dir).select(*[F.col("features")[j].alias(f"x{j}") for j in range(4)], "target").write.option("header", True).csv(path)
    return _columns(read_labelled_csv(spark, path).withColumn("target", F.round("target", 9)), 4, extra=("target",))


@query(
    f"""SELECT round(target, 9) AS expected, round(p, 9) AS predicted, round(p - target, 9) AS error
    FROM (SELECT *, 0.5 + 0.2 * x0 + 0.9 * x1 - 0.1 * x2 + 0.3 * x3 AS p FROM ({ORDER_VALUE_SQL}))"""
)
def s2_regression_output(spark, sf_dir):
    return _rounded(regression_output(_order_scored(spark, sf_dir)), 9)


@query(
    f"""SELECT (target >= 0.45)::INT AS expected, round(probability, 6) AS probability, (probability >= 0.45)::INT AS predicted,
    ((target >= 0.45) = (probability >= 0.45))::INT AS correct FROM ({EVENT_SCORED_SQL})"""
)
def s3_classification_output(spark, sf_dir):
    return _rounded(classification_output(_event_scored(spark, sf_dir), 0.45))


@query(f"SELECT event_id AS id, round(probability, 6) AS probability FROM (SELECT event_id, {EVENT_P} AS probability FROM (SELECT *, value / 100 AS x0, hour(ts)::DOUBLE / 24 AS x1, (user_id % 10)::DOUBLE / 10 AS x2 FROM events))")
def l3_stream_scoring(spark, sf_dir):
    """Scores the events table as a stream, then reads what the stream wrote."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").option("recursiveFileLookup", "true").parquet(sf_dir)
    features = F.array(F.col("value") / 100, F.hour("ts") / 24, (F.col("user_id") % 10) / 10)
    rows = stream.select(F.col("event_id").alias("id"), features.alias("features"))
    model = LogisticBinaryClassifier()
    model.trained = Trained(EVENT_MODEL)
    out = _shared_path(spark, "scores")
    write_scores(score_stream(rows, model).select("id", "probability"), out, f"{out}-state").awaitTermination()
    return spark.read.schema("id long, probability double").parquet(out).select("id", F.round("probability", 6).alias("probability"))


# --- training ---------------------------------------------------------------------------------


def _dot(a: list[str], b: list[str]) -> str:
    return " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True))


def linear_descent_sql(rows: str, d: int, lr: float, epochs: int, l2: float = 0.0, bias_too: bool = False) -> str:
    """CTEs (first one recursive) that end in ``descent(epoch, w0.., b, cost)`` from the sums of ``rows``."""
    z = [f"x{j}" for j in range(d)] + ["1"]
    w = [f"w{j}" for j in range(d)] + ["b"]
    sums = [f"sum({z[i]} * {z[j]})::DOUBLE AS g{i}_{j}" for i in range(d + 1) for j in range(i, d + 1)]
    sums += [f"sum({z[i]} * target)::DOUBLE AS c{i}" for i in range(d + 1)] + ["sum(target * target) AS yy", "count(*)::DOUBLE AS n"]
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    residual = [f"({_dot([g(i, j) for j in range(d + 1)], w)} - c{i})" for i in range(d + 1)]
    quadratic = " + ".join(f"{w[i]} * ({_dot([g(i, j) for j in range(d + 1)], w)})" for i in range(d + 1))
    update = [f"{w[i]} - {lr} * ({residual[i]} / n{f' + {l2} / n * {w[i]}' if l2 and (i < d or bias_too) else ''}) AS {w[i]}" for i in range(d + 1)]
    zeros = ", ".join(f"0.0::DOUBLE AS {x}" for x in w)
    return f"""sums AS MATERIALIZED (SELECT {', '.join(sums)} FROM ({rows})),
    descent AS (SELECT 0 AS epoch, {zeros} UNION ALL SELECT epoch + 1, {', '.join(update)} FROM descent, sums WHERE epoch < {epochs}),
    traced AS (SELECT epoch, {', '.join(w)}, ({quadratic} - 2 * ({_dot([f'c{i}' for i in range(d + 1)], w)}) + yy) / n AS cost FROM descent, sums)"""


@query(f"WITH RECURSIVE {linear_descent_sql(ORDER_VALUE_SQL, 4, 0.05, 50, 3.0)} SELECT epoch::INT AS epoch, round(cost, 6) AS cost FROM traced WHERE epoch < 50")
def t1_t4_batch_linear_trace(spark, sf_dir):
    options = GradientDescentOptions(0.05, 50, l2=3.0)
    return _rounded(BatchGradientDescent(options).optimise(order_value(spark, sf_dir), Parameters.zeros(4)).trace(spark))


def logistic_descent_sql(rows: str, d: int, lr: float, epochs: int) -> str:
    """CTEs that end in ``e<epochs>(w0.., b, cost of the epoch before)``."""
    w = [f"w{j}" for j in range(d)]
    z = "(" + " + ".join(["b"] + [f"w{j} * x{j}" for j in range(d)]) + ")"
    p = f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-{z})) ELSE exp({z}) / (1 + exp({z})) END)"
    out = [f"training AS MATERIALIZED ({rows})", f"e0 AS (SELECT {', '.join(f'0.0::DOUBLE AS {x}' for x in [*w, 'b'])}, 0.0::DOUBLE AS cost)"]
    for k in range(epochs):
        means = ", ".join([f"avg(({p} - target) * x{j}) AS s{j}" for j in range(d)] + [f"avg({p} - target) AS s", f"avg(({p} - target) ** 2) AS cost"])
        out.append(
            f"e{k + 1} AS MATERIALIZED (SELECT {', '.join([f'w{j} - {lr} * s{j} AS w{j}' for j in range(d)])}, b - {lr} * s AS b, m.cost FROM e{k}, (SELECT {means} FROM training, e{k}) m)"
        )
    return ",\n".join(out)


@query(
    f"WITH {logistic_descent_sql(EVENT_FLAG_SQL, 3, 0.5, 3)} SELECT 0 AS epoch, round(cost, 6) AS cost FROM e1 UNION ALL SELECT 1, round(cost, 6) FROM e2 UNION ALL SELECT 2, round(cost, 6) FROM e3"
)
def t1_t4_batch_logistic_trace(spark, sf_dir):
    trained = BatchGradientDescent(GradientDescentOptions(0.5, 3)).optimise(event_flag(spark, sf_dir), Parameters.zeros(3), logistic)
    return _rounded(trained.trace(spark))


SCALED_WEIGHTS = "round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(b, 6) AS b"


def _weights(spark, trained: Trained) -> DataFrame:
    p = trained.parameters
    return _rounded(spark.createDataFrame([(*p.weights, p.bias)], ", ".join([f"w{j} double" for j in range(len(p.weights))] + ["b double"])))


def sequential_sql(rows: str, batch: int, lr: float, decay: float, epochs: int, l2: float) -> str:
    """Updates per ``batch`` rows of the shuffled order, from sums per batch; one recursion step a batch."""
    w = [f"w{j}" for j in range(4)] + ["b"]
    z = [f"x{j}" for j in range(4)] + ["1"]
    ordered = " UNION ALL ".join(f"SELECT *, {e} AS epoch, row_number() OVER (ORDER BY {_order(42, e)}) - 1 AS place FROM ({rows})" for e in range(epochs))
    sums = [f"avg({z[i]} * {z[j]}) AS g{i}_{j}" for i in range(5) for j in range(i, 5)] + [f"avg({z[i]} * target) AS c{i}" for i in range(5)]
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    update = []
    for i in range(5):
        penalty = f" + {l2} / n * {w[i]}" if l2 and i < 4 else ""
        update.append(f"{w[i]} - ({lr} / (1 + {decay} * epoch)) * ({_dot([g(i, j) for j in range(5)], w)} - c{i}{penalty}) AS {w[i]}")
    zeros = ", ".join(f"0.0::DOUBLE AS {x}" for x in w)
    return f"""WITH RECURSIVE batches AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY epoch, part) AS step, * FROM (
        SELECT epoch, place // {batch} AS part, {', '.join(sums)}, (SELECT count(*)::DOUBLE FROM ({rows})) AS n FROM ({ordered}) GROUP BY ALL)),
    passes AS (SELECT 0::BIGINT AS k, {zeros} UNION ALL SELECT k + 1, {', '.join(update)} FROM passes JOIN batches ON step = k + 1)
    SELECT {SCALED_WEIGHTS} FROM passes ORDER BY k DESC LIMIT 1"""


@query(sequential_sql(doc_label_sql(), 16, 0.02, 0.0, 2, 1.5))
def t2_minibatch(spark, sf_dir):
    optimiser = MiniBatchGradientDescent(options=MiniBatchOptions(0.02, 2, l2=1.5, batch_size=16))
    return _weights(spark, optimiser.optimise(doc_label(spark, sf_dir), Parameters.zeros(4)))


@query(sequential_sql(doc_label_sql(), 1, 0.005, 0.5, 2, 1.5))
def t3_stochastic(spark, sf_dir):
    optimiser = StochasticGradientDescent(options=StochasticOptions(0.005, 2, l2=1.5, decay=0.5))
    return _weights(spark, optimiser.optimise(doc_label(spark, sf_dir), Parameters.zeros(4)))


def _streams_sql(rows: str, streams: int, order: str) -> str:
    """``rows`` with the stream of each row, its place in the stream and the stream's size."""
    stream = f"(('0x' || substr(md5(id || ':stream'), 1, 8))::UBIGINT % {streams})::INT"
    return f"""SELECT *, row_number() OVER (PARTITION BY stream ORDER BY {order}) - 1 AS place, count(*) OVER (PARTITION BY stream) AS stream_rows
    FROM (SELECT *, {stream} AS stream FROM ({rows}))"""


def averaged_sql(rows: str, streams: int, names: list[str], start: list[float], steps: list[str], update: dict[str, str], epochs: int, order) -> str:
    """CTEs (recursive) that end in ``a<epochs>`` with the averaged parameters ``names`` and the epoch's ``cost``.

    ``steps``: expressions in turn, each may use those before; the first ones use the parameters and the row.
    ``update``: parameter -> its value after a row. Streams advance side by side, a row each per recursion.
    """
    out = [f"a0 AS (SELECT {', '.join(f'{v!r}::DOUBLE AS {k}' for k, v in zip(names, start, strict=True))}, 0.0::DOUBLE AS cost)"]
    for e in range(epochs):
        inner = f"SELECT p.stream, p.k, p.squares, r.target, {', '.join(f'p.{n}' for n in names)}, {', '.join(f'r.x{j}' for j in range(4))} FROM p{e} p JOIN r{e} r ON r.stream = p.stream AND r.place = p.k"
        for step in steps:
            inner = f"SELECT *, {step} FROM ({inner})"
        moved = ", ".join(f"{update[n]} AS {n}" for n in names)
        out += [
            f"r{e} AS MATERIALIZED ({_streams_sql(rows, streams, order(e))})",
            f"p{e} AS (SELECT DISTINCT stream, 0::BIGINT AS k, 0.0::DOUBLE AS squares, {', '.join(f'a.{n}' for n in names)} FROM r{e}, a{e} a "
            f"UNION ALL SELECT stream, k + 1, squares + residual * residual, {moved} FROM ({inner}))",
            f"a{e + 1} AS MATERIALIZED (SELECT {', '.join(f'sum({n} * k) / sum(k) AS {n}' for n in names)}, sum(squares) / sum(k) AS cost "
            f"FROM p{e} JOIN (SELECT DISTINCT stream, stream_rows FROM r{e}) USING (stream) WHERE k = stream_rows)",
        ]
    return ",\n".join(out)


def _sigmoid_sql(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END"


SGD_NAMES = ["w0", "w1", "w2", "w3", "b"]
SGD_STEPS = ["b + w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 AS z", f"{_sigmoid_sql('z')} - target AS residual"]
SGD_UPDATE = {n: f"{n} - 0.05 * residual * {x}" for n, x in zip(SGD_NAMES, ["x0", "x1", "x2", "x3", "1"], strict=True)}


@query(
    f"WITH RECURSIVE {averaged_sql(doc_label_sql(), 4, SGD_NAMES, [0.0] * 5, SGD_STEPS, SGD_UPDATE, 2, lambda e: _order(42, e))} SELECT {SCALED_WEIGHTS}, round(a1.cost, 6) AS cost0, round(a2.cost, 6) AS cost1 FROM a2, (SELECT cost FROM a1) a1"
)
def t3_stochastic_averaged(spark, sf_dir):
    """The form for large tables of a hypothesis that isn't linear: streams pass over their rows, then average."""
    optimiser = StochasticGradientDescent(options=StochasticOptions(0.05, 2), streams=4)
    trained = optimiser.optimise(doc_label(spark, sf_dir), Parameters.zeros(4), logistic)
    return _weights(spark, trained).withColumns({f"cost{i}": F.lit(round(c, 6)) for i, c in enumerate(trained.costs)})


@query(
    f"WITH RECURSIVE {averaged_sql(doc_label_sql(), 1, SGD_NAMES, [0.0] * 5, SGD_STEPS, SGD_UPDATE, 2, lambda e: _order(42, e))} SELECT {SCALED_WEIGHTS}, round(a1.cost, 6) AS cost0, round(a2.cost, 6) AS cost1 FROM a2, (SELECT cost FROM a1) a1"
)
def t3_stochastic_logistic(spark, sf_dir):
    """The sequential rule of a logistic model, on any number of rows."""
    trained = StochasticGradientDescent(options=StochasticOptions(0.05, 2)).optimise(doc_label(spark, sf_dir), Parameters.zeros(4), logistic)
    return _weights(spark, trained).withColumns({f"cost{i}": F.lit(round(c, 6)) for i, c in enumerate(trained.costs)})


def minibatch_logistic_sql(rows: str, batch: int, lr: float, epochs: int, l2: float) -> str:
    """One recursion step a batch of the shuffled order; a step averages the gradients of its rows."""
    x = [f"x{j}" for j in range(4)] + ["1"]
    ordered = " UNION ALL ".join(f"SELECT *, {e} AS epoch, row_number() OVER (ORDER BY {_order(42, e)}) - 1 AS place FROM ({rows})" for e in range(epochs))
    update = [f"any_value({n}) - {lr} * (avg(residual * {v}){f' + {l2} / any_value(n) * any_value({n})' if n != 'b' else ''}) AS {n}" for n, v in zip(SGD_NAMES, x, strict=True)]
    inner = "SELECT * FROM passes JOIN batches ON step = k + 1"
    for step in SGD_STEPS:
        inner = f"SELECT *, {step} FROM ({inner})"
    return f"""WITH RECURSIVE batches AS MATERIALIZED (
      SELECT dense_rank() OVER (ORDER BY epoch, place // {batch}) AS step, x0, x1, x2, x3, target, (SELECT count(*)::DOUBLE FROM ({rows})) AS n FROM ({ordered})),
    passes AS (SELECT 0::BIGINT AS k, {', '.join(f'0.0::DOUBLE AS {n}' for n in SGD_NAMES)}
      UNION ALL SELECT any_value(k) + 1, {', '.join(update)} FROM ({inner}) HAVING count(*) > 0)
    SELECT {SCALED_WEIGHTS} FROM passes ORDER BY k DESC LIMIT 1"""


@query(minibatch_logistic_sql(doc_label_sql(), 16, 0.05, 2, 1.5))
def t2_minibatch_logistic(spark, sf_dir):
    """Mini-batches of a logistic model, on any number of rows."""
    optimiser = MiniBatchGradientDescent(options=MiniBatchOptions(0.05, 2, l2=1.5, batch_size=16))
    return _weights(spark, optimiser.optimise(doc_label(spark, sf_dir), Parameters.zeros(4), logistic))


@query(f"WITH RECURSIVE {linear_descent_sql(ORDER_VALUE_SQL, 4, 0.05, 100)} SELECT id, round({_dot([f'x{j}' for j in range(4)], [f'w{j}' for j in range(4)])} + b, 6) AS prediction FROM ({ORDER_VALUE_SQL}), descent WHERE epoch = 100")
def t5_linear_regression(spark, sf_dir):
    data = order_value(spark, sf_dir)
    model = LinearRegression(BatchGradientDescent(GradientDescentOptions(0.05, 100))).fit(data)
    return model.predict(data).select("id", F.round("prediction", 6).alias("prediction"))


@query(
    f"""WITH {logistic_descent_sql(EVENT_FLAG_SQL, 3, 0.5, 4)}
    SELECT id, round(1 / (1 + exp(-(b + w0 * x0 + w1 * x1 + w2 * x2))), 6) AS probability FROM training, e4"""
)
def t6_logistic_classifier(spark, sf_dir):
    data = event_flag(spark, sf_dir)
    model = LogisticBinaryClassifier(BatchGradientDescent(GradientDescentOptions(0.5, 4))).fit(data)
    return model.predict(data).select("id", F.round("probability", 6).alias("probability"))


def _forward_sql(columns: int) -> str:
    """A 4-3-1 network with fixed weights."""
    hidden = []
    for k in range(3):
        terms = " + ".join(f"{((j * 3 + k) % 5 - 2) / 2} * x{j}" for j in range(columns))
        hidden.append(f"1 / (1 + exp(-({terms} + {(k - 1) / 10}))) AS h{k}")
    return f"""SELECT id, round(1 / (1 + exp(-(0.5 * h0 - 1.0 * h1 + 1.5 * h2 - 0.2))), 6) AS probability
    FROM (SELECT id, {', '.join(hidden)} FROM ({doc_label_sql()}))"""


@query(_forward_sql(4))
def t7_t8_network_forward(spark, sf_dir):
    net = DeepNeuralNetwork((4, 3, 1))
    first = np.array([[((j * 3 + k) % 5 - 2) / 2 for k in range(3)] for j in range(4)])
    net.layers = [(first, np.array([-0.1, 0.0, 0.1])), (np.array([[0.5], [-1.0], [1.5]]), np.array([-0.2]))]
    return net.predict(doc_label(spark, sf_dir)).select("id", F.round("probability", 6).alias("probability"))


def network_parts(topology: tuple[int, ...], layers) -> tuple[list[str], list[float], list[str], list[str], str]:
    """(parameters, their start, forward steps, back-propagation steps, output) of a network as SQL expressions."""
    names, start, forward = [], [], []
    below = [f"x{j}" for j in range(topology[0])]
    outputs = [below]
    for k, (w, b) in enumerate(layers):
        here = [f"o{k}_{j}" for j in range(topology[k + 1])]
        for j in range(topology[k + 1]):
            for i in range(topology[k]):
                names.append(f"v{k}_{i}_{j}")
                start.append(float(w[i, j]))
            names.append(f"c{k}_{j}")
            start.append(float(b[j]))
        sums = ", ".join(f"c{k}_{j} + {' + '.join(f'v{k}_{i}_{j} * {o}' for i, o in enumerate(below))} AS z{k}_{j}" for j in range(topology[k + 1]))
        forward += [sums, ", ".join(f"{_sigmoid_sql(f'z{k}_{j}')} AS {o}" for j, o in enumerate(here))]
        outputs.append(here)
        below = here
    steps = [f"{below[0]} - target AS residual", f"residual AS d{len(layers) - 1}_0"]
    for k in range(len(layers) - 1, 0, -1):
        steps.append(
            ", ".join(
                f"({' + '.join(f'v{k}_{i}_{j} * d{k}_{j}' for j in range(topology[k + 1]))}) * {o} * (1 - {o}) AS d{k - 1}_{i}"
                for i, o in enumerate(outputs[k])
            )
        )
    return names, start, forward, steps, below[0]


def network_training_sql(rows: str, topology: tuple[int, ...], layers, lr: float, epochs: int, streams: int) -> str:
    """CTEs that end in ``a<epochs>``: back-propagation by averaged streams from given weights; one stream is the plain rule."""
    names, start, forward, back, _ = network_parts(topology, layers)
    outputs, update = [[f"x{j}" for j in range(topology[0])]] + [[f"o{k}_{j}" for j in range(n)] for k, n in enumerate(topology[1:])], {}
    for k in range(len(layers)):
        for j in range(topology[k + 1]):
            update |= {f"v{k}_{i}_{j}": f"v{k}_{i}_{j} - {lr} * {o} * d{k}_{j}" for i, o in enumerate(outputs[k])}
            update[f"c{k}_{j}"] = f"c{k}_{j} - {lr} * d{k}_{j}"
    return averaged_sql(rows, streams, names, start, [*forward, *back], update, epochs, lambda e: "id")


def network_scored_sql(rows: str, topology: tuple[int, ...], layers, epochs: int) -> str:
    """id, target, probability of ``rows`` by the network that ``a<epochs>`` holds."""
    names, _, forward, _, output = network_parts(topology, layers)
    scored = f"SELECT id, target, {', '.join(f'x{j}' for j in range(topology[0]))}, {', '.join(names)} FROM ({rows}), a{epochs}"
    for step in forward:
        scored = f"SELECT *, {step} FROM ({scored})"
    return f"SELECT id, target, {output} AS probability FROM ({scored})"


def network_sql(rows: str, topology: tuple[int, ...], layers, lr: float, epochs: int, streams: int) -> str:
    """Z-scored rows, back-propagation from given weights, and the probabilities of the rows."""
    z = ", ".join(f"(h.x{j} - s.m{j}) / s.d{j} AS x{j}" for j in range(topology[0]))
    stats = ", ".join(f"avg(x{j}) AS m{j}, stddev_pop(x{j}) AS d{j}" for j in range(topology[0]))
    return f"""WITH RECURSIVE given AS MATERIALIZED ({rows}),
    scaled AS MATERIALIZED (SELECT id, target, {z} FROM given h, (SELECT {stats} FROM given) s),
    {network_training_sql("SELECT * FROM scaled", topology, layers, lr, epochs, streams)}
    SELECT id, target, round(probability, 6) AS probability FROM ({network_scored_sql("SELECT * FROM scaled", topology, layers, epochs)})"""


TWO_LAYERS, DEEP = (4, 8, 1), (4, 5, 3, 1)


def _fitted_on_itself(data: DataFrame, net: DeepNeuralNetwork) -> DataFrame:
    """The network's probabilities of the Z-scored rows that it has learned from. Their table is made once, as Parquet.

    Training amplifies the last bits of means and deviations on large tables, so no order of rows may change them.
    """
    stored = materialise(data)
    facts, scaler = Scaler("z_score", order_free=True).fit_checked(stored)
    scaled = scaler.transform(stored, check=False)
    return net.fit(scaled, validated_features=facts.features).predict(scaled, check=False).select("id", "target", F.round("probability", 6).alias("probability"))


@query(network_sql(doc_label_sql(), TWO_LAYERS, glorot_layers(TWO_LAYERS, 7), 0.05, 2, 4))
def t7_basic_network(spark, sf_dir):
    return _fitted_on_itself(doc_label(spark, sf_dir), BasicNeuralNetwork(8, NetworkOptions(0.05, 2), streams=4, start=glorot_layers(TWO_LAYERS, 7)))


@query(network_sql(doc_label_sql(), DEEP, glorot_layers(DEEP, 42), 0.1, 2, 3))
def t8_deep_network(spark, sf_dir):
    return _fitted_on_itself(doc_label(spark, sf_dir), DeepNeuralNetwork(DEEP, NetworkOptions(0.1, 2), streams=3))


@query(network_sql(doc_label_sql(), TWO_LAYERS, glorot_layers(TWO_LAYERS, 7), 0.05, 2, 1))
def t7_basic_network_sequential(spark, sf_dir):
    """The plain rule: one update per row in the order of ids."""
    return _fitted_on_itself(doc_label(spark, sf_dir), BasicNeuralNetwork(8, NetworkOptions(0.05, 2), start=glorot_layers(TWO_LAYERS, 7)))


@query(network_sql(doc_label_sql(), DEEP, glorot_layers(DEEP, 42), 0.1, 2, 1))
def t8_deep_network_sequential(spark, sf_dir):
    """The plain rule: one update per row in the order of ids."""
    return _fitted_on_itself(doc_label(spark, sf_dir), DeepNeuralNetwork(DEEP, NetworkOptions(0.1, 2)))


@query()
def t8_wide_deep_network(spark, sf_dir):
    """All 64 features of the embeddings."""
    data = vec_label(spark, sf_dir)
    scaled = Scaler("z_score").fit(data).transform(data)
    net = DeepNeuralNetwork((64, 16, 8, 1), NetworkOptions(0.05, 5), streams=32)
    return net.fit(scaled).predict(scaled).select("id", "target", "probability")


# --- pipelines --------------------------------------------------------------------------------


def _split_and_scaled(rows: str, d: int) -> str:
    """CTEs: ``halves`` (rows with split) and ``scaled`` (Z-scored by the training rows)."""
    z = ", ".join(f"(h.x{j} - s.m{j}) / s.d{j} AS x{j}" for j in range(d))
    stats = ", ".join(f"avg(x{j}) AS m{j}, stddev_pop(x{j}) AS d{j}" for j in range(d))
    return f"""halves AS MATERIALIZED (SELECT *, {SPLIT_SQL} FROM ({rows})),
    stats AS MATERIALIZED (SELECT {stats} FROM halves WHERE split = 'train'),
    scaled AS MATERIALIZED (SELECT id, target, split, {z} FROM halves h, stats s)"""


@query(
    f"""WITH RECURSIVE {_split_and_scaled(ORDER_VALUE_SQL, 4)}, {linear_descent_sql("SELECT * FROM scaled WHERE split = 'train'", 4, 0.1, 100)}
    SELECT {REGRESSION_METRICS_SQL} FROM (SELECT target AS t, b + {_dot([f'x{j}' for j in range(4)], [f'w{j}' for j in range(4)])} AS p
      FROM scaled, descent WHERE epoch = 100 AND split = 'test')"""
)
def l1_l2_regression_pipeline(spark, sf_dir):
    split = train_test_split(order_value(spark, sf_dir)).persist()
    pipeline = RegressionPipeline(optimiser=BatchGradientDescent(GradientDescentOptions(0.1, 100)))
    return _evaluated(pipeline, split)


def _evaluated(pipeline, split: DataFrame, **options) -> DataFrame:
    """Metrics on the test rows; the split table is released."""
    pipeline.fit(split.filter("split = 'train'"))
    found = settled(_rounded(pipeline.evaluate(split.filter("split = 'test'"), **options)))
    split.unpersist()
    return found


PIPELINE_P = "1 / (1 + exp(-(b + w0 * x0 + w1 * x1 + w2 * x2)))"


@query(
    f"""WITH {_split_and_scaled(EVENT_FLAG_SQL, 3)}, {logistic_descent_sql("SELECT * FROM scaled WHERE split = 'train'", 3, 0.5, 5)}
    SELECT {BINARY_METRICS_SQL} FROM ({_binary_rows(f"SELECT *, {PIPELINE_P} AS probability FROM scaled, e5 WHERE split = 'test'", 0.3)})"""
)
def l3_l4_binary_pipeline(spark, sf_dir):
    split = train_test_split(event_flag(spark, sf_dir)).persist()
    pipeline = BinaryClassificationPipeline(optimiser=BatchGradientDescent(GradientDescentOptions(0.5, 5)))
    return _evaluated(pipeline, split, threshold=0.3)


@query(f"SELECT {BINARY_METRICS_SQL} FROM ({_binary_rows(EVENT_SCORED_SQL)})")
def l5_score_binary_model(spark, sf_dir):
    model = LogisticBinaryClassifier()
    model.trained = Trained(EVENT_MODEL)
    return _rounded(score_binary_model(model, event_flag(spark, sf_dir)))


@query()
def t9_l6_cross_validation(spark, sf_dir):
    """Three per-row models under one budget, all folds side by side; mean and deviation of their metrics."""
    learners = {
        "logistic": crossval.StochasticLogistic(0.05, 5),
        "two_layer": crossval.SigmoidNetwork((8,), 0.05, 5),
        "deep": crossval.SigmoidNetwork((16, 8), 0.05, 5),
    }
    _, summary = crossval.cross_validate(vec_label(spark, sf_dir), learners, streams=16)
    return summary


def _fold_scaled(d: int, held: int, folds: str = FOLD_SQL) -> str:
    z = ", ".join(f"(f.x{j} - s.m{j}) / s.d{j} AS x{j}" for j in range(d))
    stats = ", ".join(f"avg(x{j}) AS m{j}, stddev_pop(x{j}) AS d{j}" for j in range(d))
    return f"SELECT id, target, fold, {z} FROM ({folds}) f, (SELECT {stats} FROM ({folds}) WHERE fold <> {held}) s"


def compared_models_sql(rows: str, networks: dict[str, tuple[int, ...]], lr: float, epochs: int) -> str:
    """Per-row logistic regression and networks, each trained on the rows of four folds in turn and scored on the fifth."""
    found = []
    for held in range(5):
        scaled, train, test = _fold_scaled(4, held, fold_sql(rows)), f"SELECT * FROM sc WHERE fold <> {held}", f"SELECT * FROM sc WHERE fold = {held}"
        update = {n: f"{n} - {lr} * residual * {x}" for n, x in zip(SGD_NAMES, ["x0", "x1", "x2", "x3", "1"], strict=True)}
        runs = {"logistic": (averaged_sql(train, 1, SGD_NAMES, [0.0] * 5, SGD_STEPS, update, epochs, lambda e: _order(42, e)), None)}
        for name, topology in networks.items():
            layers = glorot_layers(topology, 42)
            runs[name] = (network_training_sql(train, topology, layers, lr, epochs, 1), network_scored_sql(test, topology, layers, epochs))
        for name, (trained, scored) in runs.items():
            scored = scored or f"SELECT id, target, {_sigmoid_sql('(b + w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3)')} AS probability FROM ({test}), a{epochs}"
            whole = BINARY_METRICS_SQL.replace("round(", "(").replace(", 6)", ")")
            found.append(f"(WITH RECURSIVE sc AS MATERIALIZED ({scaled}), {trained} SELECT '{name}' AS model, {whole} FROM ({_binary_rows(scored)}))")
    summary = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in metrics.METRIC_COLUMNS)
    return f"SELECT model, count(*) AS folds, {summary} FROM ({' UNION ALL '.join(found)}) GROUP BY model"


COMPARED = {"two_layer": (4, 4, 1), "deep": (4, 3, 2, 1)}


@query(compared_models_sql(doc_label_sql("toxic"), COMPARED, 0.1, 2))
def t9_compared_models(spark, sf_dir):
    """Three per-row models under one budget, each by its own sequential rule, five folds: what trains in waves."""
    learners = {"logistic": crossval.StochasticLogistic(0.1, 2)}
    learners |= {name: crossval.SigmoidNetwork(topology[1:-1], 0.1, 2) for name, topology in COMPARED.items()}
    _, summary = crossval.cross_validate(doc_label(spark, sf_dir, "toxic"), learners)
    return _rounded(summary)


@query(
    " UNION ALL ".join(
        f"""(WITH sc AS MATERIALIZED ({_fold_scaled(3, held)}), {logistic_descent_sql(f"SELECT * FROM sc WHERE fold <> {held}", 3, 0.5, 3)}
        SELECT 'logistic' AS model, {held}::INT AS eval_fold, {BINARY_METRICS_SQL} FROM ({_binary_rows(f"SELECT *, {PIPELINE_P} AS probability FROM sc, e3 WHERE fold = {held}")}))"""
        for held in range(5)
    )
)
def l6_cross_validated_logistic(spark, sf_dir):
    per_fold, _ = crossval.cross_validate(event_flag(spark, sf_dir), {"logistic": crossval.BatchLogistic(0.5, 3)})
    return _rounded(per_fold)


# --- the caller's own parts -------------------------------------------------------------------


@query(
    f"WITH RECURSIVE {linear_descent_sql(ORDER_VALUE_SQL, 4, 0.05, 8, 3.0, True)} SELECT epoch::INT AS epoch, round(cost, 6) AS cost FROM traced WHERE epoch < 8"
)
def u1_u2_own_hypothesis_and_callback(spark, sf_dir):
    """A hypothesis of the caller, so a job an epoch, with the L2 term on the bias too; rows are what the callback saw."""
    seen: list[tuple[int, float]] = []
    options = GradientDescentOptions(0.05, 8, l2=3.0, regularise_bias=True)
    BatchGradientDescent(options).optimise(
        order_value(spark, sf_dir), Parameters.zeros(4), lambda x, w, b: x @ w + b, lambda epoch, cost: seen.append((epoch, cost))
    )
    return _rounded(spark.createDataFrame(seen, "epoch int, cost double"))


@query(SQL["l6_cross_validated_logistic"])
def u3_model_factory(spark, sf_dir):
    """A fresh model of the caller's for every fold."""
    optimiser = BatchGradientDescent(GradientDescentOptions(0.5, 3))
    per_fold, _ = crossval.cross_validate_distributed(event_flag(spark, sf_dir), {"logistic": lambda: LogisticBinaryClassifier(optimiser)})
    return _rounded(per_fold)


def _own_parts_sql() -> str:
    z = ", ".join(f"(h.x{j} - s.m{j}) / (s.d{j} - s.m{j}) AS x{j}" for j in range(4))
    stats = ", ".join(f"min(x{j}) AS m{j}, max(x{j}) AS d{j}" for j in range(4))
    return f"""WITH RECURSIVE halves AS MATERIALIZED (SELECT *, {SPLIT_SQL} FROM ({ORDER_VALUE_SQL})),
    stats AS MATERIALIZED (SELECT {stats} FROM halves WHERE split = 'train'),
    scaled AS MATERIALIZED (SELECT id, target, split, {z} FROM halves h, stats s),
    {linear_descent_sql("SELECT * FROM scaled WHERE split = 'train'", 4, 0.2, 40, 1.0)}
    SELECT {REGRESSION_METRICS_SQL} FROM (SELECT target AS t, b + {_dot([f'x{j}' for j in range(4)], [f'w{j}' for j in range(4)])} AS p
      FROM scaled, descent WHERE epoch = 40 AND split = 'test')"""


@query(_own_parts_sql())
def u4_swapped_parts(spark, sf_dir):
    """A pipeline with another scaler and another optimiser."""
    split = train_test_split(order_value(spark, sf_dir)).persist()
    pipeline = RegressionPipeline(Scaler("min_max"), BatchGradientDescent(GradientDescentOptions(0.2, 40, l2=1.0)))
    return _evaluated(pipeline, split)


@query(
    f"""WITH f AS ({FOLD_SQL}) SELECT a.n_train, a.n_test, b.target_mean FROM
    (SELECT count(*) FILTER (fold <> 2) AS n_train, count(*) FILTER (fold = 2) AS n_test FROM f) a, (SELECT round(avg(target), 6) AS target_mean FROM f WHERE fold <> 2) b"""
)
def d4_train_and_test_of(spark, sf_dir):
    folded = stratified_kfold(event_flag(spark, sf_dir))
    train = train_of(folded, 2).agg(F.count(F.lit(1)).alias("n_train"), F.round(F.avg("target"), 6).alias("target_mean"), F.lit(1).alias("k"))
    test = test_of(folded, 2).agg(F.count(F.lit(1)).alias("n_test"), F.lit(1).alias("k"))
    return train.join(test, "k").select("n_train", "n_test", "target_mean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



