"""Hand-computed cases and invariants of the learning jobs."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrad.functions import kernels, metrics
from loomgrad.operators import chain, merging, models, scaling, splits, training, validate
from loomgrad.operators.ranking import rank_in_groups
from loomgrad.plans import catalog, crossval
from loomgrad.plans.datasets import doc_label
from loomgrad.plans.pipelines import BinaryClassificationPipeline, RegressionPipeline, score_binary_model
from loomgrad.sources import tables
from loomgrad.streaming.scoring import score_stream, write_scores

SCHEMA = "id bigint, features array<double>, target double"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(rows)], SCHEMA)


def line(spark, n=4):
    return table(spark, [((i,), 2 * i + 1) for i in range(1, n + 1)])


# --- validation -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [((), 1.0)],
        [((1.0,), 1.0), ((1.0, 2.0), 1.0)],
        [((float("nan"),), 1.0)],
        [((1.0,), float("inf"))],
    ],
)
def test_unfit_tables_are_refused(spark, rows):
    with pytest.raises(ValueError):
        validate.validate_training_table(table(spark, rows))


def test_nulls_and_other_targets_are_refused(spark):
    with pytest.raises(ValueError):
        validate.validate_training_table(spark.createDataFrame([(1, [None, 1.0], 1.0)], SCHEMA))
    with pytest.raises(ValueError):
        validate.validate_training_table(spark.createDataFrame([(1, [1.0], None)], SCHEMA))
    with pytest.raises(ValueError):
        models.LogisticBinaryClassifier().fit(table(spark, [((1.0,), 2.5)]))
    assert validate.validate_training_table(line(spark)) == validate.TableFacts(4, 1)


@pytest.mark.parametrize("threshold", [0.0, 1.0, -0.1, 1.1, float("nan")])
def test_thresholds_outside_are_refused(spark, threshold):
    with pytest.raises(ValueError):
        validate.classify(F.lit(0.5), threshold)


def test_scoring_refuses_other_rows(spark):
    model = models.LinearRegression(training.BatchGradientDescent(training.GradientDescentOptions(0.05, 10))).fit(line(spark))
    for bad in ([((1.0, 2.0), 0.0)], [((float("nan"),), 0.0)]):
        with pytest.raises(Exception, match="finite features"):
            model.predict(table(spark, bad)).collect()
    with pytest.raises(models.NotFittedError):
        models.LinearRegression().predict(line(spark))


# --- splits -----------------------------------------------------------------------------------


def test_split_sizes_and_repeatability(spark):
    df = table(spark, [((i,), 2 * i) for i in range(10)])
    a = {r["id"]: r["split"] for r in splits.train_test_split(df).collect()}
    assert sorted(a.values()) == ["test"] * 2 + ["train"] * 8
    for n in (1, 7, 64):
        assert a == {r["id"]: r["split"] for r in splits.train_test_split(df.repartition(n)).collect()}
    assert a != {r["id"]: r["split"] for r in splits.train_test_split(df, seed=1).collect()}


@pytest.mark.parametrize("few", [1000, 2])
def test_splits_take_the_first_rows_of_the_order_and_move_none(spark, monkeypatch, few):
    monkeypatch.setattr(splits, "FEW_ROWS", few)
    rows = table(spark, [((i,), i % 3) for i in range(400)])
    key = {i: hashlib.md5(f"{i}:42".encode()).hexdigest() for i in range(400)}
    whole = splits.train_test_split(rows)
    assert {r["id"] for r in whole.filter("split = 'train'").collect()} == set(sorted(key, key=key.get)[:320])
    strata = splits.stratified_split(rows, 0.7)
    want = {i for t in range(3) for i in sorted((i for i in key if i % 3 == t), key=key.get)[: math.floor(sum(i % 3 == t for i in key) * 0.7)]}
    assert {r["id"] for r in strata.filter("split = 'train'").collect()} == want
    for df in (whole, strata):
        assert not any(kind in df._jdf.queryExecution().executedPlan().toString() for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition"))
    monkeypatch.setattr(splits, "STRATA", 2)
    assert {r["id"] for r in splits.stratified_split(rows, 0.7).filter("split = 'train'").collect()} == want


def test_rows_that_share_an_id_stay_together(spark):
    rows = spark.createDataFrame([(i if i < 40 else None if i < 60 else 1000, [1.0], 0.0) for i in range(2000)], SCHEMA)
    for df in (splits.train_test_split(rows), splits.stratified_split(rows)):
        sides = {(r["id"], r["split"]) for r in df.collect()}
        assert len(sides) == 42 and (None, "train") in sides and df.filter("split = 'train'").count() <= 1600


@pytest.mark.parametrize("ratio", [0.0, 1.0, float("nan"), 0.05])
def test_bad_splits_are_refused(spark, ratio):
    with pytest.raises(ValueError):
        splits.train_test_split(table(spark, [((i,), 0) for i in range(10)]), ratio)


def test_stratified_sizes(spark):
    df = table(spark, [((i,), 0 if i < 90 else 1) for i in range(100)])
    counts = {(r["target"], r["split"]): r["count"] for r in splits.stratified_split(df).groupBy("target", "split").count().collect()}
    assert counts == {(0.0, "train"): 72, (0.0, "test"): 18, (1.0, "train"): 8, (1.0, "test"): 2}
    folds = {(r["target"], r["fold"]): r["count"] for r in splits.stratified_kfold(df).groupBy("target", "fold").count().collect()}
    assert folds == {(t, k): n for t, n in ((0.0, 18), (1.0, 2)) for k in range(5)}
    with pytest.raises(ValueError):
        splits.stratified_kfold(df, 11)
    with pytest.raises(ValueError):
        splits.stratified_split(table(spark, [((i,), int(i == 10)) for i in range(11)]))


def test_the_deal_goes_on_across_strata(spark):
    df = table(spark, [((i,), i % 3) for i in range(50)])
    rows = splits.stratified_kfold(df, 7).select("id", "target", "fold", splits.order_key(42).alias("k")).collect()
    dealt = sorted(rows, key=lambda r: (r["target"], r["k"], r["id"]))
    assert [r["fold"] for r in dealt] == [i % 7 for i in range(50)]


def test_rank_equals_row_number_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, None).otherwise(F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    rows = rank_in_groups(df, ["g"], F.substring("k", 1, 2), [F.col("k")], "r").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r["k"]):
        groups.setdefault(r["g"], []).append(r["r"])
    assert all(v == list(range(len(v))) for v in groups.values()) and len(rows) == 5000


# --- scaling ----------------------------------------------------------------------------------


def transformed(spark, kind, train, rows, **options):
    fitted = scaling.Scaler(kind, **options).fit(table(spark, [(x, 0) for x in train]))
    return [r["features"] for r in fitted.transform(table(spark, [(x, 0) for x in rows])).orderBy("id").collect()]


@pytest.mark.parametrize(
    "kind,train,row,expected",
    [
        ("min_max", [(10, 200), (20, 400), (30, 600)], (20, 400), [0.5, 0.5]),
        ("min_max", [(7,), (7,)], (9,), [0.5]),
        ("min_max", [(0,), (10,)], (20,), [2.0]),
        ("mean", [(10,), (20,), (30,)], (10,), [-0.5]),
        ("mean", [(7,), (7,)], (9,), [0.0]),
        ("z_score", [(9,), (10,), (11,)], (1000,), [990 / math.sqrt(2 / 3)]),
        ("z_score", [(7,), (7,)], (9,), [2.0]),
        ("max_abs", [(-10, 5), (2, -20)], (-10, 10), [-1.0, 0.5]),
        ("max_abs", [(0,), (0,)], (3,), [3.0]),
        ("robust", [(1,), (2,), (3,), (4,), (5,)], (4,), [0.5]),
        ("robust", [(7,), (7,)], (9,), [2.0]),
        ("none", [(1,)], (9,), [9.0]),
    ],
)
def test_scalers(spark, kind, train, row, expected):
    assert transformed(spark, kind, train, [row])[0] == pytest.approx(expected)


def test_scaler_options_and_wide_rows(spark):
    with pytest.raises(ValueError):
        scaling.Scaler("min_max", 1.0, 1.0)
    with pytest.raises(ValueError):
        scaling.Scaler("other")
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 100))  # above the unrolled size
    got = np.array(transformed(spark, "z_score", x.tolist(), x.tolist()))
    assert got == pytest.approx((x - x.mean(0)) / x.std(0))


@pytest.mark.parametrize("few", [1000, 3, 0])
def test_selected_percentiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(scaling, "FEW_VALUES", few)  # 0: down to the last bit
    rng = np.random.default_rng(1)
    n = 501
    columns = [rng.normal(size=n), rng.integers(-3, 4, size=n), np.full(n, 3.0), rng.normal(size=n) * 1e-300, rng.choice([-0.0, 0.0, 5e-324, -1e308], size=n)]
    x = np.column_stack(columns)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = scaling.exact_percentiles(table(spark, [(r, 0) for r in x.tolist()]).repartition(5), shares, 5)
    for j in range(5):
        assert found[j] == pytest.approx(np.quantile(x[:, j], shares), abs=0)
    df = table(spark, [(r, 0) for r in x.tolist()])
    built_in = df.agg(*[F.percentile(F.col("features")[j], list(shares)) for j in range(5)]).first()
    assert [list(built_in[j]) for j in range(5)] == [pytest.approx(f) for f in found]


def test_robust_scaling_moves_no_row(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(scaling, "array_sums", lambda rows, *a, sums=scaling.array_sums: plans.append(rows._jdf.queryExecution().toString()) or sums(rows, *a))
    scaling.Scaler("robust").fit(table(spark, [((i, -i), 0) for i in range(50)]))
    assert plans and not any("Exchange" in p for p in plans)


# --- training ---------------------------------------------------------------------------------


def test_batch_descent_finds_the_line_and_its_cost_falls(spark):
    seen = []
    options = training.GradientDescentOptions(0.05, 2000)
    trained = training.BatchGradientDescent(options).optimise(line(spark), training.Parameters.zeros(1), on_epoch=lambda e, c: seen.append((e, c)))
    assert trained.parameters.weights[0] == pytest.approx(2, abs=0.01) and trained.parameters.bias == pytest.approx(1, abs=0.01)
    assert [e for e, _ in seen] == list(range(2000)) and trained.costs[-1] < trained.costs[0] / 2


def test_gram_descent_equals_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(60, 3)), np.array([1.0, -2.0, 0.5])
    y = x @ w + 3 + rng.normal(size=60)
    theta, costs = np.zeros(4), []
    for _ in range(30):
        e = x @ theta[:3] + theta[3] - y
        costs.append(float(e @ e) / 60)
        grad = np.append(x.T @ e, e.sum()) / 60
        grad += 2.0 / 60 * theta
        theta = theta - 0.1 * grad
    options = training.GradientDescentOptions(0.1, 30, l2=2.0, regularise_bias=True)
    df = table(spark, list(zip(x.tolist(), y)))
    for predict in (kernels.linear, lambda a, b, c: a @ b + c):  # by the statistics, and by a job per epoch
        trained = training.BatchGradientDescent(options).optimise(df, training.Parameters.zeros(3), predict)
        assert [*trained.parameters.weights, trained.parameters.bias] == pytest.approx(theta)
        assert trained.costs == pytest.approx(costs)


def test_three_optimisers_agree(spark):
    df = table(spark, [((0.01 * i,), 3 * 0.01 * i + 2) for i in range(200)])
    optimisers = [
        training.BatchGradientDescent(training.GradientDescentOptions(0.3, 400)),
        training.MiniBatchGradientDescent(options=training.MiniBatchOptions(0.2, 25, batch_size=8)),
        training.StochasticGradientDescent(options=training.StochasticOptions(0.1, 10)),
    ]
    for optimiser in optimisers:
        p = optimiser.optimise(df, training.Parameters.zeros(1)).parameters
        assert (p.weights[0], p.bias) == pytest.approx((3, 2), abs=0.1)


def test_one_partition_is_the_sequential_rule(spark):
    rows = [((float(i % 5), float(i % 3)), float(i % 2)) for i in range(40)]
    options = training.StochasticOptions(0.05, 2, l2=0.5, shuffle=False, decay=0.3)
    got = training.StochasticGradientDescent(options=options).optimise(table(spark, rows), training.Parameters.zeros(2), kernels.logistic)
    w, b = np.zeros(2), 0.0
    for epoch in range(2):
        lr = 0.05 / (1 + 0.3 * epoch)
        for x, y in rows:
            e = 1 / (1 + math.exp(-(w @ np.array(x) + b))) - y
            w = w - lr * (e * np.array(x) + 0.5 / 40 * w)
            b -= lr * e
    assert [*got.parameters.weights, got.parameters.bias] == pytest.approx([*w, b])


@pytest.mark.parametrize("batch,shuffle", [(1, True), (1, False), (7, True), (7, False)])
def test_linear_updates_compose_to_the_sequential_rule(spark, batch, shuffle):
    """Ranges of rows in many partitions give what one loop over all rows gives."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(230, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3
    df = table(spark, list(zip(x.tolist(), y)))
    if batch == 1:
        options = training.StochasticOptions(0.05, 3, l2=2.0, regularise_bias=True, shuffle=shuffle, decay=0.3)
        optimiser, rate = training.StochasticGradientDescent(options=options), lambda e: 0.05 / (1 + 0.3 * e)
    else:
        options = training.MiniBatchOptions(0.05, 3, l2=2.0, regularise_bias=True, shuffle=shuffle, batch_size=batch)
        optimiser, rate = training.MiniBatchGradientDescent(options=options), lambda e: 0.05
    w, b, costs = np.zeros(3), 0.0, []
    for epoch in range(3):
        order = sorted(range(230), key=lambda i: (hashlib.md5(f"{i}:42:{epoch}".encode()).hexdigest(), i) if shuffle else i)
        w, b, squares = kernels.batches_pass(x[order], y[order], w, b, kernels.linear, batch, rate(epoch), 2.0 / 230, True)
        costs.append(squares / 230)
    for n in (1, 6):
        got = optimiser.optimise(df.repartition(n), training.Parameters.zeros(3))
        assert [*got.parameters.weights, got.parameters.bias] == pytest.approx([*w, b])
        assert got.costs == pytest.approx(costs)


def test_logistic_streams_are_runs_of_their_own():
    rng = np.random.default_rng(9)
    x, y, w, lengths = rng.normal(size=(40, 3)), (rng.random(40) > 0.5).astype(float), rng.normal(size=3), np.array([9, 17, 14])
    for penalty, bias_too in ((0.0, False), (0.02, False), (0.02, True)):
        total, squares, at = np.zeros(4), 0.0, 0
        for k in lengths.tolist():
            got, bias, s = kernels.batches_pass(x[at : at + k], y[at : at + k], w, 0.3, kernels.logistic, 1, 0.1, penalty, bias_too)
            total, squares, at = total + k * np.append(got, bias), squares + s, at + k
        found = kernels.logistic_streams_pass(x, y, w, 0.3, lengths, 0.1, penalty, bias_too)
        assert found[0] == pytest.approx(total) and found[1] == pytest.approx(squares)


def test_averaged_streams_too_long_are_refused_and_one_stream_is_not(spark, monkeypatch):
    monkeypatch.setattr(training, "STREAM_ROWS", 20)
    df = table(spark, [((i / 50,), i % 2) for i in range(50)])
    sgd = lambda streams: training.StochasticGradientDescent(options=training.StochasticOptions(0.05, 1), streams=streams)
    with pytest.raises(ValueError, match="streams"):
        sgd(2).optimise(df, training.Parameters.zeros(1), kernels.logistic)
    with pytest.raises(ValueError, match="stream"):
        sgd(0).optimise(df, training.Parameters.zeros(1), kernels.logistic)
    assert sgd(3).optimise(df, training.Parameters.zeros(1), kernels.logistic) and sgd(1).optimise(df, training.Parameters.zeros(1), kernels.logistic)


def plain_order(n: int, shuffle: bool, epoch: int) -> list[int]:
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{i}:42:{epoch}".encode()).hexdigest(), i) if shuffle else i)


@pytest.mark.parametrize("batch,shuffle", [(1, True), (1, False), (7, True), (7, False)])
@pytest.mark.parametrize("predict", [kernels.logistic, lambda x, w, b: np.tanh(x @ w + b)])
def test_ranges_that_follow_each_other_are_one_loop(spark, monkeypatch, batch, shuffle, predict):
    """Parameters travel over seven ranges, a batch may cross them, and an Arrow batch holds nine rows."""
    monkeypatch.setattr(chain, "RANGE_ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 3))
    y = (rng.random(260) > 0.4).astype(float)
    df = table(spark, list(zip(x.tolist(), y))).repartition(5)
    if batch == 1:
        options = training.StochasticOptions(0.05, 2, l2=2.0, regularise_bias=True, shuffle=shuffle, decay=0.3)
        optimiser, rate = training.StochasticGradientDescent(options=options), lambda e: 0.05 / (1 + 0.3 * e)
    else:
        options = training.MiniBatchOptions(0.05, 2, l2=2.0, regularise_bias=True, shuffle=shuffle, batch_size=batch)
        optimiser, rate = training.MiniBatchGradientDescent(options=options), lambda e: 0.05
    w, b, costs = np.zeros(3), 0.0, []
    for epoch in range(2):
        order = plain_order(260, shuffle, epoch)
        w, b, squares = kernels.batches_pass(x[order], y[order], w, b, predict, batch, rate(epoch), 2.0 / 260, True)
        costs.append(squares / 260)
    try:
        got = optimiser.optimise(df, training.Parameters.zeros(3), predict)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [*got.parameters.weights, got.parameters.bias] == pytest.approx([*w, b]) and got.costs == pytest.approx(costs)


def test_wide_linear_models_are_exact(spark, monkeypatch):
    """Beyond AFFINE_FEATURES ranges follow each other instead of being composed."""
    monkeypatch.setattr(chain, "RANGE_ROWS", 50)
    rng = np.random.default_rng(18)
    x = rng.normal(size=(120, 250)) / 16
    y = x @ rng.normal(size=250)
    w, b, _ = kernels.batches_pass(x, y, np.zeros(250), 0.0, kernels.linear, 1, 0.05, 0.0, False)
    options = training.StochasticOptions(0.05, 1, shuffle=False)
    got = training.StochasticGradientDescent(options=options).optimise(table(spark, list(zip(x.tolist(), y))).repartition(4), training.Parameters.zeros(250))
    assert [*got.parameters.weights, got.parameters.bias] == pytest.approx([*w, b])


def test_a_network_over_ranges_is_one_loop(spark, monkeypatch):
    monkeypatch.setattr(chain, "RANGE_ROWS", 30)
    rng = np.random.default_rng(19)
    x, y = rng.normal(size=(130, 3)), (rng.random(130) > 0.5).astype(float)
    net = models.DeepNeuralNetwork((3, 4, 2, 1), models.NetworkOptions(0.2, 3)).fit(table(spark, list(zip(x.tolist(), y))).repartition(4))
    layers, costs = kernels.glorot_layers((3, 4, 2, 1), 42), []
    for _ in range(3):
        layers, squares = kernels.network_pass(x, y, layers, 0.2)
        costs.append(squares / 130)
    assert kernels.flatten(net.layers) == pytest.approx(kernels.flatten(layers)) and net.costs == pytest.approx(costs)


def test_models_side_by_side_are_models_of_their_own():
    rng = np.random.default_rng(20)
    x, y, mine = rng.normal(size=(4, 75, 3)), (rng.random(75) > 0.5).astype(float), rng.random((4, 75)) > 0.3
    for topology, lr in (((3, 5, 1), 0.3), ((3, 4, 2, 1), 0.3)):
        start = [kernels.glorot_layers(topology, k) for k in range(4)]
        layers = kernels.stack(start)
        squares = kernels.stacked_network_pass(x, y, mine, layers, lr)
        for k, got in enumerate(kernels.unstack(layers)):
            want, s = kernels.network_pass(x[k, mine[k]], y[mine[k]], start[k], lr)
            assert kernels.flatten(got) == pytest.approx(kernels.flatten(want)) and squares[k] == pytest.approx(s)
    for lr in (0.05, 3.0):  # far from settling at once
        flats = start = rng.normal(size=(4, 4))
        flats = flats.copy()
        squares = kernels.stacked_logistic_pass(x, y, mine, flats, lr)
        for k in range(4):
            w, b, s = kernels.batches_pass(x[k, mine[k]], y[mine[k]], start[k, :3], start[k, 3], kernels.logistic, 1, lr, 0.0, False)
            assert flats[k] == pytest.approx([*w, b], rel=1e-9) and squares[k] == pytest.approx(s)


@pytest.mark.parametrize("range_rows", [1_000_000, 25])
def test_waves_of_models_follow_their_own_rules(spark, monkeypatch, range_rows):
    """Three kinds of models, all folds, over three or more ranges: each equals a plain loop over its training rows."""
    monkeypatch.setattr(chain, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(21)
    x, n = rng.normal(size=(120, 3)), 120
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    folded = splits.stratified_kfold(table(spark, list(zip(x.tolist(), y))), 3).persist()
    fold = np.array([r["fold"] for r in folded.orderBy("id").collect()])
    scales = {k: (x[fold != k].mean(axis=0), x[fold != k].std(axis=0)) for k in range(3)}
    learners = {"logistic": crossval.StochasticLogistic(0.1, 3, decay=0.2), "two": crossval.SigmoidNetwork((4,), 0.2, 2), "deep": crossval.SigmoidNetwork((4, 3), 0.3, 1)}
    got = crossval.train_in_waves(folded, n, scales, learners)
    assert len(got) == 9
    for (name, held), flat in got.items():
        learner, want = learners[name], learners[name].start(3)
        for epoch in range(learner.epochs):
            order = [i for i in (plain_order(n, True, epoch) if name == "logistic" else range(n)) if fold[i] != held]
            z = (x[order] - scales[held][0]) / scales[held][1]
            if name == "logistic":
                w, b, _ = kernels.batches_pass(z, y[order], want[:3], want[3], kernels.logistic, 1, 0.1 / (1 + 0.2 * epoch), 0.0, False)
                want = np.append(w, b)
            else:
                topology = (3, *learner.hidden, 1)
                want = kernels.flatten(kernels.network_pass(z, y[order], kernels.unflatten(want, topology), learner.learning_rate)[0])
        assert flat == pytest.approx(want)
    folded.unpersist()


def test_no_task_of_a_wave_holds_all_models_or_all_rows(spark, monkeypatch):
    seen, work = [], chain._work
    monkeypatch.setattr(chain, "_work", lambda units: seen.append(units) or work(units))
    rows = table(spark, [((i / 90, i % 7), i % 2) for i in range(90)])
    learners = {f"m{k}": crossval.SigmoidNetwork((2,), 0.1, 2) for k in range(3)}
    crossval.cross_validate(rows, learners, 3)
    assert all(len(here) == 1 for units in seen for here in units.values())
    assert max(map(len, seen)) == 3 and {part for units in seen for part in units} == {0, 1, 2}
    assert len(seen) == 2 * 3 + 2  # three models in little more than the steps of one


def test_what_reaches_the_driver_is_bounded(spark):
    """5,000 partitions: sums and affine maps are merged in executors, in order."""
    rows = spark.range(20_000, numPartitions=5000).select("id", F.array(*[F.lit(0.5)] * 3).alias("features"), F.lit(1.0).alias("target"))
    states = merging.merged_states(rows.select("id"), lambda batches: b"".join(b"%d," % i for b in batches for i in b.column(0).to_pylist()), lambda a, b: a + b, 5000)
    assert len(states) <= merging.GROUPS and b"".join(states) == b"".join(b"%d," % i for i in range(20_000))
    few = rows.coalesce(200)
    for parts in (None, 200):
        got = training.summed(few, lambda x, y: np.array([x.sum(), y.sum()]), 2, parts)
        assert got.tolist() == [30_000.0, 20_000.0]


def test_affine_maps_compose():
    rng = np.random.default_rng(22)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=50)
    whole = kernels.affine_pass(x, y, kernels.affine_start(4), 1, 0.1, 0.01, True)
    first, second = (kernels.affine_pass(x[p], y[p], kernels.affine_start(4), 1, 0.1, 0.01, True) for p in (slice(0, 17), slice(17, 50)))
    for a, b in zip(whole, kernels.affine_compose(first, second), strict=True):
        assert a == pytest.approx(b)


def test_averaged_quality_is_near_the_exact_rule(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.5]))))).astype(float)
    df = table(spark, list(zip(x.tolist(), y)))
    losses = []
    for streams in (1, 8):
        options = training.StochasticOptions(0.05, 3)
        p = training.StochasticGradientDescent(options=options, streams=streams).optimise(df, training.Parameters.zeros(3), kernels.logistic).parameters
        q = kernels.logistic(x, np.array(p.weights), p.bias)
        losses.append(float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))))
    assert losses[1] == pytest.approx(losses[0], rel=0.03)


@pytest.mark.parametrize("link,predict", [("linear", kernels.linear), ("logistic", kernels.logistic)])
@pytest.mark.parametrize("penalty,bias_too", [(0.0, False), (0.03, False), (0.03, True)])
def test_blocks_of_rows_are_the_same_updates(link, predict, penalty, bias_too):
    rng = np.random.default_rng(6)
    for n in (0, 1, 31, 32, 75):
        x, y, w = rng.normal(size=(n, 4)), (rng.random(n) > 0.5).astype(float), rng.normal(size=4)
        a = kernels.batches_pass(x, y, w, 0.3, predict, 1, 0.1, penalty, bias_too)
        b = kernels.row_by_row_pass(x, y, w, 0.3, link, 0.1, penalty, bias_too)
        assert b[0] == pytest.approx(a[0]) and b[1:] == pytest.approx(a[1:])


@pytest.mark.parametrize("topology", [(4, 5, 3, 1), (64, 16, 8, 1)])
@pytest.mark.parametrize("together", [False, True])
def test_a_stream_learns_the_same_bits_whichever_others_share_its_task(topology, together):
    rng = np.random.default_rng(5)
    lengths, layers = np.array([17, 40, 1, 29]), kernels.glorot_layers(topology, 3)
    x, y = rng.normal(size=(87, topology[0])), (rng.random(87) < 0.5).astype(float)
    whole = kernels.network_stream_states(x, y, layers, 0.3, lengths, together)
    cuts = np.cumsum([0, *lengths])
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        alone = kernels.network_stream_states(x[a:b], y[a:b], layers, 0.3, lengths[i : i + 1], together)
        assert np.array_equal(whole[i], alone[0])
        plain, squares = kernels.network_pass(x[a:b], y[a:b], layers, 0.3)
        assert np.allclose(whole[i], np.append(kernels.flatten(plain), squares), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("streams", [3, 20])
def test_networks_of_streams_are_the_same_bits_on_any_partitions(spark, sf_dir, monkeypatch, streams):
    """A network amplifies last bits: 1e-15 at the start became 0.003 in probabilities after 102,239 rows."""
    deal, data, found = models.deal_rows, doc_label(spark, sf_dir).persist(), []
    for n, tasks in ((1, 1), (2, 3), (7, 8), (7, 2)):
        monkeypatch.setattr(models, "deal_rows", lambda rows, k, tasks=tasks: ((d := deal(rows, k))[0].coalesce(tasks), d[1]))
        net = models.DeepNeuralNetwork((4, 5, 3, 1), models.NetworkOptions(0.1, 2), streams=streams)
        catalog._fitted_on_itself(data.repartition(n, F.hash("id", F.lit(n))), net)
        found.append(kernels.flatten(net.layers))
    assert all(np.array_equal(found[0], f) for f in found[1:])


def test_rows_of_one_id_have_an_order_in_streams(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 30, rng.normal(size=2).tolist(), float(rng.random() < 0.5)) for i in range(120)]
    found = []
    for turned in (rows, rows[::-1]):
        net = models.DeepNeuralNetwork((2, 3, 1), models.NetworkOptions(0.3, 2), streams=3)
        found.append(kernels.flatten(net.fit(spark.createDataFrame(turned, SCHEMA).repartition(4)).layers))
    assert np.array_equal(*found)


def test_many_numbered_arrays_are_added_in_the_order_of_their_numbers(spark):
    values = np.random.default_rng(4).normal(size=1000) * 10.0 ** np.random.default_rng(5).integers(-8, 8, 1000)

    def work(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield k, np.array([values[k], 1.0])

    sums = [merging.numbered_sums(spark.range(1000).repartition(n, F.hash("id", F.lit(n))), work, 2, 1000) for n in (1, 5, 13)]
    assert sums[0][1] == 1000 and math.isclose(sums[0][0], math.fsum(values), rel_tol=1e-9) and all(np.array_equal(sums[0], s) for s in sums)


def test_order_free_moments(spark):
    rng = np.random.default_rng(6)
    columns = [rng.normal(size=5000) * 10.0 ** rng.integers(-12, 6, 5000), rng.normal(size=5000) + 1e9, np.full(5000, 0.1), rng.normal(size=5000) * 1e-250, rng.normal(size=5000) * 1e152]
    x = np.column_stack(columns)
    fitted = {scaling.Scaler("z_score", order_free=True).fit(table(spark, [(r, 0) for r in x[o].tolist()]).repartition(n)) for n, o in ((1, slice(None)), (5, slice(None, None, -1)), (9, rng.permutation(5000)))}
    assert len(fitted) == 1
    got = fitted.pop()
    for j, column in enumerate(columns):
        exact = [Fraction(v) for v in column.tolist()]
        mean = sum(exact) / len(exact)
        assert math.isclose(got.centre[j], float(mean), rel_tol=1e-15)
        variance = sum((v - mean) ** 2 for v in exact) / len(exact)
        if float(variance):
            assert math.isclose(got.scale[j], math.sqrt(variance), rel_tol=1e-15)
    assert got.centre[2] == 0.1 and got.scale[2] == 1.0
    assert scaling.Scaler("mean", order_free=True).fit(table(spark, [((v,), 0) for v in (9, 10, 11)])).centre == (10.0,)


def test_order_free_moments_of_a_range_that_is_not_finite(spark):
    extreme = table(spark, [((1.5e308, 1.0), 0), ((-1.5e308, 2.0), 1)])
    assert scaling.Scaler("z_score", order_free=True).fit(extreme).scale[1] == 0.5


def test_streams_are_networks_of_their_own():
    rng = np.random.default_rng(7)
    x, y, layers = rng.normal(size=(23, 3)), rng.random(23), kernels.glorot_layers((3, 4, 2, 1), 1)
    one, _ = kernels.network_streams_pass(x, y, layers, 0.2, 1)
    assert kernels.flatten(one) == pytest.approx(kernels.flatten(kernels.network_pass(x, y, layers, 0.2)[0]))
    got, squares = kernels.network_streams_pass(x, y, layers, 0.2, 5)
    bounds, mean, total = [0, 5, 10, 15, 19, 23], 0.0, 0.0
    for a, b in zip(bounds, bounds[1:]):
        own, s = kernels.network_pass(x[a:b], y[a:b], layers, 0.2)
        mean, total = mean + kernels.flatten(own) * (b - a) / 23, total + s
    assert kernels.flatten(got) == pytest.approx(mean) and squares == pytest.approx(total)


def test_averaged_training_is_repeatable(spark):
    df = table(spark, [((i / 50,), 3 * i / 50 + 2) for i in range(50)])
    optimiser = training.StochasticGradientDescent(options=training.StochasticOptions(0.05, 3), streams=4)
    first = optimiser.optimise(df, training.Parameters.zeros(1), kernels.logistic).parameters
    second = optimiser.optimise(df.repartition(9), training.Parameters.zeros(1), kernels.logistic).parameters
    assert [*first.weights, first.bias] == pytest.approx([*second.weights, second.bias])


@pytest.mark.parametrize(
    "make",
    [
        lambda: training.GradientDescentOptions(learning_rate=0),
        lambda: training.GradientDescentOptions(epochs=0),
        lambda: training.GradientDescentOptions(l2=-1),
        lambda: training.MiniBatchOptions(batch_size=0),
        lambda: training.StochasticOptions(decay=float("nan")),
        lambda: models.NetworkOptions(learning_rate=-1),
        lambda: models.DeepNeuralNetwork((3,)),
        lambda: models.DeepNeuralNetwork((3, 2)),
        lambda: models.BasicNeuralNetwork(0),
    ],
)
def test_bad_options_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_own_hypotheses_and_callbacks_on_every_optimiser(spark):
    """A hypothesis of the caller (here: exponential), a callback, and an L2 term on the bias."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 2)) / 3
    y = np.exp(x @ np.array([0.5, -0.3]) + 0.2)
    predict = lambda a, w, b: np.exp(a @ w + b)
    df = table(spark, list(zip(x.tolist(), y)))
    for optimiser in (
        training.BatchGradientDescent(training.GradientDescentOptions(0.3, 30)),
        training.MiniBatchGradientDescent(options=training.MiniBatchOptions(0.3, 10, batch_size=8), streams=2),
        training.StochasticGradientDescent(options=training.StochasticOptions(0.1, 8, l2=0.001, regularise_bias=True)),
    ):
        seen = []
        trained = optimiser.optimise(df, training.Parameters.zeros(2), predict, lambda e, c: seen.append((e, c)))
        assert [c for _, c in seen] == list(trained.costs) and trained.costs[-1] < trained.costs[0] / 4
        assert trained.trace(spark).count() == len(seen)


def test_divergence_is_an_error(spark):
    with pytest.raises(FloatingPointError):
        training.BatchGradientDescent(training.GradientDescentOptions(10.0, 500)).optimise(line(spark), training.Parameters.zeros(1))


def test_network_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    layers, x, y = kernels.glorot_layers((3, 4, 1), 7), rng.normal(size=(1, 3)), np.array([1.0])
    after, _ = kernels.network_pass(x, y, layers, 1.0)
    moved = kernels.flatten(layers) - kernels.flatten(after)
    loss = lambda flat: -math.log(kernels.network_forward(x, kernels.unflatten(flat, (3, 4, 1)))[0])
    flat = kernels.flatten(layers)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert (loss(flat + step) - loss(flat - step)) / 2e-6 == pytest.approx(moved[i], abs=1e-6)


def test_networks_separate_small_tables(spark):
    xor = [((0, 0), 0), ((0, 1), 1), ((1, 0), 1), ((1, 1), 0)]
    x, y = np.array([r[0] for r in xor], dtype=float), np.array([r[1] for r in xor], dtype=float)
    layers = kernels.glorot_layers((2, 4, 1), 3)
    for _ in range(6000):
        layers, _ = kernels.network_pass(x, y, layers, 0.5)
    assert ((kernels.network_forward(x, layers) >= 0.5) == (y > 0.5)).all()
    x, y = np.array([[0.0], [0.2], [0.8], [1.0]]), np.array([0.0, 0.0, 1.0, 1.0])
    layers = start = kernels.glorot_layers((1, 4, 1), 42)
    for _ in range(5000):
        layers, _ = kernels.network_pass(x, y, layers, 0.5)
    p = kernels.network_forward(x, layers)
    assert max(p[:2]) < 0.5 < min(p[2:])
    # The same rule on a table, in the order of ids.
    df = table(spark, list(zip(x.tolist(), y)))
    net = models.BasicNeuralNetwork(4, models.NetworkOptions(0.5, 3)).fit(df.repartition(3))
    layers = start
    for _ in range(3):
        layers, _ = kernels.network_pass(x, y, layers, 0.5)
    assert [r["probability"] for r in net.predict(df).orderBy("id").collect()] == pytest.approx(kernels.network_forward(x, layers))
    assert net.layers_table(spark).count() == 2
    with pytest.raises(ValueError):
        models.DeepNeuralNetwork((2, 2, 1)).fit(df)


# --- metrics, pipelines, folds ----------------------------------------------------------------


def test_regression_metrics_by_hand(spark):
    rows = spark.createDataFrame([(3.0, 2.0), (5.0, 5.0), (7.0, 9.0)], "prediction double, target double")
    got = metrics.regression_metrics(rows).first()
    assert (got["mse"], got["mae"]) == pytest.approx((5 / 3, 1.0))
    constant = spark.createDataFrame([(3.0, 5.0), (5.0, 5.0)], "prediction double, target double")
    assert metrics.regression_metrics(constant).first()["r_squared"] == 0
    near = spark.createDataFrame([(10.5, 10.0), (20.0, 20.0), (5.0, 100.0)], "prediction double, target double")
    assert metrics.regression_metrics(near).first()["within_tolerance_ratio"] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="at least one row"):
        metrics.regression_metrics(rows.limit(0)).collect()
    with pytest.raises(ValueError):
        metrics.regression_metrics(rows, tolerance=-1)


def test_class_rates_by_hand(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "probability double, target double")
    got = metrics.binary_metrics(rows).first()
    assert [got[c] for c in ("accuracy", "precision", "recall", "f1_score")] == pytest.approx([3 / 5, 2 / 3, 2 / 3, 2 / 3])
    none = metrics.binary_metrics(rows.filter("probability = 0 AND target = 0")).first()
    assert [none[c] for c in ("accuracy", "precision", "recall", "f1_score")] == [1, 0, 0, 0]


def test_pipelines(spark):
    options = training.BatchGradientDescent(training.GradientDescentOptions(0.3, 300))
    train = line(spark)
    pipeline = RegressionPipeline(optimiser=options)
    with pytest.raises(models.NotFittedError):
        pipeline.predict(train)
    pipeline.fit(train)
    row = pipeline.predict(table(spark, [((4,), 9)])).first()
    assert row["prediction"] == pytest.approx(9, abs=0.1) and row["features"] == [4.0]
    assert pipeline.evaluate(train).first()["r_squared"] > 0.99
    with pytest.raises(ValueError):
        pipeline.fit(train.limit(0))
    with pytest.raises(models.NotFittedError):  # a failed refit
        pipeline.predict(train)
    four = table(spark, [((0.1,), 0), ((0.2,), 0), ((0.8,), 1), ((0.9,), 1)])
    binary = BinaryClassificationPipeline(scaling.Scaler("min_max"), options).fit(four)
    assert [binary.evaluate(four).first()[c] for c in ("accuracy", "precision", "recall", "f1_score")] == [1, 1, 1, 1]
    assert [r["predicted"] for r in binary.predict_class(table(spark, [((0.15,), 0), ((0.85,), 1)])).orderBy("id").collect()] == [False, True]
    assert score_binary_model(binary, four).first()["accuracy"] == 1
    with pytest.raises(ValueError):
        binary.evaluate(four, 1.0)


def test_cross_validation_forms_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 2))
    df = table(spark, list(zip(x.tolist(), (x[:, 0] + 0.3 * rng.normal(size=120) > 0.4).astype(float))))
    one, summary = crossval.cross_validate(df.repartition(4), {"m": crossval.BatchLogistic(0.5, 20)}, folds=3)
    options = training.BatchGradientDescent(training.GradientDescentOptions(0.5, 20))
    two, _ = crossval.cross_validate_distributed(df, {"m": lambda: models.LogisticBinaryClassifier(options)}, folds=3)
    a, b = ({r["eval_fold"]: [r[c] for c in metrics.METRIC_COLUMNS] for r in t.collect()} for t in (one, two))
    assert set(a) == {0, 1, 2} and all(a[k] == pytest.approx(b[k]) for k in a)
    assert summary.first()["folds"] == 3


@pytest.mark.parametrize("streams", [1, 3])
def test_sequential_models_side_by_side_are_those_trained_alone(spark, streams):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    df = table(spark, list(zip(x.tolist(), (x[:, 0] > 0.4).astype(float))))
    learners = {"sgd": crossval.StochasticLogistic(0.2, 3, decay=0.1), "net": crossval.SigmoidNetwork((3,), 0.3, 2)}
    one, _ = crossval.cross_validate(df.repartition(4), learners, folds=3, streams=streams)
    sgd = training.StochasticGradientDescent(options=training.StochasticOptions(0.2, 3, decay=0.1), streams=streams)
    factories = {"sgd": lambda: models.LogisticBinaryClassifier(sgd), "net": lambda: models.BasicNeuralNetwork(3, models.NetworkOptions(0.3, 2), streams=streams)}
    two, _ = crossval.cross_validate_distributed(df, factories, folds=3)
    a, b = ({(r["model"], r["eval_fold"]): [r[c] for c in metrics.METRIC_COLUMNS] for r in t.collect()} for t in (one, two))
    assert len(a) == 6 and all(a[k] == pytest.approx(b[k]) for k in a)


# --- sources and streams ----------------------------------------------------------------------


def csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize(
    "text,options,rows",
    [
        ("width,height,area\n6,7.5,45\n-8.25,2,-16.5\n", {}, [([6, 7.5], 45), ([-8.25, 2], -16.5)]),
        ("0.125,9\n7.75,-4\n", {"has_header": False}, [([0.125], 9), ([7.75], -4)]),
        ("u|v|w|z\n31|62.5|93|0.5\n", {"delimiter": "|"}, [([31, 62.5, 93], 0.5)]),
        ("a,b,c\r\n17,18.5,2\r\n3e2,-.5,+10.\r\n", {}, [([17, 18.5], 2), ([300, -0.5], 10)]),
    ],
)
def test_csv_reads(spark, tmp_path, text, options, rows):
    got = tables.read_labelled_csv(spark, csv(tmp_path, text), **options).orderBy("id").collect()
    assert [(r["features"], r["target"]) for r in got] == rows


@pytest.mark.parametrize(
    "text",
    ["", "a,b\n", "a,b,c\n8,eight,9\n", "a\n8.5\n", "a,b,c\n8,9,10,\n", "a,b,c\n11,12,13\n14,15,16,17\n", "a,b\n1,2\n\n3,4\n", "a,b\n1,NaN\n", "a,b\n1,1e400\n", "a,b\n1, 2\n", "a,b\n1d,2\n", "a,b\n,2\n"],
)
def test_bad_csv_is_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        tables.read_labelled_csv(spark, csv(tmp_path, text))


def test_csv_errors_name_the_line(spark, tmp_path):
    text = "a,b\n" + "".join(f"{i},{i}\n" for i in range(2000)) + "7,x\n" + "".join(f"{i},{i}\n" for i in range(500)) + "8,y\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several blocks
    try:
        with pytest.raises(ValueError, match="2 bad lines; line 2002 has a value that isn't a number: '7,x'"):
            tables.read_labelled_csv(spark, csv(tmp_path, text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block", ["17", "64", "100000"])
def test_many_files_are_read_once(spark, tmp_path, block):
    """Every file has a header; blocks begin anywhere; the text is scanned once, but for its first lines."""
    want, folder = set(), tmp_path / "many"
    folder.mkdir()
    for k in range(4):
        rows = [(k * 100 + i, -i / 4) for i in range(5 * k + 1)]
        want |= {((float(a),), b) for a, b in rows}
        (folder / f"part-{k}.csv").write_text("left,right\n" + "".join(f"{a},{b}\n" for a, b in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = tables.read_labelled_csv(spark, str(folder))
        rows = got.collect()
        assert {(tuple(r["features"]), r["target"]) for r in rows} == want and len(rows) == len(want) == len({r["id"] for r in rows})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "text" not in got._jdf.queryExecution().executedPlan().toString().lower()  # what is read from now on is the checked table


def counted(spark, df, column):
    """``df`` whose ``column`` counts how often it is evaluated."""
    times = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def same(value):
        times.add(1)
        return value

    return df.withColumn(column, same.asNondeterministic()(F.col(column))), times


def test_writers_evaluate_once(spark, tmp_path):
    scored, times = counted(spark, spark.createDataFrame([(2.5, 3.25), (-6.0, -6.5), (0.0, 9.0)], "target double, prediction double"), "prediction")
    tables.write_regression(scored, str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True, inferSchema=True).collect()
    assert sorted(tuple(r) for r in back) == [(-6.0, -6.5, -0.5), (0.0, 9.0, 9.0), (2.5, 3.25, 0.75)] and times.value == 3
    classes = spark.createDataFrame([(1.0, 0.61), (0.0, 0.58), (1.0, 0.07)], "target double, probability double")
    tables.write_classification(classes, str(tmp_path / "c"), 0.6, "parquet")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [(0, 0.58, 0, 1), (1, 0.07, 0, 0), (1, 0.61, 1, 1)]


def test_refused_output_is_not_published(spark, tmp_path):
    scored = spark.createDataFrame([(2.5, 3.25), (1.0, 2.0)], "target double, prediction double")
    for rows, what in ((scored.limit(0), "nothing"), (scored.withColumn("prediction", F.col("prediction") / F.lit(1e-320) / 1e-320), "finite")):
        with pytest.raises(ValueError, match=what):
            tables.write_regression(rows, str(tmp_path / "no"))
        assert not (tmp_path / "no").exists()
    with pytest.raises(ValueError, match="format"):
        tables.write_regression(scored, str(tmp_path / "no"), "table")
    tables.write_regression(scored, str(tmp_path / "yes"))
    with pytest.raises(Exception, match="exists"):
        tables.write_regression(scored, str(tmp_path / "yes"))
    assert spark.read.csv(str(tmp_path / "yes"), header=True).count() == 2


@pytest.mark.parametrize("kind", ["min_max", "z_score", "max_abs", "robust", "none"])
def test_checks_ride_on_the_pass_of_the_scaler(spark, kind):
    good = table(spark, [((i, i * i), i % 2) for i in range(30)])
    facts, fitted = scaling.Scaler(kind).fit_checked(good, binary=True)
    assert facts == validate.TableFacts(30, 2) and fitted == scaling.Scaler(kind).fit(good)
    short = good.unionByName(spark.createDataFrame([(99, [1.0], 1.0)], SCHEMA))
    for bad in (short, good.limit(0), good.withColumn("target", F.lit(0.5)), good.withColumn("features", F.array(F.lit(float("nan")), F.lit(1.0)))):
        with pytest.raises(ValueError):
            scaling.Scaler(kind).fit_checked(bad, binary=True)


def test_a_stream_is_scored(spark, tmp_path):
    rows = line(spark, 20)
    rows.write.parquet(str(tmp_path / "in"))
    pipeline = RegressionPipeline(optimiser=training.BatchGradientDescent(training.GradientDescentOptions(0.3, 100))).fit(rows)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_scores(score_stream(stream, pipeline).select("id", "prediction"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({r["id"]: r["prediction"] for r in pipeline.predict(rows).collect()})
    with pytest.raises(ValueError):
        score_stream(rows, pipeline)
