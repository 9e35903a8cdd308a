"""Gradient descent as distributed aggregations: batch, mini-batch and stochastic."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrad.functions.kernels import (
    Hypothesis,
    affine_compose,
    affine_pass,
    affine_start,
    batches_pass,
    gradient_sums,
    linear,
    logistic,
    logistic_streams_pass,
    row_by_row_pass,
)
from loomgrad.operators.chain import range_count, travel
from loomgrad.operators.merging import array_sums, count_with_parts, merged_states, numbered_sums
from loomgrad.operators.ranking import rank_in_groups
from loomgrad.operators.splits import order_key, rank_digits

#: Features up to which the linear statistics, (d + 2) squared numbers a task, are worth one pass.
GRAM_FEATURES = 2000
#: Features up to which the updates of a linear model are composed as matrices. Beyond, ranges follow each other.
AFFINE_FEATURES = 200
#: Rows of a range whose updates one task composes.
COMPOSED_ROWS = 250_000
#: Rows of one of several averaged streams at most: a task holds them.
STREAM_ROWS = 1_000_000


@dataclass(frozen=True)
class GradientDescentOptions:
    learning_rate: float = 0.01
    epochs: int = 100
    l2: float = 0.0
    regularise_bias: bool = False

    def __post_init__(self) -> None:
        if not math.isfinite(self.learning_rate) or self.learning_rate <= 0:
            raise ValueError("the learning rate must be finite and positive")
        if self.epochs < 1:
            raise ValueError("at least one epoch is needed")
        if not math.isfinite(self.l2) or self.l2 < 0:
            raise ValueError("the L2 weight must be finite and not negative")


@dataclass(frozen=True)
class MiniBatchOptions(GradientDescentOptions):
    batch_size: int = 32
    shuffle: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.batch_size < 1:
            raise ValueError("the batch size must be at least 1")


@dataclass(frozen=True)
class StochasticOptions(GradientDescentOptions):
    shuffle: bool = True
    seed: int = 42
    decay: float = 0.0

    def __post_init__(self) -> None:
        super().__post_init__()
        if not math.isfinite(self.decay) or self.decay < 0:
            raise ValueError("the decay must be finite and not negative")


@dataclass(frozen=True)
class Parameters:
    weights: tuple[float, ...]
    bias: float = 0.0

    @staticmethod
    def zeros(n_features: int) -> Parameters:
        return Parameters((0.0,) * n_features, 0.0)


@dataclass(frozen=True)
class Trained:
    """Fitted parameters and the mean squared residual of each epoch."""

    parameters: Parameters
    costs: tuple[float, ...] = field(default=())

    def trace(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, c) for i, c in enumerate(self.costs)], "epoch int, cost double")


EpochCallback = Callable[[int, float], None]


def matrix_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(features, target) of an Arrow batch whose rows have equally many features."""
    column = batch.column(batch.schema.get_field_index("features"))
    y = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y


def summed(df: DataFrame, partial: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, parts: int | None = None) -> np.ndarray:
    """The sum over all rows of ``partial(features, target)``: one array a task, merged in executors.

    ``parts``: the number of partitions, if known.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += partial(*matrix_of(batch))
        return total

    return array_sums(df.select("features", "target"), work, width, parts=parts)


def gram_statistics(df: DataFrame, n_features: int) -> np.ndarray:
    """Z'Z of the rows Z = [features, 1, target]: everything that linear training needs, in one pass."""

    def partial(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([x, np.ones(len(y)), y])
        return (z.T @ z).ravel()

    d = n_features + 2
    return summed(df, partial, d * d).reshape(d, d)


def _require_finite(values: np.ndarray | float, epoch: int) -> None:
    if not np.all(np.isfinite(values)):
        raise FloatingPointError(f"training diverged in epoch {epoch}: lower the learning rate or scale the features")


def _step(theta: np.ndarray, gradient: np.ndarray, n: float, options: GradientDescentOptions, lr: float) -> np.ndarray:
    """One update of [weights, bias]; the L2 term is divided by all rows."""
    penalty = np.zeros_like(theta)
    if options.l2 > 0:
        penalty = options.l2 / n * theta
        if not options.regularise_bias:
            penalty[-1] = 0.0
    return theta - lr * (gradient + penalty)


@dataclass(frozen=True)
class BatchGradientDescent:
    """All rows per update. A linear hypothesis needs one pass over the data for all epochs, others
    one job an epoch, in which tasks return d + 2 sums."""

    options: GradientDescentOptions = GradientDescentOptions()

    def optimise(
        self, train: DataFrame, start: Parameters, predict: Hypothesis = linear, on_epoch: EpochCallback | None = None
    ) -> Trained:
        theta = np.array([*start.weights, start.bias])
        d, costs = len(theta) - 1, []
        if predict is linear and d <= GRAM_FEATURES:
            z = gram_statistics(train, d)
            gram, target_sums, squares, n = z[: d + 1, : d + 1], z[: d + 1, -1], z[-1, -1], z[d, d]

            def sums(t: np.ndarray) -> tuple[np.ndarray, float]:
                return gram @ t - target_sums, max(0.0, float(t @ gram @ t - 2 * target_sums @ t + squares))

            return self._descend(theta, n, sums, on_epoch, costs)
        data = train.select("features", "target").persist()
        try:
            n, parts = count_with_parts(data)

            def sums(t: np.ndarray) -> tuple[np.ndarray, float]:
                w, b = t[:-1].copy(), float(t[-1])
                got = summed(data, lambda x, y: gradient_sums(x, y, w, b, predict), d + 2, parts)
                return got[: d + 1], float(got[-1])

            return self._descend(theta, n, sums, on_epoch, costs)
        finally:
            data.unpersist()

    def _descend(self, theta, n, sums, on_epoch, costs) -> Trained:
        for epoch in range(self.options.epochs):
            gradient, squares = sums(theta)
            _require_finite(gradient, epoch)
            costs.append(float(squares / n))
            theta = _step(theta, gradient / n, n, self.options, self.options.learning_rate)
            _require_finite(theta, epoch)
            if on_epoch:
                on_epoch(epoch, costs[-1])
        return Trained(Parameters(tuple(theta[:-1].tolist()), float(theta[-1])), tuple(costs))


def stream_of(streams: int, id_col: str = "id"):
    """The stream of a row: a hash of its id, modulo ``streams``."""
    digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":stream"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(streams)).cast("int")


def deal_rows(train: DataFrame, streams: int) -> tuple[DataFrame, int]:
    """(id, stream, features, target and other columns; number of rows), persisted with each of several streams whole in one partition.

    Streams longer than STREAM_ROWS on average are an error: the number of streams is never changed unasked.
    """
    if streams < 2:
        raise ValueError("at least two streams are averaged")
    n = train.count()
    if n > streams * STREAM_ROWS:
        raise ValueError(f"{n} rows in {streams} streams: at most {STREAM_ROWS} a stream; one stream takes any number")
    tasks = min(streams, max(train.sparkSession.sparkContext.defaultParallelism, math.ceil(n / STREAM_ROWS)))
    rows = train.withColumn("stream", stream_of(streams))
    return (rows.repartitionByRange(tasks, "stream") if tasks > 1 else rows.repartition(1)).persist(), n


def stream_lengths(streams: np.ndarray) -> np.ndarray:
    """Rows of each of the consecutive streams."""
    edges = np.flatnonzero(np.concatenate([[True], streams[1:] != streams[:-1], [True]]))
    return np.diff(edges)


def _held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(features, target, streams) of a partition, if it has rows: an update chain needs them together, and they are
    a bounded share of the table."""
    parts = [(*matrix_of(b), b.column(b.schema.get_field_index("stream")).to_numpy()) for b in batches if b.num_rows]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else None


def streams_average(rows: DataFrame, learn: Callable, width: int, streams: int, n: int) -> tuple[np.ndarray, float]:
    """``learn(features, target, lengths)`` -> [parameters, squares] of each stream of a partition, in its order;
    returns the mean of the parameters by rows, and all squares.

    Streams are added in the order of their numbers, so it doesn't show which of them shared a partition.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        held = _held(batches)
        if held is None:
            return
        x, y, numbers = held
        lengths = stream_lengths(numbers)
        for number, k, state in zip(numbers[np.cumsum(lengths) - 1].tolist(), lengths.tolist(), learn(x, y, lengths), strict=True):
            yield number, np.append(k * state[:width], state[width])

    total = numbered_sums(rows.select("stream", "features", "target"), work, width + 1, streams)
    return total[:width] / n, float(total[-1])


def averaged_pass(rows: DataFrame, update: Callable, width: int, n: int) -> tuple[np.ndarray, float]:
    """``update(features, target, lengths)`` -> (sum of stream parameters times stream rows, squares) on each
    partition, in its order; returns the mean of the parameters by rows, and all squares."""

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = _held(batches)
        if held is None:
            return np.zeros(width + 1)
        x, y, streams = held
        return np.append(*update(x, y, stream_lengths(streams)))

    total = array_sums(rows.select("stream", "features", "target"), work, width + 1)
    return total[:width] / n, float(total[-1])


def _composed(
    rows: DataFrame, n: int, d: int, batch: int, lr: float, penalty: float, regularise_bias: bool
) -> list[tuple[np.ndarray, np.ndarray]]:
    """The composed updates of runs of ``rows`` (key, place, features, target), in their order.

    Ranges are composed side by side and their maps merged in executors, in order: the driver gets at most 64.
    """
    cut = (d + 1) * (d + 2)

    def packed(z: np.ndarray, s: np.ndarray) -> bytes:
        return np.concatenate([z.ravel(), s.ravel()]).tobytes()

    def unpacked(state: bytes) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.frombuffer(state)
        return numbers[:cut].reshape(d + 1, d + 2), numbers[cut:].reshape(d + 2, d + 2)

    def work(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        state, rest = affine_start(d), None
        for b in batches:
            if not b.num_rows:
                continue
            now = matrix_of(b)
            x, y = now if rest is None else tuple(np.concatenate([r, v]) for r, v in zip(rest, now, strict=True))
            whole = len(y) // batch * batch  # a batch may go on in the next Arrow batch, never in another partition
            state, rest = affine_pass(x[:whole], y[:whole], state, batch, lr, penalty, regularise_bias), (x[whole:], y[whole:])
        return None if rest is None else packed(*affine_pass(*rest, state, batch, lr, penalty, regularise_bias))

    def combine(first: bytes, second: bytes) -> bytes:
        return packed(*affine_compose(unpacked(first), unpacked(second)))

    parts = max(math.ceil(n / COMPOSED_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n))
    by = ["key", "place"] if batch == 1 else [F.floor(F.col("place") / batch)]
    ordered = rows.select("key", "place", "features", "target").repartitionByRange(parts, *by).sortWithinPartitions("key", "place")
    return [unpacked(state) for state in merged_states(ordered, work, combine, parts)]


def _in_order(rows: DataFrame, n: int, seed: int | None, epoch: int, batch: int) -> DataFrame:
    """``rows`` with key and place, whose order is that of the epoch (ids without a seed); places count rows if batches need it."""
    key = F.lit("") if seed is None else order_key(seed, epoch)
    if batch == 1:
        return rows.withColumns({"key": key, "place": F.col("id").cast("long")})
    if seed is None:
        shares = max(2, min(1000, n // 1000))
        cuts = sorted(set(rows.approxQuantile("id", [i / shares for i in range(1, shares)], 0.0005)))
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
        order = [F.col("id")]
    else:
        rows = rows.withColumn("order_key", key)
        bucket, order = F.substring("order_key", 1, rank_digits(n)), [F.col("order_key"), F.col("id")]
    return rank_in_groups(rows.withColumn("key", F.lit("")), ["key"], bucket, order, "place")


@dataclass(frozen=True)
class _OneByOne:
    """The sequential rule of one model, as a learner that travels over ranges. A short batch waits for its rows."""

    epochs: int
    seed: int | None
    predict: Hypothesis
    batch: int
    rate: Callable[[int], float]
    penalty: float
    regularise_bias: bool

    def order(self, epoch: int):
        return "id" if self.seed is None else ("key", self.seed, epoch)

    def sort_columns(self, epoch: int) -> list:
        return [F.col("id")] if self.seed is None else [order_key(self.seed, epoch), F.col("id")]

    def update(self, state: dict, batch: pa.RecordBatch, epoch: int) -> dict:
        x, y = matrix_of(batch)
        if state["rest"] is not None:
            x, y = np.concatenate([state["rest"][0], x]), np.concatenate([state["rest"][1], y])
        whole = len(y) // self.batch * self.batch
        rest = (x[whole:].copy(), y[whole:].copy()) if whole < len(y) else None
        return self._learn(state, x[:whole], y[:whole], epoch) | {"rest": rest}

    def close(self, state: dict, epoch: int) -> dict:
        if state["rest"] is not None:
            state = self._learn(state, *state["rest"], epoch)
        return state | {"rest": None, "cost": state["squares"], "squares": 0.0}

    def _learn(self, state: dict, x: np.ndarray, y: np.ndarray, epoch: int) -> dict:
        w, b, rule = state["flat"][:-1], float(state["flat"][-1]), (self.rate(epoch), self.penalty, self.regularise_bias)
        if self.batch == 1 and self.predict in (linear, logistic):
            w, b, squares = row_by_row_pass(x, y, w, b, "linear" if self.predict is linear else "logistic", *rule)
        else:
            w, b, squares = batches_pass(x, y, w, b, self.predict, self.batch, *rule)
        return state | {"flat": np.append(w, b), "squares": state["squares"] + squares}


@dataclass(frozen=True)
class _Sequential:
    """Updates follow each other in the order of the epoch.

    A linear model of up to AFFINE_FEATURES features is composed: ranges of rows work side by side (see
    :func:`affine_pass`). Other models run in ``streams``. One stream is the plain sequential rule on any
    number of rows: ranges follow each other and hand the parameters on (see :mod:`~loomgrad.operators.chain`).
    More are an approximation that the caller asks for, as it works on all cores: streams, made by a hash of
    the id, start each epoch from the same parameters, which are then averaged weighted by rows. The result
    depends on the number of streams, never on partitions.
    """

    streams: int = 1

    def _optimise(self, train, start, predict, on_epoch, batch: int, rate: Callable[[int], float]) -> Trained:
        flat = np.array([*start.weights, start.bias])
        if self.streams < 1:
            raise ValueError("at least one stream is needed")
        costs = []

        def closed(epoch: int, now: np.ndarray, squares: float, n: int) -> None:
            _require_finite(now, epoch)
            costs.append(squares / n)
            if on_epoch:
                on_epoch(epoch, costs[-1])

        if predict is not linear or len(flat) > AFFINE_FEATURES + 1:
            if self.streams == 1:
                flat = self._chained(train, flat, predict, batch, rate, closed)
                return Trained(Parameters(tuple(flat[:-1].tolist()), float(flat[-1])), tuple(costs))
            epochs = self._stream_epochs
        else:
            epochs = self._linear_epochs
        for epoch, (flat, squares, n) in enumerate(epochs(train, flat, predict, batch, rate)):
            closed(epoch, flat, squares, n)
        return Trained(Parameters(tuple(flat[:-1].tolist()), float(flat[-1])), tuple(costs))

    def _linear_epochs(self, train, flat, predict, batch, rate):
        options, d = self.options, len(flat) - 1
        rows = train.select("id", "features", "target").persist()
        try:
            n, seed, parts = rows.count(), options.seed if options.shuffle else None, None
            for epoch in range(options.epochs):
                if parts is None or options.shuffle or rate(epoch) != rate(epoch - 1):
                    ordered = _in_order(rows, n, seed, epoch, batch)
                    parts = _composed(ordered, n, d, batch, rate(epoch), options.l2 / n, options.regularise_bias)
                squares = 0.0
                for z, s in parts:
                    one = np.append(flat, 1.0)
                    squares += float(one @ s @ one)
                    flat = z @ one
                yield flat, squares, n
        finally:
            rows.unpersist()

    def _chained(self, train, flat, predict, batch, rate, closed):
        options = self.options
        rows = train.select("id", "features", "target").persist()
        try:
            n = rows.count()
            seed = options.seed if options.shuffle else None
            learner = _OneByOne(options.epochs, seed, predict, batch, rate, options.l2 / n, options.regularise_bias)
            start = {"flat": flat, "squares": 0.0, "rest": None, "cost": 0.0}
            states = travel(rows, [learner], [start], range_count(n, 1, 1), lambda k, epoch, state: closed(epoch, state["flat"], state["cost"], n))
            return states[0]["flat"]
        finally:
            rows.unpersist()

    def _stream_epochs(self, train, flat, predict, batch, rate):
        options, d = self.options, len(flat) - 1
        dealt, n = deal_rows(train.select("id", "features", "target"), self.streams)
        penalty, bias_too = options.l2 / n, options.regularise_bias
        try:
            for epoch in range(options.epochs):
                key = [order_key(options.seed, epoch), F.col("id")] if options.shuffle else [F.col("id")]
                w, b, lr = flat[:d].copy(), float(flat[d]), rate(epoch)

                def update(x, y, lengths, w=w, b=b, lr=lr) -> tuple[np.ndarray, float]:
                    if predict is logistic and batch == 1 and len(lengths) > 1:
                        return logistic_streams_pass(x, y, w, b, lengths, lr, penalty, bias_too)
                    total, squares, at = np.zeros(d + 1), 0.0, 0
                    for k in lengths.tolist():
                        part, target = x[at : at + k], y[at : at + k]
                        if predict is logistic and batch == 1:
                            got, bias, s = row_by_row_pass(part, target, w, b, "logistic", lr, penalty, bias_too)
                        else:
                            got, bias, s = batches_pass(part, target, w, b, predict, batch, lr, penalty, bias_too)
                        total, squares, at = total + k * np.append(got, bias), squares + s, at + k
                    return total, squares

                flat, squares = averaged_pass(dealt.sortWithinPartitions("stream", *key), update, d + 1, n)
                yield flat, squares, n
        finally:
            dealt.unpersist()


@dataclass(frozen=True)
class MiniBatchGradientDescent(_Sequential):
    """An update per ``batch_size`` consecutive rows of the (shuffled) order."""

    options: MiniBatchOptions = MiniBatchOptions()

    def optimise(
        self, train: DataFrame, start: Parameters, predict: Hypothesis = linear, on_epoch: EpochCallback | None = None
    ) -> Trained:
        return self._optimise(train, start, predict, on_epoch, self.options.batch_size, lambda _: self.options.learning_rate)


@dataclass(frozen=True)
class StochasticGradientDescent(_Sequential):
    """An update per row of the (shuffled) order; the rate of an epoch is learning_rate / (1 + decay * epoch)."""

    options: StochasticOptions = StochasticOptions()

    def optimise(
        self, train: DataFrame, start: Parameters, predict: Hypothesis = linear, on_epoch: EpochCallback | None = None
    ) -> Trained:
        o = self.options
        return self._optimise(train, start, predict, on_epoch, 1, lambda epoch: o.learning_rate / (1 + o.decay * epoch))
