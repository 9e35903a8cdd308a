"""Models: linear regression, logistic classifier and sigmoid networks. Fit on a table, score a table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrad.functions.activations import sigmoid
from loomgrad.functions.kernels import (
    Layers,
    flatten,
    glorot_layers,
    linear,
    logistic,
    network_forward,
    network_pass,
    network_stream_states,
    unflatten,
)
from loomgrad.functions.vectors import checked, linear_output
from loomgrad.operators.chain import range_count, travel
from loomgrad.operators.training import (
    BatchGradientDescent,
    EpochCallback,
    Parameters,
    Trained,
    deal_rows,
    matrix_of,
    streams_average,
)
from loomgrad.operators.validate import classify, validate_training_table


#: Streams up to which those that share a task learn one after the other. More learn side by side.
FEW_STREAMS = 8


class NotFittedError(RuntimeError):
    """The model or pipeline was used before a successful fit."""


class _Fitted:
    trained: Trained | None = None

    def _require(self) -> Trained:
        if self.trained is None:
            raise NotFittedError("fit the model first")
        return self.trained

    @property
    def parameters(self) -> Parameters:
        return self._require().parameters

    def parameters_table(self, spark: SparkSession) -> DataFrame:
        p = self.parameters
        return spark.createDataFrame([(list(p.weights), p.bias)], "weights array<double>, bias double")


class LinearRegression(_Fitted):
    """``prediction`` = bias + weights . features, trained from zero by any of the optimisers."""

    hypothesis = staticmethod(linear)
    output = "prediction"
    binary = False

    def __init__(self, optimiser=None) -> None:
        self.optimiser = optimiser or BatchGradientDescent()

    def fit(self, train: DataFrame, on_epoch: EpochCallback | None = None, validated_features: int | None = None):
        self.trained = None
        d = validated_features or validate_training_table(train, self.binary, type(self).__name__).features
        self.trained = self.optimiser.optimise(train, Parameters.zeros(d), self.hypothesis, on_epoch)
        return self

    def expression(self, features: Column, check: bool = True) -> Column:
        p = self.parameters
        return linear_output(checked(features, len(p.weights)) if check else features, p.weights, p.bias)

    def predict(self, df: DataFrame, check: bool = True) -> DataFrame:
        """``df`` with the output column: a projection, so it works on a stream too."""
        return df.withColumn(self.output, self.expression(F.col("features"), check))


class LogisticBinaryClassifier(LinearRegression):
    """``probability`` = sigmoid(bias + weights . features); targets must be 0 or 1."""

    hypothesis = staticmethod(logistic)
    output = "probability"
    binary = True

    def expression(self, features: Column, check: bool = True) -> Column:
        return sigmoid(super().expression(features, check))

    def predict_class(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict(df).withColumn("predicted", classify(F.col("probability"), threshold))


@dataclass(frozen=True)
class NetworkOptions:
    learning_rate: float = 0.1
    epochs: int = 1000
    seed: int = 42

    def __post_init__(self) -> None:
        if not math.isfinite(self.learning_rate) or self.learning_rate <= 0:
            raise ValueError("the learning rate must be finite and positive")
        if self.epochs < 1:
            raise ValueError("at least one epoch is needed")


@dataclass(frozen=True)
class _NetworkRows:
    """The sequential rule of one network, as a learner that travels over ranges."""

    epochs: int
    topology: tuple[int, ...]
    learning_rate: float

    def order(self, epoch: int) -> str:
        return "id"

    def sort_columns(self, epoch: int) -> list[Column]:
        return [F.col("id")]

    def update(self, state: dict, batch, epoch: int) -> dict:
        layers, squares = network_pass(*matrix_of(batch), state["layers"], self.learning_rate)
        return state | {"layers": layers, "squares": state["squares"] + squares}

    def close(self, state: dict, epoch: int) -> dict:
        return state | {"cost": state["squares"], "squares": 0.0}


class DeepNeuralNetwork:
    """A sigmoid network with topology (features, hidden ..., 1); ``probability`` is its output.

    One back-propagation update per row in the order of ids. One stream, the default, is the plain
    sequential rule on any number of rows: ranges of rows follow each other and hand the layers on. More
    ``streams`` are asked for by the caller: rows are dealt by a hash of their id, and each epoch averages
    what the streams learned, weighted by rows. ``start`` replaces the random weights that training begins with.
    """

    output = "probability"

    def __init__(self, topology: tuple[int, ...], options: NetworkOptions | None = None, streams: int = 1, start: Layers | None = None) -> None:
        if len(topology) < 2 or min(topology) < 1 or topology[-1] != 1:
            raise ValueError("a topology has at least two positive sizes and ends in 1")
        if streams < 1:
            raise ValueError("at least one stream is needed")
        self.topology = tuple(topology)
        self.options = options or NetworkOptions()
        self.streams, self.start = streams, start
        self.layers: Layers | None = None
        self.costs: tuple[float, ...] = ()

    def fit(self, train: DataFrame, on_epoch: EpochCallback | None = None, validated_features: int | None = None):
        self.layers = None
        d = validated_features or validate_training_table(train, caller=type(self).__name__).features
        if d != self.topology[0]:
            raise ValueError(f"the table has {d} features, the topology {self.topology[0]}")
        topology, costs = self.topology, []
        flat = flatten(self.start if self.start is not None else glorot_layers(topology, self.options.seed))
        rows = train.select("id", "features", "target")

        def closed(epoch: int, now: np.ndarray, squares: float, n: int) -> None:
            costs.append(squares / n)
            if not np.all(np.isfinite(now)):
                raise FloatingPointError(f"training diverged in epoch {epoch}")
            if on_epoch:
                on_epoch(epoch, costs[-1])

        flat = (self._chained if self.streams == 1 else self._averaged)(rows, flat, closed)
        self.layers, self.costs = unflatten(flat, topology), tuple(costs)
        return self

    def _chained(self, rows: DataFrame, flat: np.ndarray, closed) -> np.ndarray:
        kept = rows.persist()
        try:
            n = kept.count()
            learner = _NetworkRows(self.options.epochs, self.topology, self.options.learning_rate)
            start = {"layers": unflatten(flat, self.topology), "squares": 0.0, "cost": 0.0}
            report = lambda k, epoch, state: closed(epoch, flatten(state["layers"]), state["cost"], n)
            return flatten(travel(kept, [learner], [start], range_count(n, 1, 1), report)[0]["layers"])
        finally:
            kept.unpersist()

    def _averaged(self, rows: DataFrame, flat: np.ndarray, closed) -> np.ndarray:
        topology, lr, streams = self.topology, self.options.learning_rate, self.streams
        dealt, n = deal_rows(rows, streams)
        # Once, as every epoch has the same order. Rows that share an id have one too.
        ordered = dealt.sortWithinPartitions("stream", "id", "target", "features").persist()
        try:
            for epoch in range(self.options.epochs):

                def learn(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, flat=flat) -> np.ndarray:
                    return network_stream_states(x, y, unflatten(flat, topology), lr, lengths, streams > FEW_STREAMS)

                flat, squares = streams_average(ordered, learn, len(flat), streams, n)
                closed(epoch, flat, squares, n)
        finally:
            ordered.unpersist()
            dealt.unpersist()
        return flat

    def _require(self) -> Layers:
        if self.layers is None:
            raise NotFittedError("fit the network first")
        return self.layers

    def expression(self, features: Column, check: bool = True) -> Column:
        layers, d = self._require(), self.topology[0]

        @F.pandas_udf(T.DoubleType())
        def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield pd.Series(network_forward(np.stack(rows.to_numpy()), layers) if len(rows) else np.empty(0))

        return forward(checked(features, d) if check else features)

    def predict(self, df: DataFrame, check: bool = True) -> DataFrame:
        return df.withColumn(self.output, self.expression(F.col("features"), check))

    def predict_class(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict(df).withColumn("predicted", classify(F.col("probability"), threshold))

    def layers_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *w.shape, w.ravel().tolist(), b.tolist()) for k, (w, b) in enumerate(self._require())]
        return spark.createDataFrame(rows, "layer int, n_in int, n_out int, weights array<double>, bias array<double>")


class BasicNeuralNetwork(DeepNeuralNetwork):
    """One hidden layer; its input size follows the table."""

    def __init__(self, hidden_size: int, options: NetworkOptions | None = None, streams: int = 1, start: Layers | None = None) -> None:
        if hidden_size < 1:
            raise ValueError("the hidden layer needs at least one unit")
        super().__init__((1, hidden_size, 1), options, streams, start)

    def fit(self, train: DataFrame, on_epoch: EpochCallback | None = None, validated_features: int | None = None):
        self.layers = None
        d = validated_features or validate_training_table(train, caller=type(self).__name__).features
        self.topology = (d, *self.topology[1:])
        return super().fit(train, on_epoch, d)
