"""Cross-validation: stratified folds, statistics and models per fold, metrics and their summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrad.functions.kernels import (
    flatten,
    glorot_layers,
    gradient_sums,
    logistic,
    logistic_streams_pass,
    network_forward,
    network_streams_pass,
    row_by_row_pass,
    stack,
    stacked_logistic_pass,
    stacked_network_pass,
    unflatten,
    unstack,
)
from loomgrad.functions.metrics import METRIC_COLUMNS, binary_metrics, fold_summary
from loomgrad.operators.chain import range_count, travel
from loomgrad.operators.merging import array_sums, count_with_parts
from loomgrad.operators.scaling import Scaler, training_statistics_per_fold
from loomgrad.operators.splits import order_key, stratified_kfold, test_of, train_of, training_views
from loomgrad.operators.training import deal_rows, matrix_of, stream_lengths
from loomgrad.operators.validate import validate_training_table
from loomgrad.session import settled


def scaled_views(folded: DataFrame, n_features: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """(training rows per eval_fold, test rows per eval_fold), Z-scored by training rows of the fold only.

    The statistics are folds * features numbers; they come back by a join on the fold.
    """
    statistics = training_statistics_per_fold(folded, n_features).collect()
    scaler = Scaler("z_score")
    rows = []
    for s in statistics:
        fitted = scaler.from_statistics(s["lows"], s["highs"], s["means"], s["variances"])
        rows.append((s["eval_fold"], list(fitted.centre), list(fitted.scale)))
    table = folded.sparkSession.createDataFrame(rows, "eval_fold int, centre array<double>, scale array<double>")

    def scaled(df: DataFrame) -> DataFrame:
        z = F.array(*[(F.col("features")[j] - F.col("centre")[j]) / F.col("scale")[j] for j in range(n_features)])
        return df.join(F.broadcast(table), "eval_fold").withColumn("features", z).drop("centre", "scale")  # one row a fold

    return scaled(training_views(folded, folds)), scaled(folded.withColumn("eval_fold", F.col("fold")))


# --- many models side by side -----------------------------------------------------------------


class Learner(Protocol):
    """A model that trains by additive contributions of partitions, one round an epoch.

    A ``sequential`` one updates after each row, so its contributions are those of streams; it also has
    :class:`SequentialLearner`'s exact form.
    """

    epochs: int
    sequential: bool

    def start(self, d: int) -> np.ndarray:
        """The parameters before the first epoch."""

    def contribute(self, place: np.ndarray, x: np.ndarray, y: np.ndarray, streams: np.ndarray, flat: np.ndarray, epoch: int) -> np.ndarray:
        """What some rows, sorted by stream and id, add to the epoch; ``place`` sorts them into its order, for sequential learners."""

    def finish(self, total: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
        """The parameters after the epoch, from the contributions of all ``n`` training rows."""

    def score(self, x: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Probabilities."""


class SequentialLearner(Learner, Protocol):
    """A model that learns row by row; several of one kind, say those of all folds, learn side by side."""

    def order(self, epoch: int):
        """See :class:`~loomgrad.operators.chain.Traveller`."""

    def sort_columns(self, epoch: int) -> list[Column]:
        """See :class:`~loomgrad.operators.chain.Traveller`."""

    def learn(self, x: np.ndarray, y: np.ndarray, mine: np.ndarray, flats: np.ndarray, epoch: int) -> np.ndarray:
        """The parameters (models, width) after rows ``x`` (models, rows, features), of which each model takes ``mine``."""


@dataclass(frozen=True)
class BatchLogistic:
    """All rows per update."""

    learning_rate: float
    epochs: int
    sequential: ClassVar[bool] = False

    def start(self, d: int) -> np.ndarray:
        return np.zeros(d + 1)

    def contribute(self, place, x, y, streams, flat, epoch) -> np.ndarray:
        return gradient_sums(x, y, flat[:-1], float(flat[-1]), logistic)[:-1]

    def finish(self, total, flat, n) -> np.ndarray:
        return flat - self.learning_rate / n * total

    def score(self, x, flat) -> np.ndarray:
        return logistic(x, flat[:-1], float(flat[-1]))


@dataclass(frozen=True)
class StochasticLogistic(BatchLogistic):
    """One update per row in each stream, in an order of its own each epoch; streams are averaged by rows."""

    seed: int = 42
    decay: float = 0.0
    sequential: ClassVar[bool] = True

    def order(self, epoch):
        return "key", self.seed, epoch

    def sort_columns(self, epoch):
        return [order_key(self.seed, epoch), F.col("id")]

    def learn(self, x, y, mine, flats, epoch):
        flats = flats.copy()
        stacked_logistic_pass(x, y, mine, flats, self.learning_rate / (1 + self.decay * epoch))
        return flats

    def contribute(self, place, x, y, streams, flat, epoch) -> np.ndarray:
        order, lr, lengths = np.lexsort((place, streams)), self.learning_rate / (1 + self.decay * epoch), stream_lengths(streams)
        w, b = flat[:-1], float(flat[-1])
        if len(lengths) > 1:
            return logistic_streams_pass(x[order], y[order], w, b, lengths, lr, 0.0, False)[0]
        got, bias, _ = row_by_row_pass(x[order], y[order], w, b, "logistic", lr, 0.0, False)
        return len(y) * np.append(got, bias)

    def finish(self, total, flat, n) -> np.ndarray:
        return total / n


@dataclass(frozen=True)
class SigmoidNetwork:
    """One back-propagation update per row in each stream, in the order of ids; streams are averaged by rows."""

    hidden: tuple[int, ...]
    learning_rate: float
    epochs: int
    seed: int = 42
    sequential: ClassVar[bool] = True

    def order(self, epoch):
        return "id"

    def sort_columns(self, epoch):
        return [F.col("id")]

    def learn(self, x, y, mine, flats, epoch):
        topology = self._topology(x.shape[2])
        layers = stack([unflatten(flat, topology) for flat in flats])
        stacked_network_pass(x, y, mine, layers, self.learning_rate)
        return np.stack([flatten(one) for one in unstack(layers)])

    def _topology(self, d: int) -> tuple[int, ...]:
        return (d, *self.hidden, 1)

    def start(self, d: int) -> np.ndarray:
        return flatten(glorot_layers(self._topology(d), self.seed))

    def contribute(self, place, x, y, streams, flat, epoch) -> np.ndarray:
        layers = unflatten(flat, self._topology(x.shape[1]))
        return len(y) * flatten(network_streams_pass(x, y, layers, self.learning_rate, stream_lengths(streams))[0])

    def finish(self, total, flat, n) -> np.ndarray:
        return total / n

    def score(self, x, flat) -> np.ndarray:
        return network_forward(x, unflatten(flat, self._topology(x.shape[1])))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _ranks(keys: pa.StructArray) -> np.ndarray:
    """The place of each row in the order of its keys."""
    table = pa.Table.from_arrays(keys.flatten(), names=[f"k{i}" for i in range(keys.type.num_fields)])
    out = np.empty(len(keys), dtype=np.int64)
    out[pc.sort_indices(table, [(name, "ascending") for name in table.column_names]).to_numpy()] = np.arange(len(keys))
    return out


#: Fold -> (centre, scale) of its training rows.
Scales = dict[int, tuple[np.ndarray, np.ndarray]]


def train_side_by_side(
    dealt: DataFrame, scales: Scales, n_train: Mapping[int, int], learners: Mapping[str, Learner], parts: int | None = None
) -> dict[tuple[str, int], np.ndarray]:
    """(model, fold) -> parameters: every model on the rows of the other folds, scaled by the statistics of those.

    All models of all folds train in the same job, one an epoch: a task passes over its own rows only and
    returns one array, so no fold is copied or shuffled. A task holds one Arrow batch, or its streams if a
    learner is sequential. ``dealt``: rows with ``fold`` and ``stream``, for sequential learners those of
    :func:`~loomgrad.operators.training.deal_rows`, sorted by stream and id. ``parts``: the number of partitions, if known.
    """
    d = len(next(iter(scales.values()))[0])
    now = {(name, held): learner.start(d) for name, learner in learners.items() for held in scales}
    for epoch in range(max(learner.epochs for learner in learners.values())):
        going = {key: flat for key, flat in now.items() if epoch < learners[key[0]].epochs}
        sizes = [len(flat) for flat in going.values()]
        at = dict(zip(going, np.cumsum(sizes) - sizes, strict=True))

        # The keys of an epoch's order are columns: md5 in the JVM, once for all learners that share it.
        orders = {learners[name].order(epoch): learners[name] for name, _ in going if learners[name].sequential}
        keys = {f"key{i}": F.struct(*learner.sort_columns(epoch)) for i, learner in enumerate(orders.values())}
        column_of = dict(zip(orders, keys, strict=True))

        def work(batches: Iterator[pa.RecordBatch], going=going, at=at, width=sum(sizes), epoch=epoch, column_of=column_of) -> np.ndarray:
            total = np.zeros(width)
            whole = (b for b in batches if b.num_rows)
            if column_of:  # streams need their rows together
                found = list(whole)
                whole = [pa.Table.from_batches(found).combine_chunks().to_batches()[0]] if found else []
            for b in whole:
                (x, y), streams, fold = matrix_of(b), *(_column(b, c) for c in ("stream", "fold"))
                places = {name: _ranks(b.column(b.schema.get_field_index(c))) for name, c in column_of.items()}
                for held, (centre, scale) in scales.items():
                    mine = fold != held
                    if not mine.any():
                        continue
                    z = (x[mine] - centre) / scale
                    for (name, of), flat in going.items():
                        if of == held:
                            learner = learners[name]
                            place = places[learner.order(epoch)][mine] if learner.sequential else np.arange(int(mine.sum()))
                            total[at[name, of] : at[name, of] + len(flat)] += learner.contribute(place, z, y[mine], streams[mine], flat, epoch)
            return total

        columns = [F.col(c) for c in ("stream", "fold", "features", "target")] + [c.alias(k) for k, c in keys.items()]
        total = array_sums(dealt.select(*columns), work, sum(sizes), parts=parts)
        for (name, held), flat in going.items():
            start = at[name, held]
            after = learners[name].finish(total[start : start + len(flat)], flat, n_train[held])
            if not np.all(np.isfinite(after)):
                raise FloatingPointError(f"{name}, fold {held}: training diverged in epoch {epoch}")
            now[name, held] = after
    return now


#: Numbers that the scaled views of a run of rows take at most.
VIEW_NUMBERS = 2_000_000


@dataclass(frozen=True)
class _FoldsOf:
    """The models of all folds of one learner, as one learner that travels over ranges."""

    learner: SequentialLearner
    scales: Scales

    @property
    def epochs(self) -> int:
        return self.learner.epochs

    def order(self, epoch: int):
        return self.learner.order(epoch)

    def sort_columns(self, epoch: int) -> list[Column]:
        return self.learner.sort_columns(epoch)

    def update(self, flats: np.ndarray, batch: pa.RecordBatch, epoch: int) -> np.ndarray:
        (x, y), fold = matrix_of(batch), _column(batch, "fold")
        centres, scales = (np.stack([s[i] for s in self.scales.values()])[:, None, :] for i in range(2))
        mine = fold != np.array(list(self.scales))[:, None]
        step = max(1, VIEW_NUMBERS // (len(self.scales) * x.shape[1]))
        for at in range(0, len(y), step):
            rows = slice(at, at + step)
            flats = self.learner.learn((x[rows] - centres) / scales, y[rows], mine[:, rows], flats, epoch)
        return flats

    def close(self, flats: np.ndarray, epoch: int) -> np.ndarray:
        return flats


def train_in_waves(folded: DataFrame, n: int, scales: Scales, learners: Mapping[str, SequentialLearner]) -> dict[tuple[str, int], np.ndarray]:
    """(model, fold) -> parameters: every model by its own sequential rule, whatever the number of rows.

    Learners follow each other over ranges of rows (see :mod:`~loomgrad.operators.chain`), the models of all
    folds of a learner side by side. ``folded``: persisted rows with ``fold``, ``n`` of them. No task holds
    more than one learner's parameters and one batch of rows while there are as many ranges as learners.
    """
    d, names = len(next(iter(scales.values()))[0]), list(learners)

    def closed(k: int, epoch: int, flats: np.ndarray) -> None:
        if not np.all(np.isfinite(flats)):
            raise FloatingPointError(f"{names[k]}: training diverged in epoch {epoch}")

    start = [np.stack([learners[name].start(d)] * len(scales)) for name in names]
    parts = range_count(n, len(names), folded.sparkSession.sparkContext.defaultParallelism)
    found = travel(folded, [_FoldsOf(learners[name], scales) for name in names], start, parts, closed)
    return {(name, held): flats[i] for name, flats in zip(names, found, strict=True) for i, held in enumerate(scales)}


def score_side_by_side(folded: DataFrame, scales: Scales, parameters: Mapping[tuple[str, int], np.ndarray], learners: Mapping[str, Learner]) -> DataFrame:
    """model, eval_fold, id, target, probability: each row scored by the models that haven't seen its fold."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (x, y), ids, fold = matrix_of(b), _column(b, "id"), _column(b, "fold")
            for held, (centre, scale) in scales.items():
                mine = fold == held
                z = (x[mine] - centre) / scale
                for name, learner in learners.items() if mine.any() else ():
                    p = learner.score(z, parameters[name, held])
                    columns = [pa.array([name] * len(p)), pa.array(np.full(len(p), held, dtype=np.int32)), *map(pa.array, (ids[mine], y[mine], p))]
                    yield pa.RecordBatch.from_arrays(columns, names=["model", "eval_fold", "id", "target", "probability"])

    rows = folded.select("id", "fold", "features", "target")
    return rows.mapInArrow(per_batch, "model string, eval_fold int, id long, target double, probability double")


def cross_validate(
    df: DataFrame, learners: Mapping[str, Learner], folds: int = 5, seed: int = 42, streams: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(metrics per model and fold, mean and sample deviation per model).

    Folds are stratified; each fold's rows are scored by models, and scaled by statistics, that have
    seen the other folds only. Sequential learners follow their exact rule, or run in several ``streams``
    if asked, see :class:`~loomgrad.operators.training.StochasticGradientDescent`; batch learners take one
    job an epoch.
    """
    facts = validate_training_table(df, binary=True, caller="cross_validate")
    folded = stratified_kfold(df.select("id", "features", "target"), folds, seed).persist()
    scaler, scales = Scaler("z_score"), {}
    for r in training_statistics_per_fold(folded, facts.features).collect():
        fitted = scaler.from_statistics(r["lows"], r["highs"], r["means"], r["variances"])
        scales[r["eval_fold"]] = (np.array(fitted.centre), np.array(fitted.scale))
    counts = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    n_train = {held: sum(counts.values()) - counts[held] for held in counts}
    sequential = {name: learner for name, learner in learners.items() if learner.sequential}
    others = {name: learner for name, learner in learners.items() if not learner.sequential}
    parameters: dict[tuple[str, int], np.ndarray] = {}
    if others:
        parts = count_with_parts(folded)[1]
        parameters |= train_side_by_side(folded.withColumn("stream", F.lit(0)), scales, n_train, others, parts)
    if sequential and streams == 1:
        parameters |= train_in_waves(folded, facts.rows, scales, sequential)
    elif sequential:
        dealt, _ = deal_rows(folded, streams)
        ordered = dealt.sortWithinPartitions("stream", "id").persist()
        try:
            parameters |= train_side_by_side(ordered, scales, n_train, sequential)
        finally:
            ordered.unpersist()
            dealt.unpersist()
    per_fold = settled(binary_metrics(score_side_by_side(folded, scales, parameters, learners), group_cols=("model", "eval_fold")))
    folded.unpersist()
    return per_fold, fold_summary(per_fold)


def cross_validate_distributed(
    df: DataFrame, factories: Mapping[str, Callable[[], object]], folds: int = 5, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """As :func:`cross_validate` with model factories (zero arguments, a fresh model with fit and predict).

    Each model trains distributed on all rows of the other folds, so a fold may have any size.
    """
    facts = validate_training_table(df, binary=True, caller="cross_validate")
    folded = stratified_kfold(df.select("id", "features", "target"), folds, seed).persist()
    statistics = {r["eval_fold"]: r for r in training_statistics_per_fold(folded, facts.features).collect()}
    per_fold = None
    for held in range(folds):
        s = statistics[held]
        scaler = Scaler("z_score").from_statistics(s["lows"], s["highs"], s["means"], s["variances"])
        train, test = scaler.transform(train_of(folded, held), check=False), scaler.transform(test_of(folded, held), check=False)
        for name, factory in factories.items():
            model = factory().fit(train, validated_features=facts.features)
            row = binary_metrics(model.predict(test)).select(F.lit(name).alias("model"), F.lit(held).alias("eval_fold"), *METRIC_COLUMNS)
            per_fold = row if per_fold is None else per_fold.unionByName(row)
    per_fold = settled(per_fold)
    folded.unpersist()
    return per_fold, fold_summary(per_fold)
