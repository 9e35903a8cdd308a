"""Feature scaling: one aggregate to fit, one projection to transform."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgrad.functions.vectors import affine, checked
from loomgrad.operators.merging import array_sums, count_with_parts, merged_states
from loomgrad.operators.validate import TableFacts, check_facts, fact_columns

KINDS = ("min_max", "mean", "z_score", "max_abs", "robust", "none")


@dataclass(frozen=True)
class FittedScaler:
    """Per feature: base + (x - centre) * factor / scale. Plain numbers, so it pickles and ships."""

    kind: str
    base: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    factor: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()

    def transform(self, df: DataFrame, check: bool = True) -> DataFrame:
        """``df`` with scaled features; no action, so it works on a stream too.

        With ``check``, a row with another number of features or a value that isn't finite is an error
        at run time.
        """
        if self.kind == "none":
            return df
        features = checked(F.col("features"), len(self.base)) if check else F.col("features")
        return df.withColumn("features", affine(features, self.base, self.centre, self.factor, self.scale))


def column_statistics(df: DataFrame, n_features: int, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """n, and per feature min, max, mean and population variance as arrays: one aggregate."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), *_statistics(n_features))


def _statistics(n_features: int) -> list[Column]:
    x = [F.get("features", F.lit(j)) for j in range(n_features)]  # null where a row is too short
    arrays = {
        "lows": [F.min(c) for c in x],
        "highs": [F.max(c) for c in x],
        "means": [F.avg(c) for c in x],
        "variances": [F.var_pop(c) for c in x],
    }
    return [F.array(*v).alias(k) for k, v in arrays.items()]


#: Bits of each of the two whole numbers that stand for a value in :func:`order_free_moments`.
WHOLE_BITS = 52


def _power_of_two_above(value: float) -> int:
    return min(max(math.frexp(value)[1], -900), 1024)


def _whole_sums(df: DataFrame, values: list[Column]) -> tuple[int, list[Fraction]]:
    """(rows, sums of ``values``), which lie between -1 and 1 and are cut at 2 * WHOLE_BITS bits: exact from there on."""
    step, sums = float(1 << WHOLE_BITS), [F.count(F.lit(1)).alias("n")]
    for j, value in enumerate(values):
        high = F.floor(value * step)
        sums += [F.sum(c.cast("decimal(20,0)")).alias(f"{k}{j}") for k, c in (("high", high), ("low", F.floor((value * step - high) * step)))]
    row = df.agg(*sums).first()
    return row["n"], [Fraction((int(row[f"high{j}"]) << WHOLE_BITS) + int(row[f"low{j}"]), 1 << 2 * WHOLE_BITS) for j in range(len(values))]


def order_free_moments(df: DataFrame, lows: list[float], highs: list[float], variances: list[float]) -> tuple[list[float], list[float]]:
    """(means, population variances), the same bits for any order of the rows, in two passes.

    Sums of doubles depend in their last bits on the order of additions, so on files, tasks and which of them
    ends first; sums of whole numbers don't. ``variances``, of any precision, stay where a range isn't finite.
    """
    spans, tops = [b - a for a, b in zip(lows, highs, strict=True)], [_power_of_two_above(max(abs(a), abs(b))) for a, b in zip(lows, highs, strict=True)]
    x = [F.get("features", F.lit(j)) for j in range(len(lows))]
    n, sums = _whole_sums(df, [c * 2.0**-t for c, t in zip(x, tops, strict=True)])
    means = [float(s / n * Fraction(2) ** t) for s, t in zip(sums, tops, strict=True)]
    finite = [j for j, span in enumerate(spans) if math.isfinite(span)]
    widths = {j: _power_of_two_above(spans[j]) for j in finite}
    shares = [(x[j] - means[j]) * 2.0 ** -widths[j] for j in finite]
    n, sums = _whole_sums(df, [u * u for u in shares])
    out = list(variances)
    for j, s in zip(finite, sums, strict=True):
        try:
            out[j] = float(s / n * Fraction(4) ** widths[j])
        except OverflowError:
            out[j] = math.inf
    return means, out


#: Bits that a pass over the rows tells apart, and values of a place that are few enough to be read.
DIGIT_BITS, FEW_VALUES = 11, 1000


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order: negative ones inverted, others above them. Both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _digit_counts(features: DataFrame, prefixes: list[np.ndarray], known: int, bits: int, parts: int) -> np.ndarray:
    """(prefix, digit) counts, prefixes of all features in turn: how the values that begin with each prefix go on."""
    starts, size = np.cumsum([0, *map(len, prefixes)]), 1 << bits

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(int(starts[-1]) * size, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            u = ordered_bits(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            for j, known_prefixes in enumerate(prefixes):
                if not len(known_prefixes):
                    continue
                head = u[:, j] >> np.uint64(64 - known) if known else np.zeros(len(u), dtype=np.uint64)
                at = np.minimum(np.searchsorted(known_prefixes, head), len(known_prefixes) - 1)
                mine = known_prefixes[at] == head
                digit = (u[mine, j] >> np.uint64(64 - known - bits)) & np.uint64(size - 1)
                counts[starts[j] * size : starts[j + 1] * size] += np.bincount(at[mine] * size + digit.astype(np.int64), minlength=len(known_prefixes) * size)
        return counts

    return array_sums(features, work, int(starts[-1]) * size, np.int64, parts).reshape(-1, size)


def exact_percentiles(df: DataFrame, shares: tuple[float, ...], n_features: int, stored: bool = False) -> list[list[float]]:
    """Feature -> interpolated percentiles at position share * (n - 1), for any number of rows.

    Radix selection: counts of leading bits tell in which range a rank lies, and the next pass tells the
    values of that range apart, for all features and shares at once. Once a range holds few values they are
    read. Two to six passes over stored features; no row is shuffled, and the driver gets counts only. Equal
    to ``percentile``, whose one buffer a feature grows with the distinct values. ``stored``: ``df`` is persisted.
    """
    features = df.select("features")
    if not stored:
        features.persist()
    try:
        n, parts = count_with_parts(features)
        ranks = sorted({f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)})
        # (feature, rank) -> (prefix, rank among the values with that prefix)
        places = {(j, r): (0, r) for j in range(n_features) for r in ranks}
        known, found = 0, {}
        while places and known < 64:
            bits = min(DIGIT_BITS, 64 - known)
            prefixes = [np.array(sorted({p for (k, _), (p, _) in places.items() if k == j}), dtype=np.uint64) for j in range(n_features)]
            counts, row = _digit_counts(features, prefixes, known, bits, parts), 0
            known, sizes, after = known + bits, {}, {}
            below = {}
            for j, of in enumerate(prefixes):
                for p in of.tolist():
                    below[j, p], row = (np.cumsum(counts[row]), counts[row]), row + 1
            for (j, r), (p, rank) in places.items():
                upto, here = below[j, p]
                digit = int(np.searchsorted(upto, rank, side="right"))
                after[j, r] = (p << bits | digit, rank - int(upto[digit] - here[digit]))
                sizes[j, r] = int(here[digit])
            places = after
            if known < 64 and max(sizes.values()) <= FEW_VALUES:
                found = _values_below(features, places, known, parts)
                places = {}
        for key, (p, _) in places.items():  # all bits are known
            bits = np.array([p], dtype=np.uint64)
            found[key] = float(np.where(bits >> np.uint64(63) == 1, bits ^ np.uint64(1 << 63), ~bits).view(np.float64)[0])
    finally:
        if not stored:
            features.unpersist()
    out = []
    for j in range(n_features):
        at = [(q * (n - 1), found[j, math.floor(q * (n - 1))], found[j, math.ceil(q * (n - 1))]) for q in shares]
        out.append([low + (place - math.floor(place)) * (high - low) for place, low, high in at])
    return out


def _values_below(features: DataFrame, places: dict, known: int, parts: int) -> dict[tuple[int, int], float]:
    """The values at ``places``, whose prefixes have FEW_VALUES values each at most, which are read."""
    wanted: dict[int, np.ndarray] = {}
    for (j, _), (p, _) in places.items():
        wanted[j] = np.unique(np.append(wanted.get(j, np.empty(0, dtype=np.uint64)), np.uint64(p)))

    def work(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        out = []
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for j, prefixes in wanted.items():
                    mine = x[np.isin(ordered_bits(x[:, j]) >> np.uint64(64 - known), prefixes), j]
                    out.append(np.column_stack([np.full(len(mine), float(j)), mine]))
        return np.concatenate(out).tobytes() if out else None

    states = merged_states(features, work, lambda a, b: a + b, parts)
    rows = np.concatenate([np.frombuffer(s).reshape(-1, 2) for s in states])
    by_feature = {j: np.sort(rows[rows[:, 0] == j, 1]) for j in wanted}
    heads = {j: ordered_bits(x) >> np.uint64(64 - known) for j, x in by_feature.items()}
    return {(j, r): float(by_feature[j][heads[j] == np.uint64(p)][rank]) for (j, r), (p, rank) in places.items()}


@dataclass(frozen=True)
class Scaler:
    """A scaling rule. ``fit`` reads training rows only and returns a :class:`FittedScaler`.

    min_max: to [target_min, target_max], a constant feature to the middle. mean: by mean and range, a
    constant feature to 0. z_score: population deviation. max_abs. robust: median and interquartile
    range. In the last three a zero divisor counts as 1. none: as it is.
    ``percentiles`` (robust): 'exact' for radix selection, on any size ('distributed' means the same),
    'approx' for Spark's approximate percentiles, which don't interpolate. ``order_free`` (mean, z_score): no order
    of the rows changes the last bits of means and deviations, for learners that amplify them; two more passes.
    """

    kind: str = "z_score"
    target_min: float = 0.0
    target_max: float = 1.0
    percentiles: str = "exact"
    order_free: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown scaler {self.kind!r}")
        width = self.target_max - self.target_min
        if not (math.isfinite(self.target_min) and math.isfinite(self.target_max) and math.isfinite(width)) or width <= 0:
            raise ValueError("the target range must be finite and wider than 0")
        if self.percentiles not in ("exact", "distributed", "approx"):
            raise ValueError(f"unknown percentile method {self.percentiles!r}")

    def fit(self, train: DataFrame, validated_features: int | None = None) -> FittedScaler:
        """``validated_features``: their number, if the caller has validated the table already."""
        if self.kind == "none":
            return FittedScaler("none")
        if not validated_features:
            return self.fit_checked(train, caller=f"{self.kind} scaler")[1]
        if self.kind == "robust":
            return self._fit_robust(train, validated_features)
        return self._from_row(train, train.agg(*self._columns(validated_features)).first(), validated_features)

    def fit_checked(self, train: DataFrame, binary: bool = False, caller: str = "fit") -> tuple[TableFacts, FittedScaler]:
        """The facts of a table that is fit for training, and the scaler: checks and statistics in one pass.

        The number of features is that of any one row; if others differ, the pass tells.
        """
        if self.kind != "robust":
            return self._fit_checked(train, binary, caller)
        stored = train.select("features", "target").persist()  # percentiles take some passes
        try:
            return self._fit_checked(stored, binary, caller)
        finally:
            stored.unpersist()

    def _fit_checked(self, train: DataFrame, binary: bool, caller: str) -> tuple[TableFacts, FittedScaler]:
        some = train.select(F.size("features").alias("d")).head()
        columns = self._columns(some["d"]) if some and (some["d"] or 0) > 0 else []
        row = train.agg(*fact_columns(), *columns).first()
        facts = check_facts(row, binary, caller)
        return facts, self._fit_robust(train, facts.features, True) if self.kind == "robust" else self._from_row(train, row, facts.features)

    def _columns(self, d: int) -> list[Column]:
        if self.kind == "max_abs":
            return [F.array(*[F.max(F.abs(F.get("features", F.lit(j)))) for j in range(d)]).alias("tops")]
        return _statistics(d) if self.kind in ("min_max", "mean", "z_score") else []

    def _from_row(self, train: DataFrame, row: Row, d: int) -> FittedScaler:
        if self.kind == "none":
            return FittedScaler("none")
        if self.kind == "max_abs":
            return self._scaler([0.0] * d, [m or 1.0 for m in row["tops"]])
        means, variances = row["means"], row["variances"]
        if self.order_free and self.kind in ("mean", "z_score"):
            means, variances = order_free_moments(train, row["lows"], row["highs"], variances)
        return self.from_statistics(row["lows"], row["highs"], means, variances)

    def from_statistics(self, lows: list[float], highs: list[float], means: list[float], variances: list[float]) -> FittedScaler:
        constant = [a == b for a, b in zip(lows, highs, strict=True)]
        ranges = [1.0 if c else b - a for a, b, c in zip(lows, highs, constant, strict=True)]
        if self.kind == "min_max":
            width = self.target_max - self.target_min
            return self._scaler(
                lows, ranges, [0.0 if c else width for c in constant], [self.target_min + width / 2 if c else self.target_min for c in constant]
            )
        if self.kind == "mean":
            return self._scaler(means, ranges, [0.0 if c else 1.0 for c in constant])
        if self.kind == "z_score":
            return self._scaler(means, [1.0 if c or v == 0 else math.sqrt(v) for v, c in zip(variances, constant, strict=True)])
        raise ValueError(f"{self.kind} doesn't follow from column statistics")

    def _fit_robust(self, train: DataFrame, d: int, stored: bool = False) -> FittedScaler:
        shares = (0.25, 0.5, 0.75)
        if self.percentiles == "approx":
            quartiles = train.agg(F.array(*[F.percentile_approx(F.col("features")[j], list(shares)) for j in range(d)])).first()[0]
        else:
            quartiles = exact_percentiles(train, shares, d, stored)
        return self._scaler([q[1] for q in quartiles], [(q[2] - q[0]) or 1.0 for q in quartiles])

    def _scaler(self, centre, scale, factor=None, base=None) -> FittedScaler:
        d = len(centre)
        return FittedScaler(self.kind, tuple(base or [0.0] * d), tuple(centre), tuple(factor or [1.0] * d), tuple(scale))


def training_statistics_per_fold(folded: DataFrame, n_features: int) -> DataFrame:
    """One row per eval_fold: n, lows, highs, means, variances of the rows of the *other* folds.

    One aggregate per fold, then the others' partial results are merged by the parallel-variance
    formula; raw sums of squares are never subtracted. k * d numbers, so the driver merges them.
    """
    parts = column_statistics(folded, n_features, ("fold",)).collect()
    rows = []
    for held in sorted(p["fold"] for p in parts):
        n, low, high, mean, m2 = 0, None, None, None, None
        for p in (p for p in parts if p["fold"] != held):
            if n == 0:
                n, low, high, mean = p["n"], list(p["lows"]), list(p["highs"]), list(p["means"])
                m2 = [v * n for v in p["variances"]]
                continue
            total = n + p["n"]
            for j in range(n_features):
                delta = p["means"][j] - mean[j]
                m2[j] += p["variances"][j] * p["n"] + delta * delta * n * p["n"] / total
                mean[j] += delta * p["n"] / total
                low[j], high[j] = min(low[j], p["lows"][j]), max(high[j], p["highs"][j])
            n = total
        if n:
            rows.append((held, n, low, high, mean, [v / n for v in m2]))
    schema = "eval_fold int, n long, lows array<double>, highs array<double>, means array<double>, variances array<double>"
    return folded.sparkSession.createDataFrame(rows, schema)
