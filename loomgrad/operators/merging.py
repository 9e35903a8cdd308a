"""What tasks have worked out, merged in executors before it reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that reach the driver at most, however many tasks there are.
GROUPS = 64
#: Numbers that these states hold together, about.
DRIVER_NUMBERS = 8_000_000


def _states(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    grp, part, state = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(part, pa.int32()), pa.array(state, pa.binary())], names=["grp", "part", "state"])


_SCHEMA = "grp int, part int, state binary"


def merged_states(
    rows: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], bytes | None],
    combine: Callable[[bytes, bytes], bytes],
    parts: int | None = None,
    groups: int = GROUPS,
) -> list[bytes]:
    """At most ``groups`` states: ``work`` makes one of each partition, ``combine`` merges those of a group in executors.

    States merge in the order of their partitions, so sums don't depend on which task ends first. With
    ``parts``, the number of partitions, groups are runs of partitions and the list keeps their order, as
    ``combine`` that doesn't commute needs; up to ``groups`` partitions nothing is left to merge. Without it,
    groups are dealt round.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = work(batches), TaskContext.get().partitionId()
        if state is not None:
            yield _states([(part % groups if parts is None else part * groups // parts, part, state)])

    return _merged(rows.mapInArrow(made, _SCHEMA), combine, parts is None or parts > groups)


def _merged(states: DataFrame, combine: Callable[[bytes, bytes], bytes], several: bool) -> list[bytes]:
    """The states of groups, each merged in order if there are ``several`` in one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, b""
        for batch in batches:
            for k in range(batch.num_rows):
                grp, value = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if grp == now:
                    state = combine(state, value)
                    continue
                if now is not None:
                    yield _states([(now, 0, state)])
                now, state = grp, value
        if now is not None:
            yield _states([(now, 0, state)])

    if several:
        states = states.repartition("grp").sortWithinPartitions("grp", "part").mapInArrow(merge, _SCHEMA)
    return [bytes(r["state"]) for r in sorted(states.collect(), key=lambda r: (r["grp"], r["part"]))]


def _adder(kind: type) -> Callable[[bytes, bytes], bytes]:
    return lambda a, b: (np.frombuffer(a, dtype=kind) + np.frombuffer(b, dtype=kind)).tobytes()


def numbered_sums(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], width: int, count: int) -> np.ndarray:
    """The sum of arrays of ``width`` doubles that ``work`` makes, each with a number under ``count`` of its own.

    They are added in the order of their numbers, in groups that are runs of numbers. So the sum is the same
    bits wherever they were made, whereas :func:`array_sums` has one array a partition and adds those.
    """
    groups = max(1, min(GROUPS, DRIVER_NUMBERS // width))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, found in work(batches):
            yield _states([(number * groups // count if count > groups else number, number, found.tobytes())])

    out = np.zeros(width)
    for state in _merged(rows.mapInArrow(made, _SCHEMA), _adder(np.float64), count > groups):
        out += np.frombuffer(state)
    return out


def array_sums(
    rows: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
    width: int,
    kind: type = np.float64,
    parts: int | None = None,
) -> np.ndarray:
    """The sum of the arrays of ``width`` numbers that ``work`` makes of each partition; wide ones merge into fewer."""

    out = np.zeros(width, dtype=kind)
    groups = max(1, min(GROUPS, DRIVER_NUMBERS // width))
    for state in merged_states(rows, lambda batches: work(batches).astype(kind, copy=False).tobytes(), _adder(kind), parts, groups):
        out += np.frombuffer(state, dtype=kind)
    return out


def count_with_parts(stored: DataFrame) -> tuple[int, int]:
    """(rows, partitions) of a persisted table, of which it keeps the number: one more than the last that has rows."""
    got = stored.select(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).first()
    return got["n"], (got["last"] or 0) + 1
