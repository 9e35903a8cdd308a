"""Sequential learners on ordered ranges of rows: rows stay where they are, parameters travel.

The rows of an epoch are sorted into ranges. A learner works through them in order, one task a range, and hands
its state on; a task streams Arrow batches, so it holds one batch and the states, never the range. Several
learners follow each other like a wave: while one works on range r, the next works on range r - 1. The result is
that of one loop over all rows, on any number of rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range, about; its sort is one task's, and spills.
RANGE_ROWS = 1_000_000
#: Ranges at most, as each step looks at all of them: beyond, they get longer.
MOST_RANGES = 1000


class Traveller(Protocol):
    """A learner that goes through the rows of each epoch in order."""

    epochs: int

    def order(self, epoch: int) -> Hashable:
        """What names the order of an epoch: epochs with equal names share their sorted rows."""

    def sort_columns(self, epoch: int) -> list[Column]:
        """The columns that sort the rows of an epoch."""

    def update(self, state: Any, batch: pa.RecordBatch, epoch: int) -> Any:
        """The state after the rows of a batch, which follow those before. It may keep rows for the next batch."""

    def close(self, state: Any, epoch: int) -> Any:
        """The state after the last row of an epoch."""


@dataclass
class Ranges:
    """Rows sorted into ``parts`` ranges, kept; ``part`` is the number of a row's range."""

    rows: DataFrame
    parts: int

    @staticmethod
    def of(rows: DataFrame, by: list[Column], parts: int) -> Ranges:
        named = rows.withColumns({f"_lg_by{i}": c for i, c in enumerate(by)})
        keys = [f"_lg_by{i}" for i in range(len(by))]
        dealt = (named.repartitionByRange(parts, *keys) if parts > 1 else named.repartition(1)).sortWithinPartitions(*keys)
        return Ranges(dealt.drop(*keys).withColumn("part", F.spark_partition_id()).persist(), parts)


@dataclass
class _Place:
    """How far a learner has come."""

    state: Any
    epoch: int = 0
    part: int = 0


def _work(units: dict[int, list[tuple[int, Traveller, Any, int]]]):
    """part -> (number, learner, state, epoch) of those that work on it; gives (number, state)."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            if batch.num_rows:
                if here is None:
                    part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
                    here = [list(u) for u in units.get(part, [])]
                for unit in here:
                    unit[2] = unit[1].update(unit[2], batch, unit[3])
        if here:
            columns = [pa.array([u[0] for u in here], pa.int32()), pa.array([pickle.dumps(u[2]) for u in here], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "state"])

    return per_partition


def range_count(n: int, learners: int, cores: int) -> int:
    """Ranges of about RANGE_ROWS rows, MOST_RANGES at most, and enough for learners to work side by side."""
    return max(1, min(math.ceil(n / RANGE_ROWS), MOST_RANGES), min(learners, cores, n))


def travel(
    rows: DataFrame,
    learners: Sequence[Traveller],
    states: Sequence[Any],
    parts: int,
    on_epoch: Callable[[int, int, Any], None] | None = None,
) -> list[Any]:
    """The states of ``learners`` after all their epochs over ``rows``, sorted into ``parts`` ranges.

    A step is one job: each learner under way works on its own range, behind the one before it, and at most
    ``parts`` are under way. ``on_epoch(number, epoch, state)`` is called as a learner closes an epoch. Sorted
    rows are kept while a learner still needs their order.
    """
    places, sorted_rows, waiting, under_way = [_Place(s) for s in states], {}, list(range(len(learners))), []
    try:
        while waiting or under_way:
            taken = {(learners[k].order(places[k].epoch), places[k].part) for k in under_way}
            if waiting and len(under_way) < parts and (learners[waiting[0]].order(0), 0) not in taken:
                under_way.append(waiting.pop(0))
            units: dict[Hashable, dict[int, list]] = {}
            for k in under_way:
                learner, at = learners[k], places[k]
                name = learner.order(at.epoch)
                if name not in sorted_rows:
                    sorted_rows[name] = Ranges.of(rows, learner.sort_columns(at.epoch), parts)
                units.setdefault(name, {}).setdefault(at.part, []).append((k, learner, at.state, at.epoch))
            step = None
            for name, by_part in units.items():
                active = sorted_rows[name].rows.filter(F.col("part").isin(list(by_part)))
                worked = active.mapInArrow(_work(by_part), "k int, state binary")
                step = worked if step is None else step.unionByName(worked)
            for r in step.collect():  # a state for each learner under way
                places[r["k"]].state = pickle.loads(bytes(r["state"]))
            for k in list(under_way):
                at = places[k]
                at.part += 1
                if at.part == parts:
                    at.state = learners[k].close(at.state, at.epoch)
                    if on_epoch:
                        on_epoch(k, at.epoch, at.state)
                    at.epoch, at.part = at.epoch + 1, 0
                    if at.epoch == learners[k].epochs:
                        under_way.remove(k)
            needed = {learners[k].order(e) for k in [*under_way, *waiting] for e in range(places[k].epoch, learners[k].epochs)}
            for name in [name for name in sorted_rows if name not in needed]:
                sorted_rows.pop(name).rows.unpersist()
    finally:
        for kept in sorted_rows.values():
            kept.rows.unpersist()
    return [at.state for at in places]
