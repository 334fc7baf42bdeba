"""Aggregates of one's own whose state is small and can be merged: no group is ever in one worker."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task holds before it hands them on.
GROUPS = 10_000
#: Parts in which the states of a group are merged before they meet in one task.
FAN = 32


class Mergeable:
    """What an aggregate has to say. Values are numpy doubles without nulls; a state is bytes when it travels."""

    #: Result columns, as DDL.
    result = ""

    def zero(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, values: np.ndarray) -> Any:
        raise NotImplementedError

    def merge(self, state: Any, other: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> tuple:
        raise NotImplementedError

    def dump(self, state: Any) -> bytes:
        raise NotImplementedError

    def load(self, data: bytes) -> Any:
        raise NotImplementedError


class Spread(Mergeable):
    """The greatest value less the least; null without values."""

    result = "spread double"

    def zero(self):
        return np.inf, -np.inf

    def update(self, state, values):
        return self.merge(state, (values.min(), values.max())) if len(values) else state

    def merge(self, state, other):
        return min(state[0], other[0]), max(state[1], other[1])

    def finish(self, state):
        return (float(state[1] - state[0]) if state[0] <= state[1] else None,)

    def dump(self, state):
        return struct.pack("<2d", *state)

    def load(self, data):
        return struct.unpack("<2d", data)


class Moments(Mergeable):
    """n, mean, sample variance and sample skewness, from central moments: no difference of great sums is taken."""

    result = "n long, mean double, variance double, skewness double"

    def zero(self):
        return 0.0, 0.0, 0.0, 0.0

    def update(self, state, values):
        if not len(values):
            return state
        mean = float(values.mean())
        apart = values - mean
        return self.merge(state, (float(len(values)), mean, float((apart**2).sum()), float((apart**3).sum())))

    def merge(self, state, other):
        (n, mean, second, third), (m, its, its_second, its_third) = state, other
        if not n or not m:
            return other if m else state
        total, d = n + m, its - mean
        return (
            total, mean + d * m / total, second + its_second + d * d * n * m / total,
            third + its_third + d**3 * n * m * (n - m) / total**2 + 3 * d * (n * its_second - m * second) / total,
        )

    def finish(self, state):
        n, mean, second, third = state
        if not n:
            return 0, None, None, None
        variance = second / (n - 1) if n > 1 else None
        skewness = (third / n) / (second / n) ** 1.5 * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and second > 0 else None
        return int(n), mean, variance, skewness

    def dump(self, state):
        return struct.pack("<4d", *state)

    def load(self, data):
        return struct.unpack("<4d", data)


class Quantiles(Mergeable):
    """A t-digest: means and weights of neighbouring values, few where ranks are near 0 or 1.

    A quantile's rank is off by at most half a centroid's weight, which is below pi / size of all
    values in the middle, and less towards the ends; the ends themselves are exact.
    """

    result = "n long, low double, high double, quantiles array<double>"

    def __init__(self, at: tuple[float, ...] = (0.5,), size: int = 200) -> None:
        self.at, self.size = at, size

    def zero(self):
        return np.zeros((0, 2)), np.inf, -np.inf

    def update(self, state, values):
        return self.merge(state, (np.stack((values, np.ones(len(values))), 1), values.min(), values.max())) if len(values) else state

    def merge(self, state, other):
        held = np.concatenate((state[0], other[0]))
        return self._compressed(held[np.lexsort((held[:, 1], held[:, 0]))]), min(state[1], other[1]), max(state[2], other[2])

    def _compressed(self, held: np.ndarray) -> np.ndarray:
        """Neighbours joined while together they span less than one step of the scale size / 2 pi * asin(2 q - 1)."""
        if len(held) <= 1:
            return held
        ends = np.cumsum(held[:, 1])
        total = ends[-1]
        scale = self.size / (2 * np.pi) * np.arcsin(np.clip(2 * ends / total - 1, -1, 1))
        before = self.size / (2 * np.pi) * np.arcsin(np.clip(2 * (ends - held[:, 1]) / total - 1, -1, 1))
        groups, i = [], 0
        while i < len(held):
            groups.append(i)
            i = max(i + 1, int(np.searchsorted(scale, before[i] + 1, "right")))
        weights = np.add.reduceat(held[:, 1], groups)
        return np.stack((np.add.reduceat(held[:, 0] * held[:, 1], groups) / weights, weights), 1)

    def finish(self, state):
        held, low, high = state
        if not len(held):
            return 0, None, None, None
        n = held[:, 1].sum()
        middles = np.concatenate(([0], np.cumsum(held[:, 1]) - held[:, 1] / 2, [n]))
        return int(n), float(low), float(high), [float(np.interp(q * n, middles, np.concatenate(([low], held[:, 0], [high])))) for q in self.at]

    def dump(self, state):
        return struct.pack("<2d", state[1], state[2]) + state[0].tobytes()

    def load(self, data):
        return np.frombuffer(data[16:]).reshape(-1, 2), *struct.unpack("<2d", data[:16])


def aggregated(df: DataFrame, by: list[str], column: str, what: Mergeable) -> DataFrame:
    """by and the result columns of `what` over the values of `column`, for each group; a group without values is there, and says so.

    Each task folds its batches into one state a group; states are merged by group and part of
    their digest, then by group, in sorted streams that hold one state at a time. What is shuffled
    are states. Null keys are a group; NaN and nulls among values are left out.
    """
    rows = df.select(*by, F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double")).alias("__value"))
    keys = rows.select(*by).schema
    held_as = f"{rows.select(*by)._jdf.schema().toDDL()}, __state binary"

    def batch_of(schema: pa.Schema, found: list[tuple[tuple, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k, _ in found], schema.field(i).type) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in found], pa.binary())], [*by, "__state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        schema = None
        for b in batches:
            schema = b.schema
            lists = pa.Table.from_batches([b]).group_by(by, use_threads=False).aggregate([("__value", "list")]).combine_chunks()
            names = list(zip(*(lists[c].to_pylist() for c in by), strict=True))
            for key, values in zip(names, lists["__value_list"].chunk(0) if lists.num_rows else (), strict=True):
                state = held[key] if key in held else what.zero()
                held[key] = what.update(state, values.values.drop_null().to_numpy(zero_copy_only=False))
            if len(held) >= GROUPS:
                yield batch_of(schema, [(k, what.dump(s)) for k, s in held.items()])
                held.clear()
        if held:
            yield batch_of(schema, [(k, what.dump(s)) for k, s in held.items()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Schema, tuple, Any]]:
        """Each key of sorted batches with its merged state."""
        key, state, schema = None, None, None
        for b in batches:
            schema = b.schema
            columns = [b.column(i).to_pylist() for i in range(len(by))]
            for k, data in zip(zip(*columns, strict=True), b.column(len(by)).to_pylist(), strict=True):
                if key is not None and k != key:
                    yield schema, key, state
                    key = None
                state = what.load(data) if key is None else what.merge(state, what.load(data))
                key = k
        if key is not None:
            yield schema, key, state

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for schema, key, state in joined(batches):
            yield batch_of(schema, [(key, what.dump(state))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for schema, key, state in joined(batches):
            result = what.finish(state)
            columns = [pa.array([key[i]], schema.field(i).type) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], t) for x, t in zip(result, kinds, strict=True))], [*by, *names])

    def dealt(states: DataFrame, *more: Any) -> DataFrame:
        # sorted by state too, so that sums of doubles come out alike in every run
        return states.repartition(*by, *more).sortWithinPartitions(*by, *more, "__state").select(*by, "__state")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(what.result)
    names, kinds = out.names, to_arrow_schema(out).types
    states = rows.mapInArrow(fold, held_as)
    parts = dealt(states, F.pmod(F.xxhash64("__state"), F.lit(FAN))).mapInArrow(merge, held_as)
    return dealt(parts).mapInArrow(finish, StructType([*keys.fields, *out.fields]))
