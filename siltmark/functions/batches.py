"""Arrow batches as NumPy matrices, without a Python object per row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def matrix(column: pa.Array) -> np.ndarray:
    """An array<number> column whose rows have one length, as a (rows, length) matrix; NULL or ragged rows are refused."""
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1 or column.null_count:
        raise ValueError(f"vectors of one length are needed; there are {column.null_count} NULL ones and lengths {sizes.to_pylist()[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.Array:
    """A (rows, length) matrix as an array column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(values.ravel()))


def by_rep(batch: pa.RecordBatch, features: str = "features") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rep, row positions, matrix) for every repeat in the batch, in order of the repeat."""
    if not batch.num_rows:
        return
    reps = batch.column("rep").to_numpy(zero_copy_only=False)
    x = matrix(batch.column(features))
    for rep in np.unique(reps):
        at = np.flatnonzero(reps == rep)
        yield int(rep), at, x if len(at) == len(reps) else x[at]


def by_mask(batch: pa.RecordBatch, reps: Sequence[int] | None, column: str = "features") -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The matrix of all rows and, for every repeat, whether a row is one of ``by_side``; no repeats where there are no rows."""
    if not batch.num_rows:
        return np.empty((0, 0)), []
    x = matrix(batch.column(column))
    if reps is None:
        own = batch.column("rep").to_numpy(zero_copy_only=False)
        return x, [(int(rep), own == rep) for rep in np.unique(own)]
    masks = batch.column("train").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return x, [(rep, masks[:, i]) for i, rep in enumerate(reps)]


def by_side(batch: pa.RecordBatch, reps: Sequence[int] | None, column: str = "features") -> Iterator[tuple[int, np.ndarray]]:
    """(rep, matrix) of the train rows of every repeat: rows of a column ``rep``, or of a mask per repeat in ``train``."""
    if reps is None:
        for rep, _, x in by_rep(batch, column):
            yield rep, x
    else:
        x, sides = by_mask(batch, reps, column)
        for rep, train in sides:
            yield rep, x[train]


def packed(totals: dict[tuple[int, int], np.ndarray], task: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Sums of a task as rows (rep, part, slot, data), a few thousand to a batch."""
    items = list(totals.items())
    for i in range(0, len(items), 4096):
        some = items[i : i + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in some], pa.int32()), pa.array([k[1] for k, _ in some], pa.int32()),
             pa.array(np.full(len(some), task % slots, np.int32)), pa.array([v.tobytes() for _, v in some], pa.binary())],
            names=["rep", "part", "slot", "data"],
        )


PACKED = "rep int, part int, slot int, data binary"


def added_up(rows: DataFrame, count, kind: str, finish, schema: str, spread=dict) -> DataFrame:
    """Sums of vectors over all rows, one per (rep, part), without a row per number.

    ``count(state, batch)`` adds a batch to a task's dict, which ``spread`` turns into (rep, part) -> vector at its end; vectors
    of a few kilobytes keep batches small. A task sends each vector once, packed. Where there are many tasks their vectors are
    first added up in as many slots as the square root of their number. ``finish(rep, part, vector)`` makes a batch of ``schema``.
    """
    tasks = rows.rdd.getNumPartitions()
    slots = int(tasks**0.5) if tasks > 64 else 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, state = TaskContext.get(), {}
        for batch in batches:
            count(state, batch)
        yield from packed(spread(state), context.partitionId() if context else 0, slots)

    def added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for rep, part, data in zip(*(batch.column(c).to_pylist() for c in ("rep", "part", "data")), strict=True):
                own = np.frombuffer(data, kind)
                totals[rep, part] = totals[rep, part] + own if (rep, part) in totals else own
        return totals

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(added(batches), 0, 1)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rep, part), total in added(batches).items():
            yield finish(rep, part, total)

    sums = rows.mapInArrow(partial, PACKED)
    if slots > 1:
        sums = sums.repartition("rep", "part", "slot").mapInArrow(level, PACKED)
    return sums.repartition("rep", "part").mapInArrow(last, schema)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with ``name`` set to ``values``, in place or as a last column."""
    names = list(batch.schema.names)
    columns = list(batch.columns)
    if name in names:
        columns[names.index(name)] = values
    else:
        names.append(name)
        columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)


def frame(**columns) -> pa.RecordBatch:
    """A batch of equally long NumPy columns; a scalar is repeated."""
    size = max(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    full = [c if isinstance(c, np.ndarray) else np.full(size, c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in full], names=list(columns))
