"""A sparse table of numbered entries times a block of vectors. The entries stay rows, sorted by their first place, and each
task adds up its own; the block, a bounded one, goes to the tasks whole and its sums come back, so that a step shuffles nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lontar.tables import materialize

#: Bytes of a block of vectors up to which it goes to every task whole.
WHOLE_BYTES = 1 << 27


def places(column: pa.Array, names: pa.Array) -> np.ndarray:
    """Places of values in the sorted names, -1 for others."""
    if pa.types.is_integer(names.type):
        known, asked = names.to_numpy(zero_copy_only=False), column.to_numpy(zero_copy_only=False)
        at = np.searchsorted(known, asked)
        return np.where(known[np.minimum(at, len(known) - 1)] == asked, at, -1) if len(known) else np.full(len(asked), -1)
    return pc.index_in(column, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)


def sorted_block(table: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Names, ascending, and the rows of numbers beside them, of a table whose size the caller has bounded."""
    got = table.toArrow().combine_chunks()
    got = got.sort_by(got.column_names[0])
    column = got.column(0).combine_chunks() if isinstance(got.column(0), pa.ChunkedArray) else got.column(0)
    return column, np.column_stack([got.column(i).to_numpy() for i in range(1, got.num_columns)]).astype(float)


def numbered(entries: DataFrame, names: pa.Array, name: str) -> DataFrame:
    """i, j, s of entries (two names, a number), written so that entries of one i lie together."""
    known = entries.sparkSession.sparkContext.broadcast(names)

    def task(batches):
        for batch in batches:
            x, y = places(batch.column(0), known.value), places(batch.column(1), known.value)
            yield pa.record_batch([pa.array(x, pa.int32()), pa.array(y, pa.int32()), batch.column(2)], names=["i", "j", "s"])

    return materialize(entries.mapInArrow(task, "i int, j int, s double").repartition("i").sortWithinPartitions("i"), name)


def times(links: DataFrame, block: np.ndarray) -> np.ndarray:
    """The table (i, j, s) times the block, of which so many columns as WHOLE_BYTES hold go to the tasks at a time."""
    width = block.shape[1]
    wide = max(1, WHOLE_BYTES // (8 * max(1, len(block))))
    if wide < width:
        return np.hstack([times(links, np.ascontiguousarray(block[:, at : at + wide])) for at in range(0, width, wide)])
    sent = links.sparkSession.sparkContext.broadcast(block)

    def task(batches):
        x = sent.value
        for batch in batches:
            i, j, s = (batch.column(c).to_numpy() for c in range(3))
            if len(i):
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                sums = np.add.reduceat(x[j] * s[:, None], starts)
                lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, width, dtype=np.int32), sums.ravel())
                yield pa.record_batch([pa.array(i[starts]), lists], names=["i", "y"])

    got = links.mapInArrow(task, "i int, y array<double>").toArrow()
    sent.destroy()
    out = np.zeros_like(block)
    for batch in got.to_batches():
        np.add.at(out, batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(-1, width))
    return out


def placed(asked: DataFrame, names: pa.Array, block: np.ndarray, schema: str) -> DataFrame:
    """The block's rows beside the names of a table of one column; zeros beside others."""
    name = asked.columns[0]
    sent = asked.sparkSession.sparkContext.broadcast((names, np.vstack([block, np.zeros(block.shape[1])])))

    def task(batches):
        known, x = sent.value
        for batch in batches:
            rows = x[places(batch.column(0), known)]
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, x.shape[1], dtype=np.int32), rows.ravel())
            yield pa.record_batch([batch.column(0), lists], names=[name, "y"])

    return asked.mapInArrow(task, schema)
