"""Groups of rows that stand one behind the other in a task's batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that a task holds before it hands whole groups on.
ROWS = 1 << 16


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows sorted by their first column that hold whole groups, and where the groups begin."""
    held, total, most = [], 0, rows or ROWS

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return table, begins(table[0].chunk(0))

    for batch in batches:
        if not batch.num_rows:
            continue
        if total >= most:
            key = batch.column(0)
            inside = begins(key)
            # the last group goes on in the next batch, perhaps
            upto = int(inside[-1]) if len(inside) > 1 or key[0] != held[-1].column(0)[-1] else None
            if upto is not None:
                if upto:
                    held.append(batch.slice(0, upto))
                yield out()
                held, total, batch = [], 0, batch.slice(upto)
        held.append(batch)
        total += batch.num_rows
    if held:
        yield out()


def begins(key: pa.Array) -> np.ndarray:
    """Places at which a column without nulls changes, the first included."""
    changes = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, changes))
