"""Groups out of sorted Arrow batches, one after the other, without a call per group by Spark."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal keys (non-null integers), each run whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held and held[-1].column(k)[-1].as_py() != v[0]:
                change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        if held or cuts[0]:
            yield _joined([*held, batch.slice(0, cuts[0])])
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(i, j - i)
        held = [batch.slice(cuts[-1])]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows]
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
