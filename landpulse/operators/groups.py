"""Python steps over many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def whole_groups(columns: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feeds ``fn`` with many whole groups at a time (and each row's group number) from rows that are
    sorted by ``columns``; a group's rows wait until its last one has come."""
    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            group = numbers(table)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from fn(table.slice(0, last), group[:last]).to_batches()
            held = table.slice(last)
        if held is not None:
            yield from fn(held, np.zeros(held.num_rows, np.int64)).to_batches()

    return run
