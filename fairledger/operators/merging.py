"""Equal cells of the rows that a task holds, merged in Arrow.

The functions travel to the executors by value, so that nothing has to be installed there.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from fairledger.scope import VERSION

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows, and bytes, that a task takes together to merge equal cells.
MERGED_ROWS, MERGED_BYTES = 100_000, 16 << 20


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """The distinct cells of some rows, each with its number and the smallest row."""
    rows = rows.combine_chunks()
    fields = rows["fields"].combine_chunks()
    row = pc.list_parent_indices(fields)
    size = np.nan_to_num(pc.list_value_length(fields).to_numpy(zero_copy_only=False)).astype(np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    version = np.zeros(len(rows), np.int64)
    for c in VERSION:
        codes = rows[c].combine_chunks().dictionary_encode()
        version = version * (len(codes.dictionary) + 1) + codes.indices.fill_null(len(codes.dictionary)).to_numpy()
    wide = int(size.max(initial=0)) + 1
    first, version = np.unique(version, return_index=True, return_inverse=True)[1:]
    cell = pa.table({
        "column": version[row.to_numpy()] * wide + place, "raw": pc.list_flatten(fields),
        "row_number": rows["row_number"].combine_chunks().take(row),
    }).group_by(["column", "raw"], use_threads=False).aggregate([("row_number", "min"), ([], "count_all")])
    column = cell["column"].to_numpy()
    of = rows.select(VERSION).take(pa.array(first[column // wide])).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [*[c.combine_chunks() for c in of.columns], cell["row_number_min"].combine_chunks(),
         pa.array((column % wide).astype(np.int32)), cell["raw"].combine_chunks(), cell["count_all"].combine_chunks()],
        names=[*VERSION, "row_number", "col_idx", "raw", "n"])


def merge(batches):
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= MERGED_ROWS or size >= MERGED_BYTES:
            yield _merged(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0
    if rows:
        yield _merged(pa.Table.from_batches(held))
