"""Arrow arrays from Python results, a bounded number of which exist at once."""

from __future__ import annotations

import pyarrow as pa

#: Pages whose results are Python objects at once; a batch of 10,000 would hold all its words as such.
SLICE = 128


def in_slices(column: pa.Array, one, kind: pa.DataType) -> pa.Array:
    """``one`` of each value as an Arrow array, put together a slice at a time."""
    parts = [pa.array([one(t) for t in column.slice(k, SLICE).to_pylist()], kind) for k in range(0, len(column), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
