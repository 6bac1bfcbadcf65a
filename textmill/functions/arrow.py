"""Arrow batches of texts in small parts: a worker holds one part's Python strings and results at a time, however large its batches are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and rows, that are handled at a time. A longer text is a part of its own.
PART_BYTES, PART_ROWS = 1 << 20, 2_000


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The column in parts, end to end."""
    low = size = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if at > low and (size + n > PART_BYTES or at - low == PART_ROWS):
            yield texts.slice(low, at - low)
            low, size = at, 0
        size += n
    yield texts.slice(low)
