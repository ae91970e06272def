"""Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows a Python worker turns into objects at once; longer single texts stand alone.
PIECE_BYTES = 2 << 20
PIECE_ROWS = 4096


def pieces(batch: pa.RecordBatch, *columns: str, limit: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``rows`` rows whose ``columns`` hold about ``limit`` bytes; whole rows only.

    Columns are strings, binaries or long integers that say how many bytes a row has.
    """
    sizes = [0] * batch.num_rows
    for name in columns:
        column = batch.column(name)
        lengths = column if pa.types.is_integer(column.type) else pc.binary_length(column)
        for i, n in enumerate(lengths.to_pylist()):
            sizes[i] += n or 0
    start = held = 0
    for i, n in enumerate(sizes):
        if i - start >= rows or (held and held + n > limit):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def by_piece(
    work: Callable[[pa.RecordBatch], pa.RecordBatch], *columns: str, limit: int = PIECE_BYTES, done: Callable[[], None] | None = None
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``work`` to bounded pieces.

    ``done`` ends each partition: workers live on for later stages, and what ``work`` keeps between pieces would stay in them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for piece in pieces(batch, *columns, limit=limit):
                    yield work(piece)
        finally:
            if done:
                done()

    return run
