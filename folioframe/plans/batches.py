"""Map-only steps over Arrow batches: what a task holds at once is bounded, however many rows a batch of documents makes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Documents that are taken out of a batch together, and rows made of them that leave a task together.
DOCS, ROWS = 64, 16_384


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            yield batch.slice(at, DOCS)


def made_rows(batches: Iterable[pa.RecordBatch], rows: Callable[..., Iterable[tuple]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of the first column and the tuples that rows makes of the others, whose types are kinds."""

    def batch_of(ids: pa.Array, owner: list[int], made: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *columns], names)

    for part in parts(batches):
        owner, made = [], []
        for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)):
            for row in rows(*values):
                owner.append(i)
                made.append(row)
                if len(made) >= ROWS:
                    yield batch_of(part.column(0), owner, made)
                    owner, made = [], []
        if made:
            yield batch_of(part.column(0), owner, made)
