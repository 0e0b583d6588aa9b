"""Arrow columns computed beside the rows they come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a batch that a task turns into Python objects at once, about.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``PIECE`` bytes, so that a worker, which
    lives on from task to task and keeps what it once took, never holds a
    batch of texts twice."""
    rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def named(column: str) -> Column:
    """A top-level column by its name, whatever characters the name has."""
    return F.col(f"`{column.replace('`', '``')}`")


def with_arrow_columns(
    docs: DataFrame,
    inputs: list[Column],
    start: Callable[[], Callable[..., list[pa.Array]]],
    fields: str,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[Column]]:
    """Rows of ``docs`` with further columns made by Python, batch by batch.

    ``start()`` runs once in each task and returns a function from the lists
    of the ``inputs`` to one Arrow array for each of ``fields`` (a DDL list).
    The columns of ``docs`` (those in ``keep``, if given) travel under names
    of their own, so any names may clash with ``fields``; the second result
    selects them back.  Names and struct fields may hold any characters.
    """
    shown = [f for f in docs.schema.fields if keep is None or f.name in keep]
    made = T.StructType.fromDDL(fields)
    n, m = len(shown), len(inputs)
    frame = docs.select(*(named(f.name).alias(f"c{k}") for k, f in enumerate(shown)), *(x.alias(f"i{k}") for k, x in enumerate(inputs)))
    old = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(shown)]
    new = [T.StructField(f"n{k}", f.dataType) for k, f in enumerate(made.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in (piece for whole in batches for piece in pieces(whole)):
            arrays = make(*(batch.column(n + k).to_pylist() for k in range(m)))
            names = [*batch.schema.names[:n], *(f"n{k}" for k in range(len(arrays)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=names)

    out = frame.mapInArrow(run, T.StructType(old + new)).withColumnsRenamed({f"n{k}": f.name for k, f in enumerate(made.fields)})
    return out, [F.col(f"c{k}").alias(f.name) for k, f in enumerate(shown)]
