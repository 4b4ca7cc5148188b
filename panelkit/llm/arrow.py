"""Arrow-batched mapping of rows in slices of bounded text size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text that one slice holds at least before it is handed on; a longer text is a slice of its own.
SLICE_CHARS = 1_000_000

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}


def arrow_schema(columns: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in columns.items()])


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def slices(batches: Iterator[pa.RecordBatch], text_at: int, budget: int = SLICE_CHARS) -> Iterator[list[list]]:
    """Python column lists of consecutive rows whose texts reach ``budget`` characters together."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        texts, start, held = columns[text_at], 0, 0
        for i, text in enumerate(texts):
            held += len(text) if text else 1
            if held >= budget:
                yield [c[start : i + 1] for c in columns]
                start, held = i + 1, 0
        if start < len(texts):
            yield [c[start:] for c in columns]


def map_slices(df: DataFrame, text: str, out: dict[str, str], work: Callable[..., list]) -> DataFrame:
    """``work(*columns) -> output columns`` over slices of the rows of ``df``.

    Rows stay in the partition that they are in.  ``work`` gets one list for each
    column of ``df`` and returns one sequence for each column of ``out``.
    """
    at = df.columns.index(text)
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches, at):
            made = work(*columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(made, schema, strict=True)], schema=schema
            )

    return df.mapInArrow(run, ddl(out))
