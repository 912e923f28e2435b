"""Arrow batches in and out of Python, without pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.session import ship


def map_batches(
    frame: DataFrame, work: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None], schema: str | T.StructType
) -> DataFrame:
    """Apply ``work`` to every Arrow batch; it returns columns by name, a finished batch, or nothing."""
    ship(frame.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = work(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
                continue
            columns = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return frame.mapInArrow(run, struct)


def map_stream(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """Apply ``work`` to the stream of a partition's Arrow batches, for work that keeps a state from batch to batch."""
    ship(frame.sparkSession)
    return frame.mapInArrow(work, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
