"""Merging partial results of partitions in rounds of bounded fan-in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results merged in one task.
FAN = 64


def partitions(frame: DataFrame) -> int:
    """Number of partitions of a freshly read table; only the plan is asked, no job runs."""
    return frame._jdf.queryExecution().toRdd().getNumPartitions()


def merge_rounds(parts: DataFrame, keys: Sequence[str], merge: Callable[[list[bytes]], bytes], count: int, fan: int = FAN) -> DataFrame:
    """One row per key with the merged ``blob`` of all its parts.

    ``parts`` has the integer ``keys``, ``part`` (from 0 to ``count`` - 1) and ``blob``. However many partitions gave a
    part, a task merges at most ``fan`` blobs of a key: rounds go on until no more are left.
    """
    schema = parts.schema

    def run(table: pa.Table) -> pa.Table:
        first = {name: [table.column(name)[0].as_py()] for name in table.column_names if name != "blob"}
        blobs = table.column("blob").to_pylist()
        merged = first | {"blob": [blobs[0] if len(blobs) == 1 else merge(blobs)]}
        return pa.table([pa.array(merged[f.name], f.type) for f in table.schema], schema=table.schema)

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).select(*schema.names)
        parts = parts.groupBy(*keys, "part").applyInArrow(run, schema)
        count = -(-count // fan)
        if count <= 1:
            return parts.drop("part")
