"""Sums of whole numeric vectors per key, with a map-side combine.

Spark has no built-in aggregate that adds arrays element by element. Each task
first adds up its own rows, then the small partial sums are shuffled and added
once more, so a hot key reaches the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def sum_vectors(df: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """``keys`` plus the element-wise sum of ``vector`` (one length per key)."""
    rows = df.select(*keys, vector)
    schema = rows.schema
    target = to_arrow_schema(schema)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            column = batch.column(len(keys))
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            for name, end in zip(names, ends):
                if name in sums:
                    sums[name] += values[start:end]
                else:
                    sums[name] = values[start:end].copy()
                start = end
        for name, total in sums.items():
            arrays = [pa.array([part], target.field(i).type) for i, part in enumerate(name)]
            arrays.append(pa.array([total], target.field(len(keys)).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    partial = rows.mapInArrow(combine, schema)
    return partial.repartition(*keys).mapInArrow(combine, schema)
