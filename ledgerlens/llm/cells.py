"""Points and queries that meet in cells: shared by the operators that search in blocks."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def meet(points: DataFrame, queries: DataFrame, build: Callable[[pa.StructArray], object],
         search: Callable[[object, pa.StructArray], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``search(build(points), queries)`` of every ``cell``, the first column of both frames.

    Both sides travel to the cell once, in one shuffle; a task reads a cell's points first and
    then its queries batch by batch, so it holds one cell's points and one batch of queries,
    however many queries a cell has. Cells without points or without queries give nothing."""
    kinds = [StructType(x.schema.fields[1:]) for x in (points, queries)]
    cell = F.col("cell").cast("long").alias("cell")
    both = points.select(cell, F.lit(0).alias("tag"), F.struct(*points.columns[1:]).alias("p"), F.lit(None).cast(kinds[1]).alias("q")).unionAll(
        queries.select(cell, F.lit(1).alias("tag"), F.lit(None).cast(kinds[0]).alias("p"), F.struct(*queries.columns[1:]).alias("q")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, state = None, [], None
        for batch in batches:
            cell, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (tag[1:] != tag[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(cell)], strict=True):
                if a == b:
                    continue
                if cell[a] != current:
                    current, held, state = cell[a], [], None
                if tag[a] == 0:
                    held.append(batch.column(2).slice(a, b - a))
                    continue
                if held:
                    state, held = build(pa.concat_arrays(held)), []
                if state is not None:
                    out = search(state, batch.column(3).slice(a, b - a))
                    if out is not None and out.num_rows:
                        yield out

    return both.repartition("cell").sortWithinPartitions("cell", "tag").mapInArrow(run, schema)


def field(rows: pa.StructArray, name: str) -> pa.Array:
    """A field of a struct array that may be a slice."""
    return rows.flatten()[rows.type.get_field_index(name)]


def numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return field(rows, name).to_numpy(zero_copy_only=False)
