"""Passes over the rows of a group in order, for what needs a state that no window function has.

Rows are dealt by their keys and sorted within partitions; a task walks them in Arrow batches and holds one group's state at a time, however many groups there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of the result in a batch.
ROWS = 4096


def scan(rows: DataFrame, keys: list[str], order: list[Column | str], start: Callable[[], object], schema: StructType) -> DataFrame:
    """rows by groups of keys in order, through an object that start makes for each group: its add(row) and end() yield result rows as tuples.

    A row is a tuple of all columns of rows; result rows have the columns of schema.
    """
    at = [rows.columns.index(k) for k in keys]
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = tuple(row[k] for k in at)
                if group is None or own != key:
                    if group is not None:
                        out += group.end()
                    key, group = own, start()
                out += group.add(row)
                if len(out) >= ROWS:
                    yield _batch(out, out_schema)
                    out = []
        if group is not None:
            out += group.end()
        if out:
            yield _batch(out, out_schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
