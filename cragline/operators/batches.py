"""Python work on many small groups: a task's rows come sorted, and whole groups go through it many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of whole groups that are worked on at once, unless one group has more.
ROWS = 100_000


def _last_begin(table: pa.Table, keys: list[str]) -> int:
    """Where the last row's group begins."""
    begin = 0
    for key in keys:
        column = table.column(key)
        last = column[-1]
        other = pc.fill_null(pc.not_equal(column, last), True) if last.is_valid else pc.is_valid(column)
        found = other.to_numpy(zero_copy_only=False).nonzero()[0] if isinstance(other, pa.Array) else other.combine_chunks().to_numpy(zero_copy_only=False).nonzero()[0]
        begin = max(begin, int(found[-1]) + 1 if len(found) else 0)
    return begin


def by_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table], pa.Table], schema: str, rows: int = ROWS) -> DataFrame:
    """What run makes of df's groups by keys. run takes whole groups, about so many rows, sorted by keys, then order, and may not mix groups."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, limit = [], 0, rows
        for batch in stream:
            held.append(batch)
            many += batch.num_rows
            if many < limit:
                continue
            table = pa.Table.from_batches(held)
            begin = _last_begin(table, keys)
            if begin:
                yield from run(table.slice(0, begin).combine_chunks()).to_batches()
            rest = table.slice(begin)
            held, many = rest.to_batches(), rest.num_rows
            limit = max(rows, 2 * many)
        if many:
            yield from run(pa.Table.from_batches(held).combine_chunks()).to_batches()

    # a set number of parts, since by bytes few tasks would do all the work
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, schema)
