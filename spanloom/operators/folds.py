"""Ordered folds that carry a small state from row to row.

Rows of a group lie sorted in one partition and pass through Arrow batches; a
fold sees them one by one and gives rows out as soon as they are done, so the
length of a group is bounded by disk, not by memory: no array of a group is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 4096  # given out at once

Fold = Callable[[Iterator[tuple]], Iterator[tuple]]


def scan(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str, dealt: list[str] | None = None) -> DataFrame:
    """What fold makes of each group's rows in order: keys and the columns of schema.

    rows holds the keys first; fold gets the other columns as tuples and gives
    tuples of the columns of schema. Groups that share the keys named by dealt
    (all, if it is not given) go to one task.
    """
    n = len(keys)
    out = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        done = []
        for key, group in groupby(every, key=lambda row: row[:n]):
            for made in fold(row[n:] for row in group):
                done.append((*key, *made))
                if len(done) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    first = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    return first.repartition(*(dealt or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
