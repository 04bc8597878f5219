"""Rules that depend on the order of rows: each key's rows are walked in order, as a stream.

Spark deals the rows by key and sorts them, so a key of any length takes the memory of its
state only; keys run in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewright.workers import reach

#: Rows that go back in a batch.
BATCH = 4096


def walked(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict[str, Any]], Iterable[tuple]], finish: Callable[[Any], Iterable[tuple]] | None, schema: StructType) -> DataFrame:
    """What step gives for the rows of each key in order, and finish at its end; both after the key's columns, which schema begins with."""
    reach(rows.sparkSession)
    arrow = to_arrow_schema(schema)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, found = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[c] for c in by)
                if key != here:
                    if here is not None and finish is not None:
                        found += [(*here, *x) for x in finish(state)]
                    here, state = key, start()
                found += [(*key, *x) for x in step(state, row)]
                if len(found) >= BATCH:
                    yield packed(found)
                    found = []
        if here is not None and finish is not None:
            found += [(*here, *x) for x in finish(state)]
        if found:
            yield packed(found)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
