"""Folds in order of arrival, with a value of state per key.

Rows are dealt by key, sorted within their partition and streamed once: a key's log is never held as one value, only
the state that its last row left. Work is linear in the log. The step runs in Python on Arrow batches; a key that
holds many rows takes one task's time and no more than a batch of its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: (state, values of a row) -> (state, values to add to the row). The state before a key's first row is None.
Step = Callable[[Any, tuple], tuple[Any, tuple]]


def fold(rows: DataFrame, keys: list[str], order: str, uses: list[str], step: Step, adds: str) -> DataFrame:
    """``rows`` (keys, order and more) with the columns ``adds`` (a schema) that ``step`` makes of the columns ``uses``."""
    schema = f"{_ddl(rows)}, {adds}"
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(names.index(c)).to_pylist()
            out = []
            for key, values in zip(zip(*map(column, keys)), zip(*map(column, uses))):
                if key != at:
                    at, state = key, None
                state, more = step(state, values)
                out.append(more)
            added = [pa.array(x, t.type) for x, t in zip(zip(*out), fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *(t.name for t in fields)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = list(to_arrow_schema(StructType.fromDDL(adds)))
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
