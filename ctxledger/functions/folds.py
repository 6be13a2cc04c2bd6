"""Folds: rules whose state depends on every earlier decision, which no window sum expresses."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import to_arrow_type


def fold(rows: DataFrame, key: str, order: list[str], rule: Callable[[], Callable], columns: list[str], out: StructField) -> DataFrame:
    """``rows`` plus the column ``out``: what a fresh ``rule()`` returns for each row's ``columns``, in ``order`` within a ``key``.

    Rows are dealt by key and sorted by Spark, which spills; the task then streams
    them and holds the running state of one key only, however many rows it has.
    """
    kind = to_arrow_type(out.dataType)

    def run(batches):
        now, step = object(), None
        for b in batches:
            found = []
            for k, *values in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
                if step is None or k != now:
                    now, step = k, rule()
                found.append(step(*values))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, out.name])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, out]))
