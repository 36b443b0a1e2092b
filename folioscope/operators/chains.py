"""Names given one after another in each group, for many small groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def chained(rows: DataFrame, keys: list[str], order: list[str], given: list[str], kept: list[str], name: str, start: Callable[[], Callable[..., str]]) -> DataFrame:
    """kept and name of rows: what a function, which start() makes anew for each group of keys, says of its `given` columns, in order within the group.

    Groups follow one another in sorted partitions, so a task goes through all of its groups in batches of many, and holds
    what the function of the present one remembers.
    """
    shape = StructType(rows.select(*kept).schema.fields).add(name, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, say = None, None
        for batch in batches:
            out = []
            for key, *values in zip(zip(*(batch[k].to_pylist() for k in keys)), *(batch[c].to_pylist() for c in given)):
                if key != last:
                    last, say = key, start()
                out.append(say(*values))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(out, pa.string())], [*kept, name])

    dealt = rows.repartition(*keys).sortWithinPartitions(*[F.asc_nulls_last(c) for c in [*keys, *order]])
    return dealt.select(*dict.fromkeys([*keys, *given, *kept])).mapInArrow(run, shape)
