"""Groups of any size taken apart into pairs of blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_texts

#: Rows of a block; a task holds two blocks of one group at a time.
BLOCK = 1024


def paired(rows: DataFrame, key: str, by: str, block: int = BLOCK) -> DataFrame:
    """Every row once for each pair of its group's blocks that includes its own: columns `low`, `high`, `own` added.

    A group of up to `block` rows is one block, paired with itself. A larger group of n blocks is dealt by a hash of
    `by` and each of its rows is sent to n places, so every pair of rows meets somewhere and no place holds the group.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        *rows.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own"
    )


def each_group(
    rows: DataFrame, keys: list[str], columns: list[str], schema: str, what: Callable[[list[tuple]], list[tuple]]
) -> DataFrame:
    """what() of each group's rows, as tuples of `columns`; groups stream through tasks in key order, one at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    n = len(keys)
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != now:
                    if held:
                        out += what(held)
                    now, held = row[:n], []
                held.append(row[n:])
            if len(out) > 5000:
                yield batch()
                out = []
        if held:
            out += what(held)
        if out:
            yield batch()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *columns[:1])
    return map_texts(dealt.select(*keys, *columns), task, schema)
