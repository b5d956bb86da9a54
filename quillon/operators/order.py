"""Total order without a single-partition sort: sums before each row, by ranges of the order key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive keys in a range; ranges of ranges are as wide.
WIDTH = 4096


def before(df: DataFrame, by: Sequence[str], key: str, value: str, out: str) -> DataFrame:
    """df with the sum of `value` over the rows of the same group whose integer `key` is smaller.

    Keys must be unique in a group. Sums are taken over ranges of WIDTH keys, then over ranges of those, so no window
    holds more than WIDTH rows of the data; the last one holds a group's keys divided by WIDTH squared.
    """
    one, two = f"{out}_range", f"{out}_outer"
    df = df.withColumn(one, F.floor(F.col(key) / WIDTH)).withColumn(two, F.floor(F.col(key) / (WIDTH * WIDTH)))
    inner = df.groupBy(*by, two, one).agg(F.sum(value).alias("own"))
    outer = inner.groupBy(*by, two).agg(F.sum("own").alias("total"))

    def running(cols: Sequence[str], order: str, of: str):
        w = Window.partitionBy(*cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(of).over(w), F.lit(0))

    outer = outer.select(*by, two, running(by, two, "total").alias("o"))
    inner = inner.select(*by, two, one, running([*by, two], one, "own").alias("i"))
    offsets = inner.join(outer, [*by, two]).select(*by, one, (F.col("i") + F.col("o")).alias(f"{out}_base"))
    return (
        df.withColumn(f"{out}_here", running([*by, one], key, value))
        .join(offsets, [*by, one])
        .withColumn(out, (F.col(f"{out}_base") + F.col(f"{out}_here")).cast("long"))
        .drop(f"{out}_base", f"{out}_here", one, two)
    )


def number_tokens(lines: DataFrame, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """Lines with `start`: the tokens of their corpus before them, in the order of (doc_id, line_no).

    Documents' sizes are summed in ranges; lines within a document by a window over the document.
    """
    sized = lines.withColumn("n_words", F.size("words").cast("long"))
    docs = sized.groupBy(*by, "doc_id").agg(F.sum("n_words").alias("doc_words"))
    docs = before(docs, by, "doc_id", "doc_words", "doc_start").select(*by, "doc_id", "doc_start")
    w = Window.partitionBy(*by, "doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_words").over(w), F.lit(0))
    return (
        sized.withColumn("within", within)
        .join(docs, [*by, "doc_id"])
        .withColumn("start", (F.col("doc_start") + F.col("within")).cast("long"))
        .drop("within", "doc_start", "n_words")
    )


def number_lines(lines: DataFrame, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """Lines with `line_ord`: the lines of their corpus before them."""
    docs = lines.groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    docs = before(docs, by, "doc_id", "n", "base").select(*by, "doc_id", "base")
    w = Window.partitionBy(*by, "doc_id").orderBy("line_no")
    numbered = lines.withColumn("r", F.row_number().over(w) - 1).join(docs, [*by, "doc_id"])
    return numbered.withColumn("line_ord", (F.col("base") + F.col("r")).cast("long")).drop("base", "r")
