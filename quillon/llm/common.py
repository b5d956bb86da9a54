"""What the operators share: tables in the shared folder, row identities, and a few helpers for Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset a local session gets a folder of its own; a cluster gets an error, as a machine-local folder
    would be lost with its executor.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: Has Spark delete a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once in the shared folder and read again, so that a lost executor costs only its own tasks.

    Operators delete what their results don't read with keep(); the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            self.drop()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again; the shuffle files of the writing are deleted as soon as it is done."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them; nothing may read it afterwards."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names -= {name} if name else self.names

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which a result still reads."""
        for name in self.names - set(names):
            self.drop(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def bounded(spark: SparkSession, rows: int = 1000, size: int = 64 << 20) -> None:
    """Have Arrow batches of at most `rows` rows and, but for a single longer one, `size` bytes.

    Texts are long, and a batch is held several times over. Spark reads these settings when the plan is made, which may
    be long after this call, so they stay set; smaller ones are left as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        told = spark.conf.get(key).removesuffix("b")
        if not told.isdigit() or int(told) not in range(1, most + 1):  # another unit, none or too many
            spark.conf.set(key, str(most))


def given_back() -> None:
    """Have this process give free memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task, after which its Python worker, which the next task reuses, gives free memory back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            given_back()

    return run


def map_texts(rows: DataFrame, task: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow over rows with texts, in bounded batches."""
    bounded(rows.sparkSession)
    return rows.mapInArrow(tidy(task), schema)


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """rows left-joined with found, which has one row for each value of `keys` and says in `copies` how many rows have it.

    Values that more than 100,000 rows, and more than a hundred-thousandth of all, have are sent to all instead of
    dealing their rows to one task; there can't be more than 100,000 such values.
    """
    total = found.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) > max(100_000, total // 100_000)
    rest, sent = found.where(~hot).drop(copies), found.where(hot).drop(copies)
    if sent.isEmpty():
        return rows.join(found.drop(copies), keys, "left")
    sent = F.broadcast(sent)
    others = rows.join(F.broadcast(found.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(sent, keys).unionByName(others.join(rest, keys, "left"))


def attach(pairs: DataFrame, side: str, other: str, table: DataFrame, scratch: Scratch, most: int = 512) -> DataFrame:
    """pairs joined with table (one row for each node in `side`), a node of more than `most` pairs in as many tasks as it needs."""
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / most).cast("int").alias("parts_")).where("parts_ > 1")
    many = scratch.table(many, f"many_{uuid.uuid4().hex[:8]}")
    if many.isEmpty():
        return pairs.join(table, side)
    parts = F.coalesce("parts_", F.lit(1))
    dealt = pairs.join(many, side, "left").withColumn("salt_", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts_")
    held = table.join(many, side, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts_")
    return dealt.join(held, [side, "salt_"]).drop("salt_")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes to bytes: A-Z to a-z, other ASCII than letters and digits to a space, all else as it is.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
