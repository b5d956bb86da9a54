"""Shuffles, splits, samples and replicates in an order given by hashes: the same rows on any number of machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import shared
from quillon.operators.order import WIDTH


def draw(seed: str | Column, *parts: str | Column) -> Column:
    """A hash in 32 hexadecimal digits of seed and parts: the order of a shuffle, or a number of uniform()."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws("|", seed, *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def uniform(hashed: Column) -> Column:
    """A number in [0, 1) from the first 12 digits of a hash."""
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / float(1 << 48)


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """df once for each of n replicates; one job then serves them all."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shuffled(words: Column, seed: str | Column, *parts: str | Column) -> Column:
    """An array in an order drawn by its places: a shuffle inside the row, without a window."""
    keyed = F.transform(words, lambda w, i: F.struct(draw(seed, *parts, i).alias("k"), w.alias("w")))
    return F.transform(F.sort_array(keyed), lambda x: x["w"])


def shuffles(df: DataFrame, values: str, n: int, seed: str, *parts: str, rep: str = "rep") -> DataFrame:
    """df once for each of n replicates, the array `values` in an order of its own: a shuffle inside the row.

    A hash serves four replicates, eight of its digits each, so its cost is a quarter; ties go by place.
    """
    blocks = df.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))))
    keyed = F.transform(values, lambda v, i: F.struct(draw(seed, "block_", *parts, i).alias("k"), v.alias("v")))
    each = blocks.withColumn("keyed_", keyed).withColumn("quarter_", F.explode(F.sequence(F.lit(0), F.lit(3))))
    each = each.withColumn(rep, F.col("block_") * 4 + F.col("quarter_")).where(F.col(rep) < n)
    own = F.transform("keyed_", lambda x, i: F.struct(F.substring(x["k"], F.col("quarter_") * 8 + 1, F.lit(8)).alias("k"), i.alias("i"), x["v"].alias("v")))
    return each.withColumn(values, F.transform(F.sort_array(own), lambda x: x["v"])).drop("block_", "keyed_", "quarter_")


def rank_by_hash(df: DataFrame, within: Sequence[str], order: Sequence[str], seed: str, out: str, ranges: int) -> DataFrame:
    """df with `out`, each row's rank in its group by a hash of (seed, within, order), in `ranges` ranges of the hash."""
    hashed = df.withColumn("hash_", draw(seed, *within, *order))
    if ranges == 1:
        here = Window.partitionBy(*within).orderBy("hash_", *order)
        return hashed.withColumn(out, F.row_number().over(here)).drop("hash_")
    hashed = hashed.withColumn("range_", F.floor(uniform(F.col("hash_")) * ranges))
    sums = hashed.groupBy(*within, "range_").agg(F.count("*").alias("rows_"))
    earlier = Window.partitionBy(*within).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "range_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("base_"))
    here = Window.partitionBy(*within, "range_").orderBy("hash_", *order)
    return hashed.withColumn("here_", F.row_number().over(here)).join(sums, [*within, "range_"]).withColumn(out, F.col("base_") + F.col("here_")).drop("hash_", "range_", "here_", "base_")


def permuted(df: DataFrame, within: Sequence[str], value: str, order: Sequence[str], seed: str, width: int = WIDTH) -> DataFrame:
    """df with `value` dealt anew inside each group: the k-th row by one hash gets the value of the k-th by another.

    `order` must be unique in a group. The largest group is counted first; ranks are sums over ranges of the hashes of
    about `width` rows and a window inside each, so a group may be of any size and the result is the same for any width.
    """
    largest = df.groupBy(*within).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranges = max(1, -(-largest // width))
    slots = rank_by_hash(df, within, order, f"{seed}@", "slot_", ranges).drop(value)
    values = rank_by_hash(df, within, order, seed, "slot_", ranges).select(*within, F.col(value), "slot_")
    return slots.join(values, [*within, "slot_"]).drop("slot_")


def _packed(batches, within: Sequence[str], ranges: int, digits: int):
    """Rows of (within, md5_, code_) as a row for each group and range of the hash: the hashes' first bytes, and the codes."""
    import numpy as np
    import pyarrow as pa

    def put(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        md5 = pa.concat_arrays(rows["md5_"].chunks)
        at = np.frombuffer(md5.buffers()[1], dtype="<i4")[md5.offset]
        hexed = np.frombuffer(md5.buffers()[2], dtype=np.uint8)[at : at + 32 * len(md5)].reshape(-1, 32)
        half = (hexed & 15) + 9 * (hexed >> 6)
        hashes = np.ascontiguousarray(half[:, 0::2] << 4 | half[:, 1::2])
        first = np.ascontiguousarray(hashes[:, :4]).view(">u4").ravel().astype(np.uint64)
        key = np.zeros(len(md5), dtype=np.int64)
        for c in within:
            own = pa.concat_arrays(rows[c].chunks).dictionary_encode()
            key = np.unique(key * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
        key = key * ranges + (first * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends, lead = [*starts[1:].tolist(), len(order)], order[starts]
        hashes, codes = hashes[order, : digits // 2], rows["code_"].to_numpy()[order].astype("<u4")
        cuts = list(zip(starts.tolist(), ends, strict=True))
        cols = [rows[c].take(pa.array(lead)).combine_chunks() for c in within]
        cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        blobs = [pa.array([hashes[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([_small(codes[a:b]) for a, b in cuts], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, pa.array(key[lead] % ranges, pa.int64()), *blobs], names=[*within, "range_", "hashes_", "codes_"])

    held, n = [], 0
    for batch in batches:
        held, n = ([*held, batch] if batch.num_rows else held), n + batch.num_rows
        if n >= 1 << 20:
            yield put(held)
            held, n = [], 0
    if held:
        yield put(held)


def _small(codes) -> bytes:
    """Codes in a byte each, or four where one is larger; the first byte says which."""
    return b"\1" + codes.astype("u1").tobytes() if codes.max() < 256 else b"\4" + codes.astype("<u4").tobytes()


def _large(blob: bytes):
    import numpy as np

    return np.frombuffer(blob, dtype="u1" if blob[0] == 1 else "<u4", offset=1).astype("<u4")


def joint_dealt(df: DataFrame, within: Sequence[str], slot: Column, value: Column, order: Sequence[str], seed: str, width: int = 1 << 20, digits: int = 24) -> DataFrame:
    """(within, slot, value, n): how often permuted() gives a value to a slot, where both are small whole numbers.

    Hashes and numbers go through the shuffle packed, 13 bytes a row for most, first the slots', then the values'; what is
    kept of each is the numbers in the order of the hashes, which then meet by rank. Groups may be of any size: a task
    holds about `width` rows. Hashes that agree in `digits` digits are told apart by all 32 in a second try.
    """
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    df = df.dropna(subset=list(within))
    largest = df.groupBy(*within).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranges = max(1, -(-largest // width))
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in within)

    def ordered(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table["hashes_"].to_pylist()), dtype=np.uint8).reshape(-1, digits // 2)
        codes = np.concatenate([_large(x) for x in table["codes_"].to_pylist()])
        parts = [np.ascontiguousarray(hashes[:, k : k + 4]).view(">u4").ravel().astype(np.uint64) for k in range(0, digits // 2, 4)]
        first, rest = parts[0] << np.uint64(32) | parts[1], parts[2:]
        by = np.argsort(first)
        ties = 0
        if (np.diff(first[by]) == 0).any():
            by = np.lexsort((*rest[::-1], first))
            ties = int(np.logical_and.reduce([np.diff(x[by]) == 0 for x in (first, *rest)]).sum())
        told = {c: table[c].slice(0, 1) for c in within} | {"range_": table["range_"].slice(0, 1)}
        return pa.table(told | {"n_": pa.array([len(by)], pa.int64()), "ties_": pa.array([ties], pa.int64()), "codes_": pa.array([_small(codes[by])], pa.binary())})

    def side(code: Column, seeded: str) -> DataFrame:
        rows = df.select(*within, draw(seeded, *within, *order).alias("md5_"), code.cast("long").alias("code_"))
        packed = rows.mapInArrow(lambda it: _packed(it, within, ranges, digits), f"{keys}, range_ long, hashes_ binary, codes_ binary")
        told = packed.groupBy(*within, "range_").applyInArrow(ordered, f"{keys}, range_ long, n_ long, ties_ long, codes_ binary")
        return shared.written(told, "dealt", cleanup=True)

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, at = _large(row["codes_"]), row["base_"]
                cuts = [0, *range(width - at % width, len(codes), width), len(codes)]
                out = {c: [row[c]] * (len(cuts) - 1) for c in within}
                out |= {"block_": [(at + a) // width for a in cuts[:-1]], "at_": [at + a for a in cuts[:-1]], "side_": [row["side_"]] * (len(cuts) - 1)}
                out |= {"codes_": [_small(codes[a:b]) for a, b in zip(cuts, cuts[1:])]}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, batch.schema.field(c).type if c in within else pa.binary() if c == "codes_" else pa.int64()) for c, v in out.items()})

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["side_", "at_", "codes_"]).to_pylist(), key=lambda r: r["at_"])
        a, b = (np.concatenate([_large(r["codes_"]) for r in rows if r["side_"] == k]).astype(np.uint64) for k in (0, 1))
        pairs, n = np.unique(a << np.uint64(32) | b, return_counts=True)
        told = {c: pa.array([table[c][0].as_py()] * len(n), table[c].type) for c in within}
        return pa.table(told | {"slot": pa.array((pairs >> np.uint64(32)).astype(np.int64)), "value": pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    both = side(slot, f"{seed}@").withColumn("side_", F.lit(0).cast("long")).unionByName(side(value, seed).withColumn("side_", F.lit(1).cast("long")))
    if digits < 32 and both.where("ties_ > 0").limit(1).count():
        return joint_dealt(df, within, slot, value, order, seed, width, 32)
    earlier = Window.partitionBy("side_", *within).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    bases = both.select("side_", *within, "range_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("base_"))
    placed = both.join(bases, ["side_", *within, "range_"]).select(*within, "side_", "base_", "codes_")
    blocks = placed.mapInArrow(cut, f"{keys}, block_ long, at_ long, side_ long, codes_ binary")
    met = blocks.groupBy(*within, "block_").applyInArrow(meet, f"{keys}, slot long, value long, n long")
    return met.groupBy(*within, "slot", "value").agg(F.sum("n").alias("n"))


def redealt(df: DataFrame, within: Sequence[str], value: str, order: Sequence[str], seed: str | Column, size: str, width: int = WIDTH) -> DataFrame:
    """df with the boolean `value` dealt anew inside each group: as many rows have it, those that the hash puts first.

    `size` holds the rows of the row's group. Ranks are sums over ranges of the hash of about `width` rows, and a window
    inside each range, so a group may be of any size; `order` must be unique in it.
    """
    hashed = df.withColumn("hash_", draw(seed, *within, *order))
    hashed = hashed.withColumn("range_", F.floor(uniform(F.col("hash_")) * F.ceil(F.col(size) / width)))
    sums = hashed.groupBy(*within, "range_").agg(F.count("*").alias("rows_"), F.count_if(value).alias("true_"))
    group = Window.partitionBy(*within)
    earlier = group.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "range_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("base_"), F.sum("true_").over(group).alias("all_"))
    rank = F.row_number().over(Window.partitionBy(*within, "range_").orderBy("hash_", *order))
    ranked = hashed.withColumn("rank_", rank).join(sums, [*within, "range_"])
    return ranked.withColumn(value, F.col("base_") + F.col("rank_") <= F.col("all_")).drop("hash_", "range_", "rank_", "base_", "all_")


def split(df: DataFrame, seed: str, parts: Sequence[str], share: float) -> Column:
    """True for about `share` of the groups named by `parts`, whole groups at a time."""
    return uniform(draw(seed, *parts)) < share


def empirical_p(null: Column, real: Column) -> Column:
    """(1 + replicates at least as large) / (replicates + 1), as an aggregate."""
    return (1 + F.count_if(null >= real)) / (F.count(null) + 1)


def poisson_weight(u: Column) -> Column:
    """How often a row is drawn in a bootstrap replicate: a Poisson number of mean 1 by inverting its distribution."""
    out, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        out = F.when(u >= total, F.lit(k)).otherwise(out)
        term /= k
    return out
