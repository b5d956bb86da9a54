"""Near-duplicate lines: a segment-partition edit join with bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import blocks
from quillon.llm.common import Scratch, attach, fresh, lookup, map_texts
from quillon.llm.ngram_join import mix

#: Line hashes that a task remembers, so that a common line's keys leave it once; forgetting only repeats them.
REMEMBERED = 200_000
#: A line must have so many characters for each edit that counts as near: two edits are most of a short line.
PER_EDIT = 10
#: Keys of more lines than this are taken apart by a second segment, and those by a third, before pairs are looked at.
HOT, LEVELS = 4096, 3
#: Two strings' bags of characters, in so many bins, differ by at most two for each edit.
BINS = 64
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
WHITE = " \t\r\x0b\x0c"
U = np.uint64


def tolerance(length: int, edits: int) -> int:
    """The edits within which a line of `length` characters is near one that isn't shorter."""
    return min(edits, length // PER_EDIT)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the edits + 1 segments of a line of `length` characters, the longer ones last."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        own = size + (i >= edits + 1 - longer)
        out.append((at, own))
        at += own
    return out


def probes(length: int, short: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings with which a line looks lines of `short` characters up, which isn't more.

    For a shift of D = length - short, segment i (from 0) at p is met, in any pair within `edits`, by a substring that
    starts within i of p, and within edits - i of p + D: left of the segment at most i edits can lie if it is the first
    to be met, right of it at most edits - i.
    """
    out, shift = [], length - short
    for i, (p, size) in enumerate(segments(short, edits)):
        low = max(0, p - i, p + shift - (edits - i))
        high = min(length - size, p + i, p + shift + (edits - i))
        out += [(i, s, size) for s in range(low, high + 1)]
    return out


class Layout:
    """Substrings of a string by place: the indexed length that each looks for, its segment, and whether it is the index's own."""

    def __init__(self, told: list[tuple[int, int, int, int, bool]]):
        cols = list(zip(*told, strict=True)) or [()] * 5
        self.short, segment, self.start, self.size = (np.array(c, dtype=np.int64) for c in cols[:4])
        self.tag = mix((self.short * 64 + segment).astype(U))
        self.index = np.array(cols[4], dtype=U)


@lru_cache(maxsize=20_000)
def whole(length: int, edits: int) -> Layout:
    """A line's own segments and all its probes."""
    out = []
    for short in range(max(1, length - edits), length + 1):
        e = tolerance(short, edits)
        if e and length - short <= e:
            own = set(segments(short, e)) if short == length else ()
            out += [(short, i, s, size, (s, size) in own) for i, s, size in probes(length, short, e)]
    return Layout(out)


@lru_cache(maxsize=20_000)
def remaining(length: int, short: int, edits: int, index: bool) -> Layout:
    """The same for what is left of a line: it is looked for, or looks for lines of which `short` characters are left."""
    own = set(segments(short, edits)) if index else ()
    return Layout([(short, i, s, size, (s, size) in own) for i, s, size in probes(length, short, edits)])


def keys(texts: list[str], layouts: list[Layout]) -> tuple[np.ndarray, np.ndarray]:
    """For each text in turn its layout's keys, and how many there are: equal ones mean equal substrings and tags.

    The lowest bit says whether the key is the index's own. Substrings are hashed by differences of one running sum over
    all texts.
    """
    counts = np.array([len(x.start) for x in layouts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U)
    n = len(points)
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.concatenate([[U(1)], np.full(n, U(x))])) for x in (BASE, BACK))
        sums = np.concatenate([[U(0)], np.cumsum(mix(points + U(1)) * power[:n])])
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64) if texts else np.empty(0, np.int64)
        whole_of = lambda name: np.concatenate([getattr(x, name) for x in layouts])
        if not counts.sum():
            return np.empty(0, dtype=U), counts
        start = whole_of("start") + np.repeat(base, counts)
        value = (sums[start + whole_of("size")] - sums[start]) * back[start]
        out = mix(value + whole_of("tag"))
    return (out & ~U(1)) | whole_of("index"), counts


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is `edits` or less, by bit-parallel columns.

    Equal beginnings and ends are cut off. Of the rest a diagonal band of 2 * edits + 1 cells is kept for each number of
    edits as one bit vector: bit j of row e says that the first i characters of a and some first characters of b, j -
    edits further, are reached with e edits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    start, m = 0, min(len(a), len(b))
    while start + 64 <= m and a[start : start + 64] == b[start : start + 64]:
        start += 64
    while start < m and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end, m = 0, min(len(a), len(b))
    while end + 64 <= m and a[len(a) - end - 64 : len(a) - end] == b[len(b) - end - 64 : len(b) - end]:
        end += 64
    while end < m and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    wide = (1 << (2 * edits + 1)) - 1
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + edits)  # shifted by the band's half, so early rows need no case
    # before the first character: with e edits the first e characters of b can be skipped
    rows = [((1 << (e + 1)) - 1) << edits & wide for e in range(edits + 1)]
    for i, c in enumerate(a):
        same = places.get(c, 0) >> i & wide
        last, out = 0, []
        for e, row in enumerate(rows):
            # bit j now stands for b's first i + 1 + j - edits characters
            now = row & same
            if e:
                before = rows[e - 1]
                now |= before | before >> 1 | out[e - 1] << 1
            out.append(now & wide)
            last |= out[-1]
        if not last:
            return False
        rows = out
    at = len(b) - len(a) + edits
    return 0 <= at <= 2 * edits and any(row >> at & 1 for row in rows)


def lines(docs: DataFrame, edits: int) -> DataFrame:
    """doc_id, version (a hash of the text), line_no, h1, h2 (of the line), keys; for lines that aren't blank.

    The lowest bit of a key says that it is the index's own. keys are null where the task has already sent those of an
    equal line. h1 is what Spark's xxhash64 gives.
    """
    names = ["doc_id", "version", "line_no", "h1", "h2", "keys"]

    def batch_of(out: list[tuple], texts: list[str]) -> pa.RecordBatch:
        found, counts = keys(texts, [whole(len(t), edits) for t in texts])
        line = np.repeat(np.arange(len(texts)), counts)
        # a line's equal keys once, as the index's own if one of them is
        order = np.lexsort((~found, found >> U(1), line))
        found, line = found[order], line[order]
        once = np.concatenate([[True], (found[1:] >> U(1) != found[:-1] >> U(1)) | (line[1:] != line[:-1])]) if len(found) else np.empty(0, bool)
        found, line = found[once], line[once]
        ends = np.concatenate([[0], np.searchsorted(line, np.arange(len(texts)), side="right")])
        cols = list(zip(*out, strict=True))
        offsets = pa.array([None if k is None else int(ends[k]) for k in cols[5]] + [len(found)], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), lists], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out, texts, chars = [], [], 0
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for no, line in enumerate((text.as_py() or "").split("\n")):
                    line = line.strip(WHITE)
                    if not line:
                        continue
                    data = line.encode("utf-8", "surrogatepass")
                    h1, h2 = signed(xxhash.xxh64_intdigest(data, seed=42)), signed(xxhash.xxh3_64_intdigest(data))
                    told = None
                    if len(line) >= PER_EDIT and edits and h1 not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(h1)
                        told = len(texts)
                        texts.append(line)
                        chars += len(line)
                    out.append((doc, version, no, h1, h2, told))
                if len(out) > 5000 or chars > 500_000:
                    yield batch_of(out, texts)
                    out, texts, chars = [], [], 0
            if out:
                yield batch_of(out, texts)

    return map_texts(versions(docs), task, "doc_id long, version long, line_no long, h1 long, h2 long, keys array<long>")


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, version, text: rows with an equal doc_id and different texts are told apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def bags(texts: list[str]) -> np.ndarray:
    """How often each bin's characters stand in each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    line = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(line * BINS + points % BINS, minlength=len(texts) * BINS).reshape(-1, BINS).astype(np.int32)


def _later(members: list[tuple], edits: int) -> list[tuple]:
    """(line) of one group's lines that are near an earlier one; members: first, line, index, open, own, low, high, text.

    Lines that aren't open are known to be near an earlier one, and only compared with.
    """
    if len(members) < 2:
        return []
    cross = members[0][5] != members[0][6]
    by = sorted(range(len(members)), key=lambda i: (tuple((v is not None, v or 0) for v in members[i][0].values()), members[i][1]))
    members = [members[i] for i in by]
    texts = [m[7] for m in members]
    n, bag = np.array([len(t) for t in texts]), bags(texts)
    index, own = np.array([m[2] for m in members], dtype=bool), np.array([m[4] for m in members])
    most = np.minimum(edits, n // PER_EDIT)
    out = []
    for k in range(1, len(members)):
        if not members[k][3]:
            continue
        near = np.minimum(most[:k], most[k])
        ok = (np.abs(n[:k] - n[k]) <= near) & (near > 0)
        if not index[k]:
            ok &= index[:k]
        if cross:
            ok &= own[:k] != own[k]
        at = np.flatnonzero(ok)
        if len(at):
            at = at[np.abs(bag[at] - bag[k]).sum(axis=1) <= 2 * near[at]]
        if any(within(texts[j], texts[k], int(near[j])) for j in at):
            out.append((members[k][1],))
    return out


def _refined(rows: DataFrame, edits: int) -> DataFrame:
    """(key, line, index, rest, parent, short): the lines of hot keys by the segments of what is left of them.

    rows: the same; parent and short are null where rest is the whole line. Two lines within `edits` that have an
    aligned segment in common are within `edits` without it as well, so that some segment of the rest is met again.
    """
    names = ["key", "line", "index", "rest", "parent", "short"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]

    def combined(found: np.ndarray, parents: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(parents == 0, found & ~U(1), mix((found >> U(1)) ^ parents) & ~U(1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            layouts = [whole(len(r[3]), edits) if r[4] is None else remaining(len(r[3]), r[5], r[6], r[2]) for r in told]
            found, counts = keys([r[3] for r in told], layouts)
            line = np.repeat(np.arange(len(told)), counts)
            parent = np.array([r[4] or 0 for r in told], dtype=np.int64).view(U)
            same = combined(found, parent[line]) == np.array([r[0] for r in told], dtype=np.int64).view(U)[line]
            place = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
            new = []
            for k, at in zip(line[same].tolist(), place[same].tolist(), strict=True):
                key, own, index, rest, _, short, e = told[k]
                a, size = int(layouts[k].start[at]), int(layouts[k].size[at])
                if short is None:
                    short = int(layouts[k].short[at])
                    e = tolerance(short, edits)
                    index = bool(layouts[k].index[at])
                new.append((key, own, index, rest[:a] + rest[a + size :], short - size, e))
            new = list(dict.fromkeys(new))
            split = [x for x in new if x[4] > x[5]]
            layouts = [remaining(len(x[3]), x[4], x[5], x[2]) for x in split]
            found, counts = keys([x[3] for x in split], layouts)
            line = np.repeat(np.arange(len(split)), counts)
            parent = np.array([x[0] for x in split], dtype=np.int64).view(U)
            made = combined(found, parent[line]).view(np.int64).tolist()
            rows = {}
            for k, key, index in zip(line.tolist(), made, (found & U(1)).tolist(), strict=True):
                x = split[k]
                rows[(key, x[1], bool(index), x[3], x[0], x[4], x[5])] = None
            for x in new:  # too little is left to be taken apart: they stay together
                if x[4] <= x[5]:
                    rows[(signed(int(mix(np.array([x[0]], dtype=np.int64).view(U))[0]) & ~1), x[1], x[2], x[3], x[0], x[4], x[5])] = None
            for at in range(0, len(rows), 20_000):
                part = list(rows)[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), [*types, pa.int64()])], names=[*names, "e"])

    schema = "key long, line long, index boolean, rest string, parent long, short long, e long"
    return map_texts(rows.select(*names, "e"), task, schema)


def _near_first(rows: DataFrame, edits: int, scratch: Scratch, name: str) -> DataFrame:
    """(line): open lines of rows (key, line, first, text, open) that are near the first line of their key or its first open one."""
    first = rows.groupBy("key").agg(F.min(F.struct("first", "line"))["line"].alias("a"), F.min(F.when(F.col("open"), F.struct("first", "line")))["line"].alias("b"))
    pairs = rows.where("open").join(first, "key").select("line", F.explode(F.array("a", "b")).alias("pivot")).where("line <> pivot").distinct()
    texts = rows.select("line", "first", "text").distinct()
    pairs = pairs.join(texts, "line")
    pivots = texts.select(F.col("line").alias("pivot"), F.col("first").alias("pivot_first"), F.col("text").alias("pivot_text"))
    pairs = attach(pairs, "pivot", "line", pivots, scratch).where("pivot_first < first")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            near = [x for x, a, b in rows if within(a, b, tolerance(min(len(a), len(b)), edits))]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], names=["line"])

    return scratch.table(map_texts(pairs.select("line", "text", "pivot_text"), task, "line long").distinct(), name)


def _apart(members: DataFrame, edits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """members (key, line, index, first, text, open) without keys of over HOT lines, and lines found near on the way.

    The lines of a hot key are first compared with two of them, which ends most of a group of true repeats. If others
    are open still, all its lines get keys of two segments, and of more where these are hot too.
    """
    none = F.lit(None).cast("long")
    rows = members.select("key", "line", "index", F.col("text").alias("rest"), none.alias("parent"), none.alias("short"), none.alias("e"))
    texts = members.select("line", "first", "text").distinct()
    done, closed = None, None

    def marked(df: DataFrame) -> DataFrame:
        if closed is None:
            return df.withColumn("open", F.lit(True))
        known = closed.withColumn("closed", F.lit(True))
        return df.join(known, "line", "left").withColumn("open", F.col("closed").isNull()).drop("closed")

    for level in range(LEVELS + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        large = scratch.table(sizes.where(F.col("n") > HOT).select("key"), f"large{level}")
        if large.isEmpty():
            break
        hot = scratch.table(rows.join(large, "key", "left_semi"), f"hot{level}")
        seen = marked(hot.select("key", "line").distinct().join(texts, "line"))
        seen = scratch.table(seen.select("key", "line", "first", "text", "open"), f"seen{level}")
        found = _near_first(seen, edits, scratch, f"pivots{level}")
        closed = found if closed is None else scratch.table(closed.unionByName(found).distinct(), f"closed{level}")
        # keys in which a line other than the first is open
        head = seen.groupBy("key").agg(F.min(F.struct("first", "line"))["line"].alias("head"))
        some = marked(seen.drop("open")).where("open").join(head, "key").where("line <> head").select("key").distinct()
        hot = hot.join(some, "key", "left_semi")
        rest = rows.join(large, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if level == LEVELS:
            done = done.unionByName(hot)
            rows = rows.limit(0)
            break
        new = scratch.table(_refined(hot, edits), f"refined{level}")
        several = new.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.max("index").alias("c")).where("a <> b and c").select("key")
        rows = scratch.table(new.join(several, "key", "left_semi"), f"level{level}")
    rows = rows if done is None else done.unionByName(rows)
    left = rows.groupBy("key", "line").agg(F.max("index").alias("index")).join(texts, "line")
    return marked(left).select("key", "line", "index", "first", "text", "open"), closed


def repeats(docs: DataFrame, edits: int = 2) -> DataFrame:
    """One row per line to drop: doc_id, version, line_no, near (true: an earlier line that differs is near; false: equal only).

    Lines are parted by \\n and stripped of ASCII white space; blank ones stay. Of equal lines the first in the order of
    (doc_id, version, line_no) stays. A line is dropped in all its places if a line that first occurs earlier is within
    `edits` insertions, deletions and substitutions of it, whether or not that one is dropped itself; for each of these
    the shorter of the two must have PER_EDIT characters, so lines of fewer are only dropped if an equal one is earlier.

    1. The texts are read once. Each line gives a hash and, once a task, keys: the hash of each of its edits + 1
       segments with length and place, and of the substrings that could meet a segment of a line not longer than it.
    2. Keys are sorted; those that hold one line alone are gone at once. The others' lines are looked up in the texts.
    3. Keys of very many lines are taken apart by further segments. In each key the lines are verified in order of first
       occurrence, each until one earlier line is near, in pairs of blocks of a bounded size; no group is held by one
       task and no pairs leave it. Bags of characters sort most pairs out before the bit-parallel distance.

    docs: doc_id and text are read, others ignored. A null or empty text has no lines; a null doc_id comes first in the
    order. Rows are known by doc_id and text (`version` is its hash): of a repeated row every line stays as in the
    first, and different texts with one doc_id are different documents. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    told = scratch.table(lines(docs, edits), "lines")
    # equal lines: their first place; counts meet before they are dealt, however common a line is
    places = F.struct("doc_id", "version", "line_no")
    distinct = scratch.table(told.groupBy("h1", "h2").agg(F.min(places).alias("first"), F.count("*").alias("copies")), "distinct")

    keyed = told.where("keys is not null").select(F.col("h1").alias("line"), F.explode("keys").alias("k"))
    keyed = keyed.select(F.col("k").bitwiseAND(F.lit(-2)).alias("key"), "line", (F.col("k").bitwiseAND(F.lit(1)) == 1).alias("index"))
    order = Window.partitionBy("key").orderBy("line")
    near = keyed.withColumns({"before": F.lag("line").over(order), "after": F.lead("line").over(order)})
    multi = scratch.table(near.where("before <> line or after <> line").select("key", "line", "index"), "multi")
    multi = multi.groupBy("key", "line").agg(F.max("index").alias("index"))
    told = scratch.table(told.drop("keys"), "rows")
    scratch.drop("lines")

    wanted = distinct.join(multi.select(F.col("line").alias("h1")).distinct(), "h1", "left_semi")
    by_doc = wanted.groupBy("first.doc_id", "first.version").agg(F.collect_list(F.struct(F.col("h1").alias("line"), "first")).alias("told"))
    own, by_doc = versions(docs).alias("o"), by_doc.alias("w")
    text = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(WHITE)))
    found = (
        own.join(by_doc, F.col("o.version").eqNullSafe(F.col("w.version")) & F.col("o.doc_id").eqNullSafe(F.col("w.doc_id")))
        .select(text.alias("lines"), F.explode("told").alias("t"))
        .select("t.line", "t.first", F.get("lines", F.col("t.first.line_no").cast("int")).alias("text"))
        .where(F.xxhash64("text") == F.col("line"))
        .groupBy("line")
        .agg(F.min("first").alias("first"), F.max("text").alias("text"))
    )
    found = scratch.table(found, "texts")

    members = scratch.table(multi.join(found, "line").select("key", "line", "index", "first", "text"), "members")
    members, near_first = _apart(members, edits, scratch)
    dealt = blocks.paired(members, "key", "line").withColumns({"low_": F.col("low"), "high_": F.col("high")})
    later = blocks.each_group(
        dealt,
        ["key", "low", "high"],
        ["first", "line", "index", "open", "own", "low_", "high_", "text"],
        "h1 long",
        lambda group: _later(group, edits),
    )
    if near_first is not None:
        later = later.unionByName(near_first.select(F.col("line").alias("h1")))
    later = scratch.table(later.distinct(), "later").withColumn("near", F.lit(True))
    firsts = scratch.table(distinct.join(later, "h1", "left"), "firsts")
    scratch.keep("rows", "firsts")
    every = lookup(told.select("doc_id", "version", "line_no", "h1", "h2"), firsts, ["h1", "h2"], "copies")
    own_place = [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "version", "line_no")]
    near = F.coalesce("near", F.lit(False))
    every = every.where(~(own_place[0] & own_place[1] & own_place[2]) | near)
    return every.select("doc_id", "version", "line_no", near.alias("near")).distinct()


def digest(docs: DataFrame, edits: int = 2) -> DataFrame:
    """One row per distinct doc_id and text: doc_id, dropped (line numbers in order), n_near (those near an earlier, different line)."""
    gone = repeats(docs, edits).groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_list("line_no")).alias("dropped"), F.sum(F.col("near").cast("long")).alias("n_near")
    )
    ids = versions(docs).select("doc_id", "version").distinct()
    joined = ids.join(gone, (ids["version"] == gone["version"]) & ids["doc_id"].eqNullSafe(gone["doc_id"]), "left")
    return joined.select(
        ids["doc_id"],
        F.coalesce("dropped", F.array().cast("array<bigint>")).alias("dropped"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def clean(docs: DataFrame, edits: int = 2) -> DataFrame:
    """docs without the lines of repeats(), with the same columns; documents left without a word go.

    Documents that lose no line stay as they are. n_chars, where there is such a column, follows the text.
    """
    key, version, gone, text = (fresh(docs, x) for x in ("key", "version", "gone", "text"))
    lost = repeats(docs, edits).groupBy(F.col("doc_id").alias(key), F.col("version").alias(version)).agg(
        F.collect_set(F.col("line_no").cast("int")).alias(gone)
    )
    same = docs["doc_id"].cast("long").eqNullSafe(lost[key]) & (F.xxhash64(docs["text"].cast("string")) == lost[version])
    joined = docs.join(lost, same, "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    untouched = F.col(gone).isNull()
    joined = joined.withColumn(text, F.when(untouched, F.col("text")).otherwise(left))
    joined = joined.where(untouched | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        n = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(untouched, F.col("n_chars")).otherwise(n)
    return joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
