"""Exact n-gram Jaccard self-join by parity sketches, pigeonhole keys per size band, and verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import blocks, graph
from quillon.llm.common import Scratch, attach, fresh, lookup, map_texts

#: Rounds in which each node is compared with single members of its keys, before all remaining pairs are.
ROUNDS = 2
#: Keys of more nodes than this, in several components, are given up for rarer ones, at most so many times over; what
#: is still left of them then is compared by blocks.
HOT, HOT_ROUNDS = 4096, 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """64-bit hashes of words; remembers the frequent ones."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 150_000:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=U, count=len(words))


def shingles(text: str | None, n: int, hashes: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; of all words together if there are fewer, none if none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=U)
    w = hashes(words)
    size = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, size, dtype=U)
        for k in range(size):
            h = mix(h * U(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
    return np.unique(h)


@dataclass(frozen=True)
class Rule:
    """Two sets of sizes x and y link when 100 * intersection >= percent * union."""

    words: int
    percent: int

    def most_apart(self, x, y):
        """The largest symmetric difference that linked sets of these sizes can have."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    def partner(self, x: int) -> int:
        """The largest set that one of x elements can link with."""
        return 100 * x // self.percent

    def bands(self, n: int) -> list[tuple[int, int]]:
        """The size bands in which a set of n elements is looked for: (first size, size after the last).

        A band belongs to the smaller set of a pair, so a set is in its own band and in those of smaller sets that it
        can link with. Bands grow by a half.
        """
        out, low = [], 1
        while low <= n:
            high = max(low + 1, low * 3 // 2)
            if self.partner(high - 1) >= n:
                out.append((low, high))
            low = high
        return out

    @lru_cache(maxsize=4096)  # noqa: B019 (rules are few and small)
    def layout(self, low: int, high: int, n: int) -> tuple[int, int]:
        """Segments in a band, and how many of them a set of n elements offers as keys there.

        With d the largest difference of any pair of the band, there are half as many again as d + 1 segments; small
        bands have more, so that the chance that a smallest set fills no more segments than it may differ in is below a
        millionth.
        """
        d = int(self.most_apart(high - 1, self.partner(high - 1)))
        m = d + 1 + (d + 1) // 2 if d else 1
        least = int(self.most_apart(low, self.partner(low))) or int(d > 0)
        if least:
            # sets of `low` elements that fall into `least` of m segments: about m ** (least - low) * least ** low / least!
            spare = max(1, low - least)
            bits = (20 * math.log(2) + low * math.log(least) - math.lgamma(least + 1)) / spare
            m = max(m, int(min(math.exp(min(bits, 12)), 1 << 16)))
        own = self.partner(n) if n < high else n
        return m, int(self.most_apart(min(n, high - 1), own)) + 1

    def ranked(self, h: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each band of the set: its segments as keys, the fullest first, and how many of them it offers.

        Shingles fall by hash into m segments, each with a parity sketch of 2 ** 32 bits, kept as the XOR of a code for
        each set bit: equal sketches have equal codes. A pair that differs in D shingles has at least m - D segments
        alike, which rank alike in both sets, so the first of them has m - D - 1 after it in both. A set that can
        differ in at most a >= D shingles from any partner may leave out its last m - 1 - a segments: the pair's first
        like segment is in both sets' first a + 1. An empty segment is a key only in a set that fills no more than a.
        """
        out = []
        with np.errstate(over="ignore"):
            for low, high in self.bands(len(h)):
                m, keep = self.layout(low, high, len(h))
                x = mix(h + U(low) * U(0xD6E8FEB86659FD93))
                segment = ((x >> U(32)) * U(m)) >> U(32)
                order = np.argsort(segment)
                segment, bit = segment[order], (x & U(0xFFFFFFFF))[order]
                first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
                code = np.bitwise_xor.reduceat(mix((segment << U(32)) | bit), first)
                size = np.diff(np.append(first, len(segment)))
                at = segment[first]
                by = np.lexsort((at, code, size))[::-1]
                at, code = at[by], code[by]
                if len(at) < keep:
                    empty = np.setdiff1d(np.arange(m, dtype=U), at)[::-1][: keep - len(at)]
                    at, code = np.concatenate([at, empty]), np.concatenate([code, np.zeros(len(empty), dtype=U)])
                out.append((mix(mix(code + at * U(0x9E3779B97F4A7C15)) + U(low)), keep))
        return out

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Pigeonhole keys: two sets that link have one in common."""
        out = [k[:keep] for k, keep in self.ranked(h)]
        return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)

    def rarer(self, h: np.ndarray, hot: set[int]) -> tuple[list[int], list[int]]:
        """Keys if those in `hot` rank last in every set: the others, and the hot ones without which there are too few."""
        out: tuple[list[int], list[int]] = [], []
        for k, keep in self.ranked(h):
            told = k.view(np.int64).tolist()
            others = [x for x in told if x not in hot][:keep]
            out[0].extend(others)
            out[1].extend([x for x in told if x in hot][: keep - len(others)])
        return out

    def sketch(self, h: np.ndarray) -> bytes:
        """The whole set's parity sketch, 16 bits for each element of the largest difference: folds by XOR of halves."""
        bits = 256
        while bits < 16 * int(self.most_apart(len(h), self.partner(len(h)))):
            bits *= 2
        at = (mix(h ^ U(0xA0761D6478BD642F)) & U(bits - 1)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits, over the last axis."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def hamming(a: bytes, b: bytes) -> int:
    """Never more than the sets' symmetric difference: each shingle that only one has turns one bit."""
    x, y = np.frombuffer(a, dtype=U), np.frombuffer(b, dtype=U)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def _apart(pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, apart): the pairs (a, b, na, nb, sa, sb) whose sketches' distance the sizes allow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [(a, b, d) for a, b, na, nb, x, y in rows if (d := hamming(x, y)) <= rule.most_apart(na, nb)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "apart"])

    return map_texts(pairs.select("a", "b", "na", "nb", "sa", "sb"), task, "a long, b long, apart long")


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, h1 and h2 (128 bits for the whole set), keys, sketch of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                n, h1, h2, keys, sketches = [], [], [], [], []
                for t in texts.slice(at, 500):
                    h = shingles(t.as_py(), rule.words, hashes)
                    n.append(len(h))
                    digest = xxhash.xxh3_128_intdigest(h.tobytes())
                    h1.append((digest >> 64) - (1 << 63))
                    h2.append((digest & (1 << 64) - 1) - (1 << 63))
                    keys.append(rule.keys(h))
                    sketches.append(rule.sketch(h) if len(h) else b"")
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 500),
                        pa.array(n, pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "keys", "sketch"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(own, task, "doc_id long, n long, h1 long, h2 long, keys array<long>, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """(node, set) for the documents with the given ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t.as_py(), rule.words, hashes).view(np.int64) for t in batch.column(1).slice(at, 500)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 500), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["node", "elements"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return map_texts(own.join(ids, "node", "left_semi"), task, "node long, elements array<long>")


def _rarer(docs: DataFrame, hot: DataFrame, rule: Rule) -> DataFrame:
    """(node, key, short) for the nodes of hot (node, hot: their keys to be given up): Rule.rarer() of their texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            rows = []
            for node, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for short, keys in enumerate(rule.rarer(shingles(text.as_py(), rule.words, hashes), set(gone))):
                    rows += [(node, k, bool(short)) for k in keys]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "key", "short"])

    own = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return map_texts(own.join(hot, "node").select("node", "text", "hot"), task, "node long, key long, short boolean").distinct()


def _without_hot(placed: DataFrame, keyed: DataFrame, comps: DataFrame, docs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(key, node, comp): placed, in which keys of over HOT nodes have been given up for rarer ones of the same sets.

    If all sets rank the hot keys last, linked sets still have a key in common among those that each then offers. The
    sets that offered a hot key offer the next ones instead, which are put together with all sets that have them; a
    key that turns out hot by this is given up as well. Only sets with too few other keys are left in a hot one.
    """
    known, short = None, None
    for step in range(HOT_ROUNDS):
        large = scratch.table(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), f"large{step}")
        if large.isEmpty():
            break
        gone = scratch.table(placed.join(large, "key", "left_semi").select("node", "key"), f"gone{step}")
        known = gone if known is None else known.unionByName(gone)
        todo = known.join(gone.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("key").alias("hot"))
        offered = scratch.table(_rarer(docs, scratch.table(todo, f"todo{step}"), rule), f"offered{step}")
        left = offered.where("short").select("key", "node")
        short = left if short is None else short.unionByName(left)
        new = offered.where("not short").select("key", "node")
        # put together with all that have these keys, hot ones of earlier rounds included: they turn out hot again
        own = keyed.join(new.select("key").distinct(), "key", "left_semi").select("key", "node")
        more = new.unionByName(own).distinct().join(comps, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        rest = placed.join(large, "key", "left_anti").unionByName(more).distinct()
        mixed = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        placed = scratch.table(rest.join(mixed.select("key"), "key").select("key", "node", "comp"), f"rarer{step}")
    if short is not None:
        left = short.distinct().join(comps, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        placed = scratch.table(placed.unionByName(left).distinct(), "placed")
    return placed


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link, by the sets themselves."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.table(_sets(docs, ids, rule), f"{name}_sets")
    both = attach(pairs.select("a", "b"), "a", "b", sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), scratch)
    both = attach(both, "b", "a", sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), scratch)
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    out = scratch.table(both.where(100 * shared >= rule.percent * union).select("a", "b").distinct(), name)
    scratch.drop(f"{name}_sets")
    return out


def _bound(rule: Rule) -> Column:
    """Sizes that can link at all."""
    return 100 * F.least("na", "nb") >= rule.percent * F.greatest("na", "nb")


def _near(members: list[tuple], rule: Rule) -> list[tuple]:
    """Pairs of one group's members (node, component, n, sketch, own, low, high) that sizes and sketches allow.

    Only pairs of different components, and of different blocks where two meet.
    """
    if len(members) < 2 or len({m[1] for m in members}) < 2:
        return []
    node, comp, n = (np.array([m[i] for m in members], dtype=np.int64) for i in range(3))
    own = np.array([m[4] for m in members])
    cross = members[0][5] != members[0][6]
    size = min(len(m[3]) for m in members) // 8
    sketch = np.stack([fold(np.frombuffer(m[3], dtype=U), size) for m in members])
    out = []
    for i in range(len(members) - 1):
        rest = slice(i + 1, None)
        ok = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= rule.percent * np.maximum(n[rest], n[i]))
        if cross:
            ok &= own[rest] != own[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
            for k in j[apart <= rule.most_apart(n[j], n[i])]:
                a, b = sorted((int(node[i]), int(node[k])))
                out.append((a, b, int(n[i] if a == node[i] else n[k]), int(n[k] if a == node[i] else n[i])))
    return out


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    A document's set: distinct shingles of `words` words, A-Z lower-cased, words parted by ASCII white space; all its
    words as one shingle if there are fewer; empty without words. Two documents link when 100 * intersection >=
    percent * union. The join is exact up to collisions of 64-bit hashes within a pair of sets.

    1. Each text is read once for its set's hash, pigeonhole keys and parity sketch. Equal sets become one node, the
       smallest doc_id, before anything is joined.
    2. Nodes are sorted by key; a node's candidates are the first nodes of its keys, in an order that differs by key, so
       a group of any size gives one candidate for each member and key. Sketches whose Hamming distance is over the
       largest allowed difference end a candidate. Of the rest each node has two verified on the sets, and components
       are formed.
    3. Keys whose nodes are in different components are looked at again. Those of over HOT nodes, which a passage that
       many texts share makes, are given up for rarer ones of the same sets. Then, by pairs of blocks, all remaining
       pairs that sizes and sketches allow are verified, and components are joined. No link between components is left
       out.

    A node of many candidates is verified in as many tasks as it needs, and a set that very many rows have is sent to
    all in the end, so no task grows with a group.

    docs: doc_id and text are read, others ignored. A null or empty text has no shingles and its own doc_id as
    component. Rows with an equal doc_id are one node: they link where any of their texts does. Rows with a null doc_id
    link with nothing and have a null component. An empty table gives no rows.
    """
    rule = Rule(words, percent)
    scratch = Scratch(docs.sparkSession, "jaccard")
    # keys, and the shuffles that they go through, are the bulk of what is on disk: each is deleted once it has served
    feats = scratch.table(features(docs, rule), "features")
    rows = scratch.table(feats.select("doc_id", "n", "h1", "h2"), "rows")
    full = feats.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")
    )
    full = scratch.table(full, "full")
    scratch.drop("features")
    keyed = full.select("node", F.explode("keys").alias("key"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    multi = keyed.select("key", "node", F.first("node").over(order).alias("pivot"), F.lead("node").over(order).alias("next"))
    multi = scratch.table(multi.where("node <> pivot or next is not null").select("key", "node", "pivot"), "multi")
    slim = full.select("node", "n", "sketch")

    def sized(pairs: DataFrame) -> DataFrame:
        a = slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return attach(attach(pairs, "a", "b", a, scratch), "b", "a", b, scratch).where(_bound(rule))

    def chosen(pairs: DataFrame, name: str) -> DataFrame:
        """Of the candidates that sizes and sketches allow, each node's nearest and the one that most nodes share."""
        per = _apart(sized(pairs), rule).groupBy("a").agg(
            F.min(F.struct("apart", "b"))["b"].alias("nearest"), F.min(F.struct(F.xxhash64("b"), "b"))["b"].alias("common")
        )
        out = per.select("a", F.explode(F.array_distinct(F.array("nearest", "common"))).alias("b"))
        return scratch.table(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)

    placed, links, tried, comps = multi, None, None, None
    for step in range(ROUNDS):
        if step:
            order = Window.partitionBy("key").orderBy(F.xxhash64("key", "node", F.lit(step)), "node")
            at = placed.select("key", "node", "comp", F.first("node").over(order).alias("pivot"), F.first("comp").over(order).alias("pc"))
            at = at.where("comp <> pc")
        else:
            at = multi.where("node <> pivot")
        pairs = chosen(at.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), f"pairs{step}")
        found = _verified(pairs, docs, rule, scratch, f"links{step}")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        comps = scratch.table(graph.components(links, scratch, f"cc{step}"), f"comps{step}")
        placed = placed.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        placed = scratch.table(placed.join(mixed.select("key"), "key").select("key", "node", "comp"), f"rest{step}")
    placed = _without_hot(placed, keyed, comps, docs, rule, scratch)
    met = blocks.paired(placed.join(slim, "node").select("key", "node", "comp", "n", "sketch"), "key", "node")
    near = blocks.each_group(
        met.withColumns({"low_": F.col("low"), "high_": F.col("high")}),
        ["key", "low", "high"],
        ["node", "comp", "n", "sketch", "own", "low_", "high_"],
        "a long, b long, na long, nb long",
        lambda members: _near(members, rule),
    )
    near = scratch.table(near.select("a", "b").distinct(), "near")
    more = _verified(near.join(tried.distinct(), ["a", "b"], "left_anti"), docs, rule, scratch, "links")
    if not more.isEmpty():
        comps = graph.components(links.unionByName(more), scratch, "cc")

    found = full.select("h1", "h2", "n", "node", "copies").join(comps, "node", "left")
    found = scratch.table(found.select("h1", "h2", "n", "copies", F.coalesce("root", "node").alias("component")), "found")
    scratch.keep("rows", "found")
    told = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    linked = lookup(rows.where(told), found, ["h1", "h2", "n"], "copies").select("doc_id", "n", "component")
    alone = rows.where(~told).select("doc_id", "n", F.col("doc_id").alias("component"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def clean(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Documents without words and rows with a null doc_id stay; rows with one doc_id are one document.
    """
    key = fresh(docs, "key")
    gone = components(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")
