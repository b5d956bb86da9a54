"""Benchmark passages in documents, found by one automaton over all benchmark windows."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillon.llm.common import WORD_BYTES, Scratch, map_texts

#: A word after A-Z became a-z, in the original text.
ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of patterns in one automaton; about 60 bytes of memory each.
BLOCK_CHARS = 2_000_000
SCHEMA = (
    "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Block:
    """Patterns (space, words, space, as latin-1) with the items they come from."""

    key: str
    patterns: dict[str, tuple[int, tuple[str, ...]]]


def blocks(items: Iterable[Row], window: int, limit: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark's windows in blocks of a bounded size. An item without words has none."""
    found: dict[str, tuple[int, set[str]]] = {}
    chars = 0

    def block() -> Block:
        key = hashlib.sha256("\n".join(f"{p}\t{sorted(i)}" for p, (_, i) in found.items()).encode()).hexdigest()
        return Block(key, {p: (n, tuple(sorted(i))) for p, (n, i) in found.items()})

    for item_id, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            pattern = (b" " + b" ".join(part) + b" ").decode("latin-1")
            if pattern not in found:
                if chars > limit:
                    yield block()
                    found, chars = {}, 0
                found[pattern] = (len(part), set())
                chars += len(pattern)
            if item_id is not None:
                found[pattern][1].add(str(item_id))
    if found:
        yield block()


_built: dict[str, object] = {}


def automaton(block: Block):
    """The block's automaton; a Python worker keeps the last one that it built."""
    import ahocorasick

    if block.key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for pattern, value in block.patterns.items():
            a.add_word(pattern, value)
        a.make_automaton()
        _built[block.key] = a
    return _built[block.key]


def hits(machine, text: str | None) -> tuple[int, np.ndarray | None, set[str]]:
    """How many words a text has, which of them are hit (None: none), and the items with windows that occur."""
    w = words(text)
    if not w or machine is None:
        return len(w), None, set()
    line = b" " + b" ".join(w) + b" "
    ends: list[int] = []
    sizes: list[int] = []
    items: set[str] = set()
    for end, (size, ids) in machine.iter(line.decode("latin-1")):
        ends.append(end)
        sizes.append(size)
        items.update(ids)
    if not ends:
        return len(w), None, items
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    last = np.searchsorted(gaps, np.array(ends))  # the match ends with the space after word last - 1
    steps = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(steps, last - np.array(sizes), 1)
    np.add.at(steps, last, -1)
    return len(w), np.cumsum(steps[:-1]) > 0, items


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word, the last exclusive, of each run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as places in the original text, in code points."""
    at = [m.span() for m in ORIGINAL.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(*runs(hit), strict=True)]


def _row(text: str, n: int, hit: np.ndarray | None, items) -> tuple:
    return n, 0 if hit is None else int(hit.sum()), sorted(items), [] if hit is None else spans(text, hit)


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), place]
    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])


def _items(benchmark: DataFrame) -> Iterator[Row]:
    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator()


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its words, those inside any occurrence of a benchmark window, the items, the places.

    A window is `window` consecutive words of an item; an item of fewer words is one window. The windows are the
    patterns of one automaton, which is sent to all workers: up to `limit` characters of patterns, whatever the
    documents are. Documents are then read once and nothing is shuffled. A benchmark with more is taken in blocks of
    that size, one after another: each block's automaton is sent, scans the documents, writes the hits of the texts
    that have any, and is deleted; in the end these, by a hash of the text, are joined with the documents.

    docs: doc_id and text are read, other columns ignored; a null or empty text has no words and no hits; repeated
    rows give a row each. benchmark: items without words have no windows; an item with a null id hits, but isn't among
    the items; rows with the same id count as one item. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    told = blocks(_items(benchmark), window, limit)
    first, second = next(told, None), next(told, None)
    if second is not None:
        return _scan_blocks(docs, itertools.chain((first, second), told), Scratch(spark, "windows"))
    sent = spark.sparkContext.broadcast(first)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = automaton(sent.value) if sent.value else None
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield _batch(batch.column(0), [_row(t, *hits(machine, t)) for t in texts])

    return map_texts(_own(docs), task, SCHEMA)


def _scan_blocks(docs: DataFrame, told: Iterable[Block], scratch: Scratch) -> DataFrame:
    spark, parts = docs.sparkSession, None
    own = _own(docs).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    runs_of = "h1 long, h2 long, a array<int>, b array<int>, items array<string>"
    for k, block in enumerate(told):
        sent = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                machine = automaton(sent.value)
                rows = []
                for h1, h2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _, hit, items = hits(machine, text)
                    if hit is not None:
                        a, b = runs(hit)
                        rows.append((h1, h2, a.tolist(), b.tolist(), sorted(items)))
                types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "a", "b", "items"])

        # equal texts have equal hits, so one row a text is enough
        part = map_texts(own.where("text is not null").select("h1", "h2", "text"), task, runs_of).dropDuplicates(["h1", "h2"])
        part = scratch.table(part, f"block{k}")
        sent.destroy()
        parts = part if parts is None else parts.unionByName(part)
    each = parts.groupBy("h1", "h2").agg(
        F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"), F.flatten(F.collect_list("items")).alias("items")
    )
    each = scratch.table(each, "hits")
    scratch.keep("hits")

    def told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b, items in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                n, hit = len(words(text)), None
                if a:
                    steps = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(steps, np.array(a), 1)
                    np.add.at(steps, np.array(b), -1)
                    hit = np.cumsum(steps[:-1]) > 0
                rows.append(_row(text or "", n, hit, set(items or ())))
            yield _batch(batch.column(0), rows)

    # texts without a hit, the bulk, aren't dealt at all where the table of hits is small enough to be sent
    joined = own.join(each, ["h1", "h2"], "left").select("doc_id", "text", "a", "b", "items")
    return map_texts(joined, told_rows, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any hit, with all their columns; a null or empty text has none, repeated rows all stay or go.

    Each block of windows is one more filter over what the ones before it left, so a benchmark of any size is never
    held whole. An empty benchmark keeps all documents, an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, told = Scratch(spark, "clean"), blocks(_items(benchmark), window, limit)
    block = next(told, None)
    for k in itertools.count():
        if block is None:
            return docs
        sent = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                machine = automaton(sent.value)
                keep = [hits(machine, x)[1] is None for x in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_texts(docs, task, docs.schema)
        block = next(told, None)
        if block is not None:
            docs = scratch.table(docs, f"block{k}")
            if k:
                scratch.drop(f"block{k - 1}")
            sent.destroy()
    return docs
