"""Token counts that follow edits: only the touched part of a text and its neighbourhood is encoded again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.llm.common import Scratch, map_texts

#: Pre-tokens in a leaf, as built; leaves that grow past GROWN are split.
LEAF, GROWN = 64, 512


class Coder:
    """Cuts of a text into pre-tokens, and their tokens; remembers the frequent ones."""

    def __init__(self, vocabulary: str | None = None):
        self.bpe = bpe.load(vocabulary)
        self.pieces = self.bpe.pieces
        self.known: dict[str, int] = {}
        #: A cut is decided by at most this many characters after it: two, or a special token that they may be part of.
        self.ahead = max(2, *map(len, self.bpe.special), 2)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = self.bpe.piece_tokens(p)
        return [known[p] for p in pieces]


class Leaf:
    """Consecutive pre-tokens: their text, lengths and tokens. Stored ones stay arrays until an edit touches them."""

    __slots__ = ("counts", "lens", "text")

    def __init__(self, text: str, lens, counts):
        self.text, self.lens, self.counts = text, lens, counts

    @property
    def tokens(self) -> int:
        return int(self.counts.sum()) if isinstance(self.counts, np.ndarray) else sum(self.counts)

    def lists(self) -> tuple[list[int], list[int]]:
        if isinstance(self.lens, np.ndarray):
            self.lens, self.counts = self.lens.tolist(), self.counts.tolist()
        return self.lens, self.counts


def chunks(text: str, lens, counts, size: int) -> list[Leaf]:
    ends = np.cumsum(np.asarray(lens, dtype=np.int64))[size - 1 :: size].tolist()
    out, at = [], 0
    for k, i in enumerate(range(0, len(lens), size)):
        end = ends[k] if k < len(ends) else len(text)
        out.append(Leaf(text[at:end], lens[i : i + size], counts[i : i + size]))
        at = end
    return out


class TokenTree:
    """A text's pre-tokens in leaves under a binary tree of (characters, tokens) sums.

    `edit` replaces a range of characters. It encodes again from the last pre-token that the edit can't reach, until
    the new cuts meet the old ones behind the edit; from there on the old counts hold, as a cut depends only on what
    follows. Counts are kept for each pre-token, so nothing else is counted again, and sums change on the paths from the
    touched leaves to the root. encoded_chars adds up the characters that edits had encoded.
    """

    def __init__(self, text: str, lens, counts, coder: Coder):
        self.coder, self.encoded_chars = coder, 0
        self._build(chunks(text, lens, counts, LEAF))

    @classmethod
    def of(cls, text: str, coder: Coder) -> TokenTree:
        pieces = coder.pieces(text)
        return cls(text, list(map(len, pieces)), coder.counts(pieces), coder)

    def _build(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves or [Leaf("", [], [])]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves, self.size):
            self.chars[i], self.tokens[i] = len(leaf.text), leaf.tokens
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _put(self, k: int, leaf: Leaf) -> None:
        self.leaves[k] = leaf
        i = self.size + k
        self.chars[i], self.tokens[i] = len(leaf.text), leaf.tokens
        i //= 2
        while i:
            self._add(i)
            i //= 2

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf; of an empty text the first leaf."""
        if not self.chars[1]:
            return 0, 0
        at, i, before = min(at, self.chars[1] - 1), 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(x.text for x in self.leaves)

    def lens(self) -> list[int]:
        return [n for x in self.leaves for n in x.lists()[0]]

    def counts(self) -> list[int]:
        return [n for x in self.leaves for n in x.lists()[1]]

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace `length` characters from `start`; both are cut to the text."""
        start = max(0, min(start, self.n_chars))
        end = start + max(0, min(length, self.n_chars - start))
        if start == end and not new:
            return
        ahead, moved = self.coder.ahead, len(new) - (end - start)
        first, before = self._find(max(0, start - ahead))
        kept, at = 0, before  # pre-tokens that end `ahead` before the edit or earlier
        for n in self.leaves[first].lists()[0]:
            if at + n + ahead > start:
                break
            at += n
            kept += 1
        last, upto, wanted = first, before + len(self.leaves[first].text), end + 64
        while True:
            while upto < wanted and last + 1 < len(self.leaves):
                last += 1
                upto += len(self.leaves[last].text)
            told = [n for x in self.leaves[first : last + 1] for n in x.lists()[0]][kept:]
            old = "".join(x.text for x in self.leaves[first : last + 1])[at - before :]
            cuts, spot = {}, 0
            for k, n in enumerate(told):
                cuts[spot] = k
                spot += n
            cuts[spot] = len(told)
            whole = last + 1 >= len(self.leaves)
            again = old[: start - at] + new + old[end - at :]
            fresh, spot, met = [], 0, None
            for p in self.coder.pieces(again):
                if spot >= start - at + len(new) and spot - moved in cuts:
                    met = cuts[spot - moved]
                    break
                if not whole and spot + len(p) + ahead > len(again):
                    break
                fresh.append(p)
                spot += len(p)
            else:
                met = len(told) if whole else None
            if met is not None:
                break
            wanted = upto + max(64, len(old))
        self.encoded_chars += spot
        # the leaf in which the cuts meet: what lies behind it stays
        upto, behind = last, sum(len(x.lens) for x in self.leaves[first : last + 1]) - kept
        while upto > first and behind - len(self.leaves[upto].lens) >= met:
            behind -= len(self.leaves[upto].lens)
            upto -= 1
        touched = self.leaves[first : upto + 1]
        counts = [n for x in touched for n in x.lists()[1]]
        lens = [n for x in touched for n in x.lists()[0]]
        text = "".join(x.text for x in touched)
        gone = at - before + sum(told[:met])
        lens = lens[:kept] + list(map(len, fresh)) + lens[kept + met :]
        counts = counts[:kept] + self.coder.counts(fresh) + counts[kept + met :]
        text = text[: at - before] + "".join(fresh) + text[gone:]
        n = len(touched)
        if len(lens) > n * GROWN:
            self._build([*self.leaves[:first], *chunks(text, lens, counts, LEAF), *self.leaves[upto + 1 :]])
            return
        own = chunks(text, lens, counts, max(1, -(-len(lens) // n)))
        for k in range(n):
            self._put(first + k, own[k] if k < len(own) else Leaf("", [], []))


TREE = "doc_id long, text string, lens array<int>, counts array<int>"
EDITS = "array<struct<start:int,length:int,text:string>>"
SCHEMA = (
    "doc_id long, n_tokens_before long, n_tokens long, n_chars long, n_edits long, first_chars long, again_chars long"
)


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array(x, dtype=np.int32) for x in rows])))


def trees(docs: DataFrame, vocabulary: str | None = None, keep: str | None = None) -> DataFrame:
    """The tree of each document as a row to be stored: doc_id, text, and lens and counts of its pre-tokens.

    With `keep`, that column of edits as well. docs: doc_id and text are read; a null text is empty; repeated rows give
    a row each; an empty table gives none. Whole texts are encoded, each by itself.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            lens, counts, texts = [], [], []
            for t in batch.column(1):
                texts.append(t.as_py() or "")
                pieces = coder.pieces(texts[-1])
                lens.append(list(map(len, pieces)))
                counts.append(coder.counts(pieces))
            if texts:
                cols = [batch.column(0), pa.array(texts, pa.string()), _lists(lens), _lists(counts), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "lens", "counts", "edits"][: len(cols)])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if keep:
        cols.append(F.col(keep).cast(EDITS).alias("edits"))
    return map_texts(docs.select(*cols), task, TREE + f", edits {EDITS}" * bool(keep))


def apply(stored: DataFrame, vocabulary: str | None = None, updated: bool = False) -> DataFrame:
    """One row per stored tree: its tokens before and after its edits, and how many characters were encoded.

    stored: trees(), read back, with a column `edits`, which apply one after another; places are code points of the
    text as it is then, and are cut to its ends. first_chars were encoded to build the tree, again_chars by the edits:
    all that is encoded here. With `updated`, also the edited tree (text, lens, counts), ready for further edits. Null
    edits are none, as is an edit whose text is null and whose length is null or 0. Nothing is shuffled.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            rows, made = [], []
            ends, lens, counts = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            other = batch.column(3).offsets.to_numpy()  # the same places, unless the batch was sliced
            for k, (doc, text, todo) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True)):
                tree, n, chars = TokenTree(text, lens[ends[k] : ends[k + 1]], counts[other[k] : other[k + 1]], coder), 0, len(text)
                before = tree.n_tokens
                for e in todo or ():
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["length"] or 0, e["text"] or "")
                        n += 1
                rows.append((doc, before, tree.n_tokens, tree.n_chars, n, chars, tree.encoded_chars))
                if updated:
                    made.append((tree.text(), tree.lens(), tree.counts()))
            if rows:
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                if updated:
                    cols += [pa.array([m[0] for m in made], pa.string()), _lists([m[1] for m in made]), _lists([m[2] for m in made])]
                yield pa.RecordBatch.from_arrays(cols, names=names + ["text", "lens", "counts"] * updated)

    kept = stored.select("doc_id", "text", "lens", "counts", F.col("edits").cast(EDITS).alias("edits"))
    return map_texts(kept, task, SCHEMA + ", text string, lens array<int>, counts array<int>" * updated)


def count(docs: DataFrame, edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """One row per document, as apply() gives it: the trees are built, stored, and read back for the edits.

    docs: doc_id, text and a column of edits, array<struct<start:int, length:int, text:string>>. A null text is empty;
    repeated rows give a row each; an empty table gives none; other columns are ignored. Whole texts are counted, each
    by itself, and nothing is shuffled; a table of edits is joined to the documents with with_edits().
    """
    stored = Scratch(docs.sparkSession, "trees").table(trees(docs, vocabulary, edits), "trees")
    return apply(stored, vocabulary)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with its edits as a column; edits: doc_id, seq, start, length, text, applied by seq, then start."""
    own = edits.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "length", "text"))).alias("edits")
    )
    own = own.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"], e["length"], e["text"])).alias("edits"))
    return docs.select("doc_id", "text").join(own, "doc_id", "left")
