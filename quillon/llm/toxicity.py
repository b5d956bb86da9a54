"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, noisy-or joins the two."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, given_back, map_texts

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
WORD = re.compile(r"[^\W_]+")
#: Weights of the model; features are hashed to them.
DIMENSIONS = 1 << 18
#: The bounds of the training sample: labelled documents, taken by a hash of their id, and their distinct sentences'
#: words together. What lies beyond is not trained on; scoring covers every document.
MOST_DOCS, MOST_WORDS = 16_000, 8_000_000
#: A labelled document of more than a hundredth of MOST_WORDS, which would crowd others out, is not trained on either.
CROWD = 100
PASSES, RATE, DECAY = 14, 0.5, 1e-6
#: The steps by which the calibration's offset may be raised, and what a clean document over the threshold costs.
RAISES, FALSE_COST = tuple(k / 10 for k in range(11)), 2.0


def word_features(word: str) -> list[int]:
    """A lower-case word and its beginnings of 4 to 6 letters, hashed."""
    data = word.encode("utf-8", "surrogatepass")
    own = [zlib.crc32(data) % DIMENSIONS]
    return own + [zlib.crc32(b"^" + word[:k].encode("utf-8", "surrogatepass")) % DIMENSIONS for k in (4, 5, 6) if len(word) >= k]


@dataclass
class Model:
    """Sentence score: the logistic function of a bias and the weights of its words. A document's: noisy-or, calibrated."""

    bias: float
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    #: Fitted without labels of both kinds: every document has the bias's odds, however many sentences it has.
    blind: bool = False
    known: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 150_000:
                self.known.clear()
            w = self.known[word] = float(sum(self.weights[k] for k in word_features(word)))
        return w

    def logits(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and logit of each sentence with a word."""
        out = []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            if words:
                out.append((*m.span(), self.bias + sum(map(self.word, words))))
        return out

    def log_odds(self, logits) -> float:
        """Of the noisy-or: 1 - product of (1 - p) is the chance that any sentence is toxic. No sentence: the bias's own."""
        if self.blind:
            return self.bias
        z = np.asarray(logits if len(logits) else [self.bias], dtype=float)
        none = -np.logaddexp(0.0, z).sum()  # log of the chance that none is
        return float(np.log(max(-np.expm1(none), 1e-300)) - none)

    def score(self, logits) -> float:
        """0 to 1, by a calibration that keeps the order of documents."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(logits) + self.offset, -40, 40))))


class Sentences(Sequence):
    """A document's sentences, the features of each an array, kept as the bytes of all of them and their sizes."""

    __slots__ = ("data", "sizes")

    def __init__(self, data: bytes, sizes: Sequence[int]):
        self.data, self.sizes = data, np.array(sizes, dtype="<i4")

    def flat(self) -> np.ndarray:
        return np.frombuffer(self.data, dtype="<i4")

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, at):
        return (np.split(self.flat(), np.cumsum(self.sizes)[:-1]) if len(self.sizes) else [])[at]

    def __iter__(self):
        return iter(self[:])


def calibration(model: Model, docs: list[tuple[list[np.ndarray], int]]) -> tuple[float, float]:
    """Slope and offset of a logistic function of the log odds of documents that the model wasn't fitted on.

    Newton's steps with the prior that nothing need change, so a few documents move little; the order of documents
    never turns round.
    """
    x = np.array([model.log_odds([model.bias + model.weights[s].sum() for s in sentences]) for sentences, _ in docs])
    y = np.array([label for _, label in docs], dtype=float)
    if y.sum() < 5 or y.sum() > len(y) - 5:
        return 1.0, 0.0
    design, start = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        z = design @ ab
        return float((np.logaddexp(0, z) - y * z).sum() + ((ab - start) ** 2).sum() / 2)

    ab = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -40, 40)))
        slope = design.T @ (p - y) + (ab - start)
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(curve, slope)
        while loss(ab - step) > loss(ab) and np.abs(step).max() > 1e-9:
            step = step / 2
        ab = ab - step
    return float(max(ab[0], 0.05)), float(ab[1])


def raised(model: Model, docs: list[tuple[list[np.ndarray], int]], threshold: float = 0.3) -> float:
    """How far the offset is to be raised, by 1 at most, so that the threshold parts the documents best.

    Best is the largest share of toxic documents over it less FALSE_COST times the share of others; of equal ones the least.
    A calibration fits all odds alike and is a little low where toxic documents are rare.
    """
    z = np.array([model.slope * model.log_odds([model.bias + model.weights[s].sum() for s in sentences]) + model.offset for sentences, _ in docs])
    y = np.array([label for _, label in docs], dtype=bool)
    if y.sum() < 5 or y.sum() > len(y) - 5:
        return 0.0
    at = np.log(threshold / (1 - threshold))
    gains = [(z[y] + d >= at).mean() - FALSE_COST * (z[~y] + d >= at).mean() for d in RAISES]
    return float(RAISES[int(np.argmax(gains))])


def fit(docs: list[tuple[list[np.ndarray], int]], seed: int = 7) -> Model:
    """Adagrad on the log loss of the noisy-or, document by document in batches.

    docs: for each, its sentences' hashed features and its label. With q the chance that no sentence is toxic, the loss's
    slope by a sentence's logit is p for label 0 and -p * q / (1 - q) for label 1: each sentence of a toxic document is
    blamed in proportion to its own score.
    """
    toxic = sum(y for _, y in docs)
    if not docs or not toxic or toxic == len(docs):
        rate = (toxic + 0.5) / (len(docs) + 2)
        return Model(float(np.log(rate / (1 - rate))), np.zeros(DIMENSIONS), blind=True)
    mean = np.mean([max(1, len(s)) for s, _ in docs])
    rate = toxic / len(docs)
    bias = float(np.log(rate / mean / (1 - rate / mean)))
    w, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    bias_seen = 1.0
    rng = np.random.default_rng(seed)
    flat = []
    for sentences, y in docs:
        if sentences and isinstance(sentences, Sentences):
            flat.append((sentences.flat(), sentences.sizes, len(sentences), y))
        elif sentences:
            flat.append((np.concatenate(sentences), np.array([len(s) for s in sentences]), len(sentences), y))
    for _ in range(PASSES):
        order = rng.permutation(len(flat))
        for at in range(0, len(order), 32):
            part = [flat[i] for i in order[at : at + 32]]
            ids = np.concatenate([p[0] for p in part])
            first = np.concatenate([[0], np.cumsum([p[2] for p in part])])
            rows = np.repeat(np.arange(first[-1]), np.concatenate([p[1] for p in part]))
            doc = np.repeat(np.arange(len(part)), [p[2] for p in part])
            label = np.array([p[3] for p in part])
            z = bias + np.bincount(rows, w[ids], minlength=first[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            log_q = -np.bincount(doc, np.logaddexp(0, z), minlength=len(part))
            blame = np.exp(log_q) / np.maximum(-np.expm1(log_q), 1e-9)
            slope = np.where(label[doc] == 1, -p * blame[doc], p)
            touched, inverse = np.unique(ids, return_inverse=True)
            g = np.bincount(inverse, slope[rows]) / len(part) + DECAY * w[touched]
            seen[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(seen[touched])
            gb = slope.sum() / len(part)
            bias_seen += gb * gb
            bias -= RATE * gb / np.sqrt(bias_seen)
    return Model(bias, w)


def held_out(doc_id):
    """True for the quarter of the ids that training never sees."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, sizes = [], []
        for t in batch.column(2).to_pylist():
            told = {frozenset(WORD.findall(s.lower())) for s in SENTENCE.findall(t or "")} - {frozenset()}
            each = [np.array([k for word in sorted(s) for k in word_features(word)], dtype="<i4") for s in sorted(told, key=sorted)]
            feats.append(np.concatenate(each).tobytes() if each else b"")
            sizes.append([len(x) for x in each])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(feats, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))],
            names=["doc_id", "toxic", "feats", "sizes"],
        )


def sample(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_words: int = MOST_WORDS) -> list[tuple[Sentences, int]]:
    """The bounded sample that the model is fitted on, as fit() takes it; held-out ids are not in it.

    The `most_docs` ids with the smallest hash are joined with their texts (the ids' number is the proven bound of what
    is broadcast), and of these, in the same order, as many as have most_words features together: sizes are added up in
    the order of the hash, then the rows up to there are fetched, so the files' order decides nothing. Each repeated row
    counts as a document.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_docs)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = own.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    feats = map_texts(labelled, _featurise, "doc_id long, toxic int, feats binary, sizes array<int>")
    rows = feats.withColumn("n", (F.length("feats") / 4).cast("long"))
    rows = rows.where(F.col("n") <= most_words // CROWD)
    scratch = Scratch(docs.sparkSession, "sample")
    order = ["h", "doc_id", "k"]
    rows = scratch.table(rows.withColumns({"h": F.xxhash64("doc_id"), "k": F.xxhash64("feats")}), "rows")
    chosen, words = [], 0
    for row in rows.select(*order, "n").orderBy(*order).limit(most_docs).collect():
        chosen.append((row.h, row.doc_id, row.k))
        words += row.n
        if words > most_words:
            break
    out = []
    if chosen:
        h, doc, k = last = chosen[-1]
        equal = chosen.count(last)  # of rows that are equal to the last, no more than were chosen
        in_doc = (F.col("doc_id") < doc) | ((F.col("doc_id") == doc) & (F.col("k") <= k))
        for row in rows.where((F.col("h") < h) | ((F.col("h") == h) & in_doc)).toLocalIterator():
            if (row.h, row.doc_id, row.k) == last:
                if not equal:
                    continue
                equal -= 1
            out.append((row.doc_id, int(row.toxic), Sentences(bytes(row.feats), row.sizes)))
    scratch.drop()
    out.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2].data))
    return [(sentences, y) for _, y, sentences in out]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the sample, calibrated by one of four fifths of it on the rest.

    Labels that are neither 0 nor 1, of a null id, of an unknown document or held out teach nothing; of a repeated label
    the toxic one counts. Without labels of both kinds all documents score alike: the labels' share, and a quarter
    without any.
    """
    rows = sample(docs, labels)
    part = fit([r for i, r in enumerate(rows) if i % 5])
    model = fit(rows)
    model.slope, model.offset = part.slope, part.offset = calibration(part, rows[::5])
    model.offset += raised(part, rows[::5])
    del rows, part
    given_back()
    return model


def score(docs: DataFrame, model: Model, sentences: bool = False) -> DataFrame:
    """doc_id, score and, where asked for, the sentences with scores of 0.3 or more: start, end, score.

    Whole texts are scored, each by itself; nothing is shuffled. A null or empty text has the model's score for no
    words. Repeated rows give a row each; other columns are ignored. Only doc_id and text are read, and doc_id is no
    input of the score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights, whatever the data
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, places = [], []
            for t in batch.column(1):
                found = sent.value.logits(t.as_py() or "")
                scores.append(sent.value.score([z for _, _, z in found]))
                if sentences:
                    hot = ((a, b, 1 / (1 + np.exp(-max(z, -40.0)))) for a, b, z in found if z > -0.8473)
                    places.append([{"start": a, "end": b, "score": float(p)} for a, b, p in hot])
            cols = [batch.column(0), pa.array(scores, pa.float64())]
            names = ["doc_id", "score"]
            if sentences:
                cols, names = [*cols, pa.array(places, kind)], [*names, "sentences"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, score double" + ", sentences array<struct<start:long,end:long,score:double>>" * sentences
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), task, schema)


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns; null and empty texts score as in score(),
    repeated rows stay or go together, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = sent.value
            keep = [m.score([z for _, _, z in m.logits(t or "")]) < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, task, docs.schema)
