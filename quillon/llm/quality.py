"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, map_texts

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Measures, each a rate, with the integer share (per 100,000) that a sketch counts; True: a low value is bad as well.
MEASURES: dict[str, tuple[str, bool]] = {
    "symbols": ("n_symbols * 100000 div (word_chars + n_symbols + 1)", False),
    "dup_lines": ("n_dup_lines * 100000 div (n_dup_lines + n_words + 1)", False),
    "repeats": ("n_repeat_words * 100000 div (n_words + 1)", False),
    "word_length": ("word_chars * 1000 div (n_words + 1)", True),
}
#: Buckets of a sketch: exact below 64, then 32 a doubling, so a value is known to about 3 %; fewer than 600 in all.
EXACT, PER_DOUBLING = 64, 32
#: The least spread of a measure that a fence counts with, in its own unit: where most documents have none of something,
#: the quartiles are equal, and a stray symbol or one repeated phrase is no outlier. Word lengths always spread.
MARGIN = {"symbols": 500, "dup_lines": 750, "repeats": 2_500, "word_length": 0}
#: Groups of fewer documents take the thresholds of their language, and these, if too few, those of all.
LEAST = 200


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The values of FEATURES for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t or "") for t in batch.column(3).to_pylist()]
        cols = [pa.array([x[i] for x in found], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["doc_id", "lang", "source", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in FEATURES)
    return map_texts(kept, _features, schema)


def bucket(value: Column) -> Column:
    """A value's bucket: itself below EXACT, else its power of two and the next bits after the leading one."""
    doublings = F.length(F.bin(value)) - 1
    shift = F.greatest(doublings - 5, F.lit(0))
    fine = (value / F.pow(F.lit(2.0), shift)).cast("long") - PER_DOUBLING
    return F.when(value < EXACT, value).otherwise(EXACT + (doublings - 6) * PER_DOUBLING + fine).cast("long")


def upper_end(b: Column) -> Column:
    """The largest value that falls into a bucket."""
    k = b - EXACT
    doubling = F.floor(k / PER_DOUBLING)
    fine = k - doubling * PER_DOUBLING
    end = (fine + PER_DOUBLING + 1) * F.pow(F.lit(2.0), doubling + 1) - 1
    return F.when(b < EXACT, b).otherwise(end.cast("long")).cast("long")


def sketches(feats: DataFrame) -> DataFrame:
    """Counts by (lang, source, measure, bucket). Two sketches merge by adding counts, which is how Spark sums them."""
    long = feats.where("n_words > 0").select(
        "lang",
        "source",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(m).alias("measure"), bucket(F.expr(e)).alias("bucket"))
                    for m, (e, _) in MEASURES.items()
                )
            )
        ).alias("x"),
    )
    return long.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, reach: int = 4, margin: dict[str, int] | None = None) -> DataFrame:
    """Fences by (lang, source, measure): quartiles of the group's sketch and `reach` times their distance beyond them.

    The distance counts as an eighth of the upper quartile, or the measure's margin, if it is smaller than these.
    A group of fewer than LEAST documents merges upward: its language's sketch, else that of all documents. The work is
    on sketches alone, at most 600 rows for each group and measure.
    """
    margins = F.create_map(*(F.lit(x) for kv in (MARGIN if margin is None else margin).items() for x in kv))
    whole = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    every = whole.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def fences(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        # a sketch's buckets fold into one array per group: at most 600 pairs, however many documents
        folded = df.groupBy(*keys, "measure").agg(
            F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total")
        )

        def quantile(q4: int) -> Column:
            # the first bucket at which the running count reaches q4 quarters of the total
            found = F.aggregate(
                "s",
                F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("b")),
                lambda a, x: F.struct(
                    (a["seen"] + x["n"]).alias("seen"),
                    F.when(a["b"].isNull() & ((a["seen"] + x["n"]) * 4 >= F.col("total") * q4), x["bucket"])
                    .otherwise(a["b"])
                    .alias("b"),
                ),
            )
            return upper_end(found["b"])

        quart = folded.select(*keys, "measure", "total", quantile(1).alias("q1"), quantile(3).alias("q3"))
        spread = F.greatest(F.col("q3") - F.col("q1"), F.floor(F.col("q3") / 8), margins[F.col("measure")])
        return quart.select(
            *keys,
            "measure",
            F.struct(
                F.col("total").alias("n"),
                (F.col("q1") - reach * spread).cast("long").alias("low"),
                (F.col("q3") + reach * spread).cast("long").alias("high"),
            ).alias(tag),
        )

    own = fences(sketch, ["lang", "source"], "own")
    by_lang = fences(whole, ["lang"], "by_lang")
    overall = fences(every, [], "overall")
    joined = own.join(by_lang, ["lang", "measure"], "left").join(F.broadcast(overall), ["measure"], "left")
    chosen = (
        F.when(F.col("own.n") >= LEAST, F.col("own"))
        .when(F.col("by_lang.n") >= LEAST, F.col("by_lang"))
        .otherwise(F.col("overall"))
    )
    return joined.select("lang", "source", "measure", chosen.alias("fence"))


#: Groups of (lang, source) up to which their fences, about 100 bytes each, are sent to all; more are joined by salted keys.
MOST_SENT = 50_000
SALTS = 32


def _with_fences(feats: DataFrame, fences: DataFrame) -> DataFrame:
    """feats with the fences of their group, without dealing all rows of a group to one task."""
    if fences.count() <= MOST_SENT:
        return feats.join(F.broadcast(fences), ["lang", "source"], "left")
    salted = fences.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = feats.withColumn("salt_", F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["lang", "source", "salt_"], "left").drop("salt_")


def judge(docs: DataFrame, reach: int = 4, margin: dict[str, int] | None = None) -> DataFrame:
    """One row per document: FEATURES, base_failed, kept, and `failed`, the measures outside their group's fences.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that the text repeats. kept: not
    base_failed and no measure outside the fences.

    The texts are read once; the features, a few numbers a document, are written to the shared folder and joined with
    the fences of their language and source. Up to MOST_SENT groups, which are counted first, the fences are sent to
    all; beyond, both sides are joined by group and salt, so that a source with a third of all rows is many tasks.

    docs: doc_id, lang, source, text; others are ignored. A null lang or source is a group of its own, with the empty
    string. A null or empty text has no words and fails the base rule; it isn't in any sketch. Repeated rows are judged
    each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    feats = scratch.table(features(docs), "features")
    wide = thresholds(sketches(feats), reach, margin).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"f_{m}") for m in MEASURES)
    )
    joined = _with_fences(feats, scratch.table(wide, "fences"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    outside = [
        F.when(
            (F.expr(e) > F.col(f"f_{m}.high")) | (F.lit(two) & (F.expr(e) < F.col(f"f_{m}.low"))),
            F.lit(m),
        )
        for m, (e, two) in MEASURES.items()
    ]
    return joined.select(
        "doc_id", "lang", "source", *FEATURES, base.alias("base_failed"), F.array_compact(F.array(*outside)).alias("failed")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
