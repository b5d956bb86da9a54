"""Corpora as lines and tokens: (corpus, doc_id, line_no, words) and, one row each, (…, pos, line_len, word)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_lines(docs: DataFrame, corpus: Column, doc: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per line with a word; line_no counts all lines of the text."""
    lines = docs.select(
        corpus.alias("corpus"), F.col(doc).cast("long").alias("doc_id"), *extra, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
    )
    return lines.select("corpus", "doc_id", *extra, F.col("line_no").cast("long").alias("line_no"), T.words(F.col("line")).alias("words")).where(
        F.size("words") > 0
    )


def lines(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ("source",)) -> DataFrame:
    """The documents' lines, a corpus for each language."""
    return split_lines(table(spark, sf_dir, "documents"), F.col("lang"), extra=extra)


def tokens(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c not in ("words", "start")]
    out = lines.select(
        *keep, F.size("words").alias("line_len"), *(["start"] if "start" in lines.columns else []), F.posexplode("words").alias("pos", "word")
    )
    if "start" in out.columns:
        out = out.withColumn("ord", F.col("start") + F.col("pos")).drop("start")
    return out


def pairs(lines: DataFrame, gap: int = 1, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """(keep, a, b, pos): words `gap` apart in a line, made inside each row; no window, no shuffle."""
    zipped = F.arrays_zip(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - gap, F.lit(0))).alias("a"),
        F.slice("words", F.lit(gap + 1), F.greatest(F.size("words") - gap, F.lit(0))).alias("b"),
    )
    long = lines.where(F.size("words") > gap).select(*keep, F.posexplode(zipped).alias("pos", "p"))
    return long.select(*keep, "p.a", "p.b", "pos")


def characters(tokens: DataFrame, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """(keep, i, c): each character of each token with its place in the word."""
    return tokens.select(*keep, F.posexplode(F.split("word", "")).alias("i", "c")).where("c <> ''")


def within_cap(lines: DataFrame, target: int) -> DataFrame:
    """Whole lines until a corpus has `target` tokens: those with fewer than `target` tokens before them."""
    from quillon.operators.order import number_tokens

    return number_tokens(lines).where(F.col("start") < target)


def pseudo_lines(spread: int = 5, least: int = 6) -> Column:
    """Size of a pseudo-line, least to least + spread - 1, by a hash of (corpus, doc_id, line_no)."""
    return (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "corpus", "doc_id", "line_no")), 1, 6), 16, 10).cast("long"), F.lit(spread)) + least).cast("int")


def read_ivtff(spark: SparkSession, path: str, comma_break: bool = True, least: int = 1, locus_types: tuple[str, ...] | None = None, generic: bool = False) -> DataFrame:
    """Transliterations, one folder or file: (file, line_no, locus, locus_type, section, currier, words).

    Comment lines name sections, which hold until the next one that does, and page headers carry the $L= tag; both are
    carried forward within a file. A file is one group of that window, as pages are; lines of any length stream.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return parse_ivtff(raw, comma_break, least, locus_types, generic)


def parse_ivtff(raw: DataFrame, comma_break: bool = True, least: int = 1, locus_types: tuple[str, ...] | None = None, generic: bool = False) -> DataFrame:
    """read_ivtff() of lines that are at hand: (file, at, value), ordered by `at` in a file."""
    raw = raw.select("file", "at", F.regexp_replace(F.col("value"), "^\ufeff", "").alias("line"))
    low = F.lower("line")
    named = F.when(F.startswith(F.trim("line"), F.lit("#")),
        F.coalesce(
            F.when(F.contains(low, F.lit("zodiac")), "zodiac"), F.when(F.contains(low, F.lit("text")), "text"),
            F.when(F.contains(low, F.lit("pharma")), "pharma"),
            F.when(F.contains(low, F.lit("herbal")) & F.contains(low, F.lit("-b")), "herbal-B"),
            F.when(F.contains(low, F.lit("herbal")), "herbal-A"),
            F.when(F.contains(low, F.lit("cosmo")), "cosmo"), F.when(F.contains(low, F.lit("bio")), "bio"),
        ),
    )
    tag = F.regexp_extract("line", r"\$L=(\w)", 1)
    w = Window.partitionBy("file").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    told = raw.select(
        "file",
        (F.row_number().over(w) - 1).cast("long").alias("line_no"),
        F.coalesce(F.last(named, ignorenulls=True).over(upto), F.lit("unknown")).alias("section"),
        F.last(F.when(tag != "", tag), ignorenulls=True).over(upto).alias("currier"),
        F.regexp_extract(F.trim("line"), r"^<([^>]+)>", 1).alias("locus"),
        F.regexp_replace(F.trim("line"), r"^<[^>]+>", "").alias("rest"),
    )
    clean = T.clean_generic if generic else T.clean_ivtff
    words = clean(F.col("rest"), comma_break) if generic else clean(F.col("rest"), comma_break, least)
    out = told.where(F.col("locus") != "").select(
        "file", "line_no", "locus", T.locus_type(F.col("locus")).alias("locus_type"), "section", "currier", words.alias("words")
    )
    out = out.where(F.size("words") > 0)
    return out.where(F.col("locus_type").isin(*locus_types)) if locus_types else out


def read_prose(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Whole text files as (file, words): the part between two markers where they occur, lower-cased letter runs."""
    t = F.regexp_replace("value", "^﻿", "")
    if start:
        t = F.when(F.contains(t, F.lit(start)), F.substring_index(t, start, -1)).otherwise(t)
    if end:
        t = F.substring_index(t, end, 1)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), T.words(t).alias("words"))


def read_control(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """Control corpora, a pseudo-line of words a row: (file, words) of lines with `least` words or more."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), words.alias("words")).where(F.size("words") >= least)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes of a page in XML."""
    schema = "_index int, _x int, _y int, _width int, _height int, _VALUE string"
    return spark.read.format("xml").option("rowTag", "word").schema(schema).load(path).select(
        *(F.col(f"_{c}").alias(c) for c in ("index", "x", "y", "width", "height")), F.col("_VALUE").alias("word")
    )


def split_by_hand(lines: DataFrame) -> dict[str, DataFrame]:
    """Transliterated lines by the tag of their page: A, B, and the whole."""
    return {"A": lines.where("currier = 'A'"), "B": lines.where("currier = 'B'"), "full": lines}


def fetch_text(url: str, cache: str) -> str:
    """The path of a text's copy in the cache folder, fetched once; file:// URLs work without a network."""
    import hashlib
    import os
    import urllib.request

    os.makedirs(cache, exist_ok=True)
    path = os.path.join(cache, hashlib.sha256(url.encode()).hexdigest()[:24] + ".txt")
    if not os.path.exists(path):
        with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310 (the caller's own URL)
            data = r.read()
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
    return path


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Another analysis's JSON results."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """An analysis's rows as JSON, one object a line, nulls written out; read_results() reads them back."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_corpus(lines: DataFrame, path: str) -> DataFrame:
    """Write a corpus as text, a folder for each, and return its manifest: tokens, types, lines."""
    lines.select("corpus", F.array_join("words", " ").alias("value")).write.mode("overwrite").partitionBy("corpus").text(path)
    return manifest(lines)


def manifest(lines: DataFrame) -> DataFrame:
    words = lines.select("corpus", F.explode("words").alias("w")).groupBy("corpus", "w").agg(F.count("*").alias("n"))
    types = words.groupBy("corpus").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))
    return lines.groupBy("corpus").agg(F.count("*").alias("lines")).join(types, "corpus").select("corpus", "tokens", "types", "lines")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks outside the basic alphabet of transliterations: (file, mark, n) of @123; signs, {groups} and apostrophes."""
    marks = F.regexp_extract_all("value", F.lit(r"(@\d+;|\{[^}]*\}|')"), 1)
    lines = spark.read.text(path).where("value like '<%'").select(F.col("_metadata.file_name").alias("file"), F.explode(marks).alias("mark"))
    return lines.groupBy("file", "mark").agg(F.count("*").alias("n"))


def read_edition(spark: SparkSession, path: str, incipit: str) -> DataFrame:
    """A scanned edition's text lines, (file, line_no, words): from the second line with the incipit (the first is the
    table of contents), without page numbers, footnotes, apparatus and lines of fewer than two words.

    A file is one group of the running count of incipits, which streams.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.contains(F.lower("line"), F.lit(incipit.lower())).cast("int")).over(upto)
    told = raw.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("long").alias("line_no"), "line", seen.alias("seen"))
    page = F.col("line").rlike(r"^[\divxlc\s.\-–—]+$")
    note = F.col("line").rlike(r"^(\d+[\s.)]|[*†‡])")
    apparatus = F.col("line").rlike(r"(?i)\b(om|add|cod|codd|mss?)\.|\]")
    kept = told.where((F.col("seen") >= 2) & ~page & ~note & ~apparatus)
    return kept.select("file", "line_no", T.words(F.col("line")).alias("words")).where(F.size("words") >= 2)


def labels(lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Loci of the given subtypes, such as Lz or Cc: labels and circular texts."""
    return lines.where(F.regexp_extract("locus", r",.([A-Z][a-z0-9]?)", 1).isin(*kinds))
