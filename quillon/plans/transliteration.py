"""Transliterations: the documents written in the format of such files, and what the readers make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import shared
from quillon.plans import sql
from quillon.registry import analysis
from quillon.sources import corpus as C

# What the comment lines of made pages name, and the types of their loci.
SECTIONS, TYPES = ("herbal", "bio", "zodiac", "pharma", "cosmo"), ("P0", "Lz", "Cc", "P0", "Lf")


def pages(spark, sf_dir) -> DataFrame:
    """(file, at, value): each document as a page with a header, a comment that names its section, and its lines.

    Words are joined by ".", in every third line by ","; each line has a comment in a tag, and a reading of two.
    """
    lines = C.lines(spark, sf_dir)
    doc, no = F.col("doc_id"), F.col("line_no")
    file = F.concat(F.lit("f"), doc.cast("string"), F.lit(".txt")).alias("file")
    section = F.get(F.array(*map(F.lit, SECTIONS)), (doc % len(SECTIONS)).cast("int"))
    kind = F.get(F.array(*map(F.lit, TYPES)), (no % len(TYPES)).cast("int"))
    words = F.array_join("words", ".")
    words = F.when(no % 3 == 0, F.replace(words, F.lit("."), F.lit(","))).otherwise(words)
    text = F.concat(F.lit("<f"), doc.cast("string"), F.lit("r."), no.cast("string"), F.lit(",@"), kind, F.lit("> "), words, F.lit("<!note>.[qo:ko]kedy"))
    head = lines.select("doc_id").distinct().select(
        file, F.explode(F.array(
            F.struct(F.lit(-2).cast("long").alias("at"), F.concat(F.lit("<f"), doc.cast("string"), F.lit("r> <! $Q=A $L="), F.when(doc % 2 == 0, "A").otherwise("B"), F.lit(">")).alias("value")),
            F.struct(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("# page "), section).alias("value")),
        )).alias("x")
    ).select("file", "x.at", "x.value")
    return head.unionByName(lines.select(file, no.alias("at"), text.alias("value")))


PAGES = f"""with {sql.LINES}, t as (select 'f' || doc_id || '.txt' as file, doc_id, line_no, words, case when doc_id % 2 = 0 then 'A' else 'B' end as currier,
      (['herbal-A', 'bio', 'zodiac', 'pharma', 'cosmo'])[doc_id % 5 + 1] as section, (['P0', 'Lz', 'Cc', 'P0', 'Lf'])[line_no % 5 + 1] as kind from lines),
    w as (select *, list_concat(list_filter(words, lambda w: regexp_full_match(w, '[a-z]+')), ['qokedy']) as told from t)"""


@analysis(oracle=PAGES + " select section, currier, kind[1] as locus_type, count(*) as lines, sum(len(told))::bigint as words from w group by all")
def ivtff_lines(spark, sf_dir):
    """Lines and words by section, hand and type of locus."""
    l = C.parse_ivtff(pages(spark, sf_dir))
    return l.groupBy("section", "currier", "locus_type").agg(F.count("*").alias("lines"), F.sum(F.size("words")).alias("words"))


@analysis(oracle=PAGES + ", x as (select file, unnest(told) as word from w) select file, count(*) as tokens, count(distinct word) as types from x group by file")
def ivtff_tokens(spark, sf_dir):
    """All tokens of each page."""
    t = C.parse_ivtff(pages(spark, sf_dir)).select("file", F.explode("words").alias("word")).groupBy("file", "word").agg(F.count("*").alias("n"))
    return t.groupBy("file").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@analysis(least=3, oracle=PAGES + ", x as (select currier, case when line_no % 3 = 0 then [array_to_string(words, '')] else list_filter(words, lambda w: regexp_full_match(w, '[a-z]+')) end as told from w where kind[1] = 'P'), y as (select currier, unnest(list_concat(list_filter(told, lambda w: regexp_full_match(w, '[a-z]+')), ['qokedy'])) as word from x) select currier, count(*) as tokens, sum(length(word))::bigint as letters from y where length(word) >= 3 group by currier")
def ivtff_joined_commas(spark, sf_dir, least=3):
    """Paragraphs with uncertain spaces closed, words of three letters or more, by hand."""
    l = C.parse_ivtff(pages(spark, sf_dir), comma_break=False, least=least, locus_types=("P",))
    w = l.select("currier", F.explode("words").alias("word"))
    return w.groupBy("currier").agg(F.count("*").alias("tokens"), F.sum(F.length("word")).cast("long").alias("letters"))


@analysis(oracle=PAGES + ", x as (select kind, unnest(told) as word from w where kind in ('Lz', 'Lf', 'Cc')) select kind, word, count(*) as n from x group by all")
def ivtff_labels(spark, sf_dir):
    """Words of labels and of circular texts, by subtype of locus."""
    l = C.labels(C.parse_ivtff(pages(spark, sf_dir)), ("Lz", "Lf", "Cc"))
    kind = F.regexp_extract("locus", r",.([A-Z][a-z0-9]?)", 1)
    return l.select(kind.alias("kind"), F.explode("words").alias("word")).groupBy("kind", "word").agg(F.count("*").alias("n"))


@analysis(oracle=PAGES + ", x as (select currier, unnest(told) as word from w), h as (select unnest([currier, 'full']) as hand, word from x) select hand, count(*) as tokens, count(distinct word) as types from h group by hand")
def split_by_hand(spark, sf_dir):
    """The pages of either hand, and all."""
    out = None
    for hand, l in C.split_by_hand(C.parse_ivtff(pages(spark, sf_dir))).items():
        t = l.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))
        t = t.select(F.lit(hand).alias("hand"), "tokens", "types")
        out = t if out is None else out.unionByName(t)
    return out


@analysis(oracle=PAGES + ", x as (select currier, unnest(list_concat(words, ['qokedy'])) as word from w) select currier, count(*) as tokens, count(distinct word) as types from x group by currier")
def generic_transliteration(spark, sf_dir):
    """The same pages as a text in any alphabet: no word is dropped for its letters."""
    w = C.parse_ivtff(pages(spark, sf_dir), generic=True).select("currier", F.explode("words").alias("word")).groupBy("currier", "word").agg(F.count("*").alias("n"))
    return w.groupBy("currier").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@analysis(oracle=f"""with {sql.LINES}, p as (select corpus, list_transform(words, lambda w: lower(w)) as words from lines where len(words) >= 5) select corpus, count(*) as lines, sum(len(words))::bigint as tokens from p group by corpus""")
def control_corpora(spark, sf_dir):
    """Corpora written as text files, a folder each, and read again as control corpora: lines of five words or more."""
    there = shared.folder(spark, "controls")
    C.write_corpus(C.lines(spark, sf_dir), there)
    out = None
    for r in C.lines(spark, sf_dir).select("corpus").distinct().collect():  # a row a corpus
        c = C.read_control(spark, f"{there}/corpus={r.corpus}").agg(F.count("*").alias("lines"), F.sum(F.size("words")).cast("long").alias("tokens"))
        c = c.select(F.lit(r.corpus).alias("corpus"), "lines", "tokens")
        out = c if out is None else out.unionByName(c)
    return out


@analysis(oracle=f"with {sql.COUNTS} select corpus, count(*) as types, sum(n)::bigint as tokens, max(n)::bigint as most from counts group by corpus")
def results_round_trip(spark, sf_dir):
    """Counts written as JSON results and read by the next analysis."""
    from quillon.plans.vocabulary import word_counts

    there = shared.folder(spark, "results")
    C.write_results(word_counts(spark, sf_dir).select("corpus", "word", "n"), there)
    c = spark.read.schema("corpus string, word string, n long").json(there)
    return c.groupBy("corpus").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.max("n").alias("most"))


@analysis(oracle="""with m as (select doc_id, unnest(regexp_extract_all(text, '(@\\d+;|\\{[^}]*\\}|'')', 1)) as mark from (select page_id as doc_id, html as text from pages))
    select mark, count(*) as n from m group by mark""")
def alphabet_marks(spark, sf_dir):
    """Marks outside the basic alphabet in raw pages: numbered signs, groups in braces, apostrophes."""
    m = C.table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"(@\d+;|\{[^}]*\}|')"), 1)).alias("mark"))
    return m.groupBy("mark").agg(F.count("*").alias("n"))


@analysis(oracle="""with w as (select doc_id, regexp_extract_all(lower(replace(replace(text, '.', ' . '), ',', ' , ')), '[a-z]+') as ws from documents) select doc_id, len(ws)::bigint as words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as letters from w""")
def clean_words(spark, sf_dir):
    """The letters a to z of every run between marks, the older way of cleaning."""
    from quillon.functions import text as T

    d = C.table(spark, sf_dir, "documents")
    parts = F.filter(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), T.clean_word), lambda w: w != "")
    return d.select("doc_id", parts.alias("w")).select("doc_id", F.size("w").cast("long").alias("words"), F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("letters"))
