"""Words: frequencies, vocabularies, growth, and the order in which types appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import order, stats
from quillon.plans import sql
from quillon.registry import analysis
from quillon.sources import corpus as C


def word_counts(spark, sf_dir) -> DataFrame:
    return stats.freq(C.tokens(C.lines(spark, sf_dir)), ["corpus"], "word")


def ordered_tokens(spark, sf_dir) -> DataFrame:
    return C.tokens(order.number_tokens(C.lines(spark, sf_dir)))


@analysis(k=20, oracle=f"with {sql.COUNTS} select word, sum(n)::bigint as n from counts group by word order by n desc, word limit 20")
def token_freq_topk(spark, sf_dir, k=20):
    return word_counts(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(k)


@analysis(oracle=f"""with {sql.COUNTS} select corpus, sum(n)::bigint as n_tokens, count(*) as n_types,
    sum((n = 1)::int)::bigint as n_hapax, round(count(*) / sum(n), 6) as ttr from counts group by corpus""")
def lang_vocab_stats(spark, sf_dir):
    return word_counts(spark, sf_dir).groupBy("corpus").agg(
        F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), F.count_if(F.col("n") == 1).alias("n_hapax"),
        F.round(F.count("*") / F.sum("n"), 6).alias("ttr"),
    )


@analysis(oracle=f"""with {sql.TOKENS}, e as ({sql.entropy_of("tokens", "corpus", "word", "h")})
    select corpus, round(h, 6) as h_word from e""")
def word_entropy_by_lang(spark, sf_dir):
    return stats.entropy(word_counts(spark, sf_dir), ["corpus"], "h").select("corpus", F.round("h", 6).alias("h_word"))


@analysis(oracle=f"with {sql.TOKENS} select corpus, round(avg(length(word)), 6) as mean_wlen from tokens group by corpus")
def mean_word_len(spark, sf_dir):
    t = C.tokens(C.lines(spark, sf_dir))
    return t.groupBy("corpus").agg(F.round(F.avg(F.length("word")), 6).alias("mean_wlen"))


@analysis(oracle=f"with {sql.LINES} select corpus, sum(len(words))::bigint as tokens, (select count(distinct w) from (select unnest(words) as w from lines l2 where l2.corpus = l.corpus)) as types, count(*) as lines from lines l group by corpus")
def corpus_manifest(spark, sf_dir):
    return C.manifest(C.lines(spark, sf_dir))


@analysis(n=5000, oracle=f"with {sql.ORDERED} select corpus, round(count(distinct word) / count(*), 6) as ttr from ordered where ord < 5000 group by corpus")
def ttr_first_n(spark, sf_dir, n=5000):
    t = ordered_tokens(spark, sf_dir).where(F.col("ord") < n)
    return t.groupBy("corpus").agg(F.round(F.count_distinct("word") / F.count("*"), 6).alias("ttr"))


@analysis(oracle=f"""with {sql.ORDERED}, mid as (select corpus, count(*) // 2 as m from ordered group by corpus),
    f as (select o.corpus, word, count(*) as n from ordered o join mid using (corpus) where ord < m group by all)
    select corpus, round(sum((n = 1)::int) / count(*), 6) as hapax_mid from f group by corpus""")
def hapax_at_midpoint(spark, sf_dir):
    lines = order.number_tokens(C.lines(spark, sf_dir))
    mid = lines.groupBy("corpus").agg(F.floor(F.sum(F.size("words")) / 2).alias("m"))
    t = C.tokens(lines).join(F.broadcast(mid), "corpus").where(F.col("ord") < F.col("m"))  # one row for each corpus
    half = stats.freq(t, ["corpus"], "word")
    return half.groupBy("corpus").agg(F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("hapax_mid"))


@analysis(oracle=f"with {sql.COUNTS} select corpus, n as times, count(*) as n_words from counts where n <= 5 group by all")
def hapax_by_lang(spark, sf_dir):
    """How many types occur once, twice, up to five times."""
    return word_counts(spark, sf_dir).where("n <= 5").groupBy("corpus", F.col("n").alias("times")).agg(F.count("*").alias("n_words"))


ZIPF = """with {counts}, r as (select corpus, n, row_number() over (partition by corpus order by n desc) as r from counts)
    select corpus, round(-regr_slope({log}(n), {log}(r)), 6) as alpha from r where r <= {top} group by corpus having count(*) >= 10"""


@analysis(top=500, oracle=ZIPF.format(counts=sql.COUNTS, log="ln", top=500))
def zipf_alpha_by_lang(spark, sf_dir, top=500):
    return stats.zipf(word_counts(spark, sf_dir), ["corpus"], top).select("corpus", F.round("alpha", 6).alias("alpha"))


@analysis(oracle=ZIPF.format(counts=sql.COUNTS, log="log10", top=50))
def zipf_alpha_top50(spark, sf_dir):
    z = stats.zipf(word_counts(spark, sf_dir), ["corpus"], 50, base10=True)
    return z.select("corpus", F.round("alpha", 6).alias("alpha"))


@analysis(points=20, oracle=f"""with {sql.ORDERED},
    firsts as (select corpus, word, min(ord) as f from ordered group by all),
    sizes as (select corpus, count(*) as total from ordered group by corpus),
    marks as (select corpus, floor(100 + i * ((total - 100) / 19.0) + 1e-9)::bigint as p
           from sizes, (select unnest(range(0, 20)) as i) where total >= 200),
    curve as (select marks.corpus, p, count(*) as v from marks join firsts f on f.corpus = marks.corpus and f.f < p group by all)
    select corpus, round(regr_slope(ln(v), ln(p)), 6) as beta from curve group by corpus""")
def heaps_beta_by_lang(spark, sf_dir, points=20):
    types = stats.first_seen(ordered_tokens(spark, sf_dir), ["corpus"])
    return stats.heaps(types, ["corpus"], points).select("corpus", F.round("beta", 6).alias("beta"))


@analysis(oracle=f"""with {sql.COUNTS}, r as (select *, row_number() over (partition by corpus order by n desc, word) as rank from counts)
    select corpus, rank, word, n from r where rank <= 25""")
def rank_frequency(spark, sf_dir):
    w = Window.partitionBy("corpus").orderBy(F.desc("n"), "word")
    return word_counts(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 25").select("corpus", "rank", "word", "n")


@analysis(k=3, oracle=f"""with {sql.TOKENS}, f as (select corpus, source, word, count(*) as n from tokens group by all)
    select corpus, source, word, n from f qualify row_number() over (partition by corpus, source order by n desc, word) <= 3""")
def per_group_topk(spark, sf_dir, k=3):
    f = stats.freq(C.tokens(C.lines(spark, sf_dir)), ["corpus", "source"], "word")
    w = Window.partitionBy("corpus", "source").orderBy(F.desc("n"), "word")
    return f.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


@analysis(oracle=f"""with {sql.COUNTS}, c as (select corpus, n as times, count(*) as types, sum(n) as tokens from counts group by all)
    select corpus, times, (sum(types) over w)::bigint as types_upto, round((sum(tokens) over w) / sum(tokens) over (partition by corpus), 6) as share
    from c window w as (partition by corpus order by times rows unbounded preceding)""")
def cumulative_distribution(spark, sf_dir):
    c = word_counts(spark, sf_dir).groupBy("corpus", F.col("n").alias("times")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
    w = Window.partitionBy("corpus").orderBy("times").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("tokens").over(w) / F.sum("tokens").over(Window.partitionBy("corpus"))
    return c.select("corpus", "times", F.sum("types").over(w).alias("types_upto"), F.round(share, 6).alias("share"))


@analysis(oracle=f"""with {sql.COUNTS} select a.word, a.n as n_en, b.n as n_fr from counts a join counts b on a.word = b.word
    where a.corpus = 'en' and b.corpus = 'fr'""")
def set_intersect_vocab(spark, sf_dir):
    """Words of two vocabularies with their counts."""
    c = word_counts(spark, sf_dir)
    a = c.where("corpus = 'en'").select("word", F.col("n").alias("n_en"))
    return a.join(c.where("corpus = 'fr'").select("word", F.col("n").alias("n_fr")), "word")


@analysis(oracle=f"with {sql.COUNTS} select word from counts where corpus = 'en' union select word from counts where corpus = 'de'")
def set_union_vocab(spark, sf_dir):
    c = word_counts(spark, sf_dir)
    return c.where("corpus in ('en', 'de')").select("word").distinct()


@analysis(oracle=f"with {sql.COUNTS} select word from counts where corpus = 'es' except select word from counts where corpus = 'fr'")
def set_except_vocab(spark, sf_dir):
    c = word_counts(spark, sf_dir)
    return c.where("corpus = 'es'").select("word").join(c.where("corpus = 'fr'").select("word"), "word", "left_anti")


@analysis(oracle=f"with {sql.COUNTS} select word, sum(n)::bigint as n from counts group by word having count(distinct corpus) = 4")
def n_way_shared_vocab(spark, sf_dir):
    c = word_counts(spark, sf_dir)
    return c.groupBy("word").agg(F.sum("n").alias("n"), F.count_distinct("corpus").alias("k")).where("k = 4").drop("k")


@analysis(oracle=f"""with {sql.TOKENS} select word, corpus, doc_id, line_no, pos::bigint as pos from tokens
    qualify row_number() over (partition by word order by doc_id, line_no, pos) = 1""")
def dedupe_first(spark, sf_dir):
    """Each word where it first occurs."""
    t = C.tokens(C.lines(spark, sf_dir))
    first = t.groupBy("word").agg(F.min(F.struct("doc_id", "line_no", "pos", "corpus")).alias("f"))
    return first.select("word", "f.corpus", "f.doc_id", "f.line_no", F.col("f.pos").cast("long").alias("pos"))


@analysis(oracle=f"""with {sql.COUNTS}, b as (select regexp_extract_all(lower(text), '([\\p{{L}}]+)', 1) as ws from benchmark),
    v as (select distinct unnest(ws) as word from b)
    select corpus, sum(n)::bigint as tokens, coalesce(sum(n) filter (word in (select word from v)), 0)::bigint as covered,
    count(*) filter (word in (select word from v)) as types_covered from counts group by corpus""")
def dictionary_coverage(spark, sf_dir):
    """How much of each corpus a dictionary, the benchmark's words, covers."""
    from quillon.functions import text as T

    d = C.table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct().withColumn("known", F.lit(True))
    c = word_counts(spark, sf_dir).join(d, "word", "left")
    return c.groupBy("corpus").agg(
        F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("covered"),
        F.count("known").alias("types_covered"),
    )


@analysis(target=20000, oracle=f"""with {sql.LINES}, r as (select corpus, len(words) as k, sum(len(words)) over (partition by corpus order by doc_id, line_no rows unbounded preceding) - len(words) as before from lines)
    select corpus, count(*) as lines, sum(k)::bigint as tokens from r where before < 20000 group by corpus""")
def capped_corpus(spark, sf_dir, target=20000):
    capped = C.within_cap(C.lines(spark, sf_dir), target)
    return capped.groupBy("corpus").agg(F.count("*").alias("lines"), F.sum(F.size("words")).cast("long").alias("tokens"))


VOCAB_MERGE = f"""with {sql.COUNTS}, m as (select corpus, regexp_replace(word, 'e+', 'e', 'g') as merged, count(*) as origins, sum(n)::bigint as n from counts group by 1, 2)
    select corpus, merged, origins, n from m where origins > 1"""


@analysis(oracle=VOCAB_MERGE)
def vocabulary_merge(spark, sf_dir):
    """Types that fall together when runs of e are written as one."""
    from quillon.functions import text as T

    merged = word_counts(spark, sf_dir).groupBy("corpus", T.collapse_e(F.col("word")).alias("merged"))
    return merged.agg(F.count("*").alias("origins"), F.sum("n").alias("n")).where("origins > 1")


@analysis(oracle=f"""with {sql.COUNTS}, s as (select corpus, word, n, replace(word, 't', 'd') as swapped from counts where word like '%t%')
    select s.corpus, count(*) as types, count(v.word) as hits, round(count(v.word) / count(*), 6) as rate
    from s left join counts v on v.corpus = s.corpus and v.word = s.swapped group by s.corpus""")
def substitution_match_rate(spark, sf_dir):
    """Share of words that are words still when every t becomes d."""
    c = word_counts(spark, sf_dir)
    s = c.where(F.contains("word", F.lit("t"))).select("corpus", F.replace("word", F.lit("t"), F.lit("d")).alias("word"))
    hit = s.join(c.select("corpus", "word", F.lit(1).alias("hit")), ["corpus", "word"], "left")
    return hit.groupBy("corpus").agg(
        F.count("*").alias("types"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 6).alias("rate")
    )


@analysis(oracle=f"""with {sql.COUNTS}, s as (select corpus, substring(word, 1, 3) as stem, substring(word, 4) as ending, n from counts where length(word) >= 4)
    select corpus, stem, count(distinct ending) as endings, sum(n)::bigint as n from s group by all having sum(n) >= 20""")
def paradigm_fill(spark, sf_dir):
    """Distinct endings of each frequent stem of three letters."""
    c = word_counts(spark, sf_dir).where(F.length("word") >= 4)
    s = c.groupBy("corpus", F.substring("word", 1, 3).alias("stem"))
    return s.agg(F.count_distinct(F.expr("substring(word, 4)")).alias("endings"), F.sum("n").alias("n")).where("n >= 20")
