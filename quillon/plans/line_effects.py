"""What lines do: edges, adjacent repetition, bursts, runs, positions; and the fingerprint made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import order, stats
from quillon.plans import sql
from quillon.plans.information import char_stack, position_predictability, r6
from quillon.registry import analysis
from quillon.sources import corpus as C

# ---- edges


def edge_counts(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, c, a, b): first letters of first words (kind init) and last letters of last words (final) against
    those of the words between, in lines of three words or more; one pass, one shuffle."""
    mid = F.slice("words", F.lit(2), F.size("words") - 2)

    def rows(kind: str, edge, place: int):
        return F.concat(
            F.array(F.struct(F.lit(kind).alias("kind"), F.substring(edge, place, 1).alias("c"), F.lit(True).alias("edge"))),
            F.transform(mid, lambda w: F.struct(F.lit(kind).alias("kind"), F.substring(w, place, 1).alias("c"), F.lit(False).alias("edge"))),
        )

    e = lines.where(F.size("words") >= 3).select(
        *by, F.explode(F.concat(rows("init", F.element_at("words", 1), 1), rows("final", F.element_at("words", -1), -1))).alias("x")
    )
    return e.groupBy(*by, "x.kind", "x.c").agg(
        F.count_if("x.edge").cast("double").alias("a"), F.count_if(~F.col("x.edge")).cast("double").alias("b")
    )


def edge_jsd(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, line_init_jsd, line_final_jsd)."""
    d = stats.jsd(edge_counts(lines, by), [*by, "kind"])
    return d.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "init", F.col("jsd"))).alias("line_init_jsd"),
        F.max(F.when(F.col("kind") == "final", F.col("jsd"))).alias("line_final_jsd"),
    )


EDGES = f"""with {sql.LINES}, l3 as (select * from lines where len(words) >= 3),
    e as (select corpus, 'init' as kind, words[1][1] as c, 1 as edge from l3 union all select corpus, 'final', words[-1][-1], 1 from l3
      union all select corpus, 'init', unnest(list_transform(words[2:-2], lambda w: w[1])), 0 from l3
      union all select corpus, 'final', unnest(list_transform(words[2:-2], lambda w: w[-1])), 0 from l3),
    s as (select corpus, kind, c, sum(edge)::double as a, sum(1 - edge)::double as b from e group by all),
    p as (select *, a / sum(a) over w as p, b / sum(b) over w as q from s window w as (partition by corpus, kind)),
    d as (select corpus, kind, sum(0.5 * case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + 0.5 * case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as jsd from p group by all)"""


@analysis(oracle=EDGES + " select corpus, round(max(jsd) filter (kind = 'init'), 6) as line_init_jsd, round(max(jsd) filter (kind = 'final'), 6) as line_final_jsd from d group by corpus")
def line_initial_final_jsd(spark, sf_dir):
    return edge_jsd(C.lines(spark, sf_dir), ["corpus"]).select("corpus", r6("line_init_jsd"), r6("line_final_jsd"))


@analysis(oracle=f"""with {sql.LINES}, e as (select corpus, words[1][1] as c, 1 as edge from lines union all select corpus, unnest(list_transform(words[2:], lambda w: w[1])), 0 from lines),
    s as (select corpus, c, sum(edge)::double as a, sum(1 - edge)::double as b from e group by all),
    p as (select *, a / sum(a) over w as p, b / sum(b) over w as q from s window w as (partition by corpus))
    select corpus, round(sum(0.5 * case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + 0.5 * case when q > 0 then q * log2(2 * q / (p + q)) else 0 end), 6) as jsd from p group by corpus""")
def line_initial_jsd_all_others(spark, sf_dir):
    """The variant that compares line-initial letters with those of all other words, lines of any length."""
    t = C.tokens(C.lines(spark, sf_dir))
    s = t.groupBy("corpus", F.substring("word", 1, 1).alias("c")).agg(
        F.count_if(F.col("pos") == 0).cast("double").alias("a"), F.count_if(F.col("pos") > 0).cast("double").alias("b")
    )
    return stats.jsd(s, ["corpus"]).select("corpus", r6("jsd"))


def adjacency(lines: DataFrame, by: list[str], near: float = 0.25) -> DataFrame:
    """(by, adj_exact, adj_near): shares of neighbours that are equal, or differ by at most `near` of the longer's length.

    Neighbours are counted as pairs of types first, so a distance is worked out once for each.
    """
    p = stats.freq(C.pairs(lines, keep=tuple(by)), by, "a", "b")
    size = F.greatest(F.length("a"), F.length("b"))
    close = (F.abs(F.length("a") - F.length("b")) <= size * near) & (F.levenshtein("a", "b") <= size * near)
    exact = F.col("a") == F.col("b")
    return p.groupBy(*by).agg(
        (F.sum(F.when(exact, F.col("n")).otherwise(0)) / F.sum("n")).alias("adj_exact"),
        (F.sum(F.when(~exact & close, F.col("n")).otherwise(0)) / F.sum("n")).alias("adj_near"),
    )


@analysis(oracle=f"""with {sql.COUNTS}, {sql.PAIRS[len(sql.LINES) + 2:]}, {sql.ALPHABET}, j as (select corpus, a, b, count(*) as n from pairs group by all),
    e as (select corpus, n, a = b as e, a <> b and abs(length(a) - length(b)) <= 0.25 * greatest(length(a), length(b)) and {sql.distance("a", "b")} <= 0.25 * greatest(length(a), length(b)) as c from j, alphabet)
    select corpus, round(sum(n) filter (e) / sum(n), 6) as adj_exact, round(coalesce(sum(n) filter (c), 0) / sum(n), 6) as adj_near from e group by corpus""")
def adjacency_repetition(spark, sf_dir):
    """Neighbours in a line that are equal, or near each other in their letters."""
    a = adjacency(C.lines(spark, sf_dir), ["corpus"])
    return a.select("corpus", r6("adj_exact"), r6("adj_near"))


def hapax_bursts(lines: DataFrame, least: int = 10) -> DataFrame:
    """(corpus, burstiness, n_hapax): of the gaps, in lines, between words that occur once in the corpus."""
    numbered = C.tokens(order.number_lines(lines))
    once = stats.freq(numbered, ["corpus"], "word").where("n = 1").select("corpus", "word")
    at = numbered.join(once, ["corpus", "word"], "left_semi").groupBy("corpus", "line_ord").agg(F.count("*").alias("k"))
    # hapaxes of one line are a gap of 0 apart; lines follow each other in ranges that meet at their ends
    at = at.withColumn("range", F.floor(F.col("line_ord") / order.WIDTH))
    w = Window.partitionBy("corpus", "range").orderBy("line_ord")
    inner = at.withColumn("gap", F.col("line_ord") - F.lag("line_ord").over(w))
    ends = at.groupBy("corpus", "range").agg(F.min("line_ord").alias("first"), F.max("line_ord").alias("last"))
    v = Window.partitionBy("corpus").orderBy("range")
    between = ends.select("corpus", (F.col("first") - F.lag("last").over(v)).alias("gap"), F.lit(1).cast("long").alias("k"))
    gaps = inner.select("corpus", "gap", "k").unionByName(between.select("corpus", "gap", F.lit(0).cast("long").alias("k")))
    s = gaps.groupBy("corpus").agg(
        F.sum("k").alias("n_hapax"), F.sum("gap").cast("double").alias("s"), F.sum(F.col("gap") * F.col("gap")).cast("double").alias("q")
    )
    n = F.col("n_hapax") - 1
    mean = F.col("s") / n
    std = F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0)))
    return s.where(F.col("n_hapax") >= least).select("corpus", "n_hapax", stats.burstiness(mean, std).alias("burstiness"))


@analysis(oracle=f"""with {sql.TOKENS}, l as (select corpus, doc_id, line_no, row_number() over (partition by corpus order by doc_id, line_no) - 1 as line_ord from lines),
    h as (select corpus, word from tokens group by all having count(*) = 1),
    spots as (select t.corpus, line_ord from tokens t join h using (corpus, word) join l using (corpus, doc_id, line_no)),
    g as (select corpus, line_ord - lag(line_ord) over (partition by corpus order by line_ord) as gap from spots),
    s as (select corpus, count(*) as n_hapax, avg(gap) as m, stddev_pop(gap) as sd from g group by corpus)
    select corpus, n_hapax, round((sd - m) / (sd + m), 6) as burstiness from s""")
def burstiness_hapax(spark, sf_dir):
    return hapax_bursts(C.lines(spark, sf_dir)).select("corpus", "n_hapax", r6("burstiness"))


@analysis(oracle="""with g as (select event_type, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts, event_id) as gap from events),
    s as (select event_type, count(*) as n, avg(gap / 1e6) as m, stddev_pop(gap / 1e6) as sd from g where gap is not null group by all)
    select event_type, n, round((sd - m) / (sd + m), 5) as burstiness from s""")
def burstiness_events(spark, sf_dir):
    """Of the seconds between events of a type; days part the order, so no type is one task's window."""
    e = C.table(spark, sf_dir, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = e.withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    w = Window.partitionBy("event_type", "day").orderBy("t", "event_id")
    inner = e.select("event_type", (F.col("t") - F.lag("t").over(w)).alias("gap"))
    ends = e.groupBy("event_type", "day").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    across = ends.select("event_type", (F.col("a") - F.lag("b").over(Window.partitionBy("event_type").orderBy("day"))).alias("gap"))
    s = inner.unionByName(across).where("gap is not null").groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg(F.col("gap") / 1e6).alias("m"), F.stddev_pop(F.col("gap") / 1e6).alias("sd")
    )
    return s.select("event_type", "n", F.round(stats.burstiness(F.col("m"), F.col("sd")), 5).alias("burstiness"))


@analysis(oracle=f"""with {sql.CHARS}, r as (select corpus, c, row_number() over (partition by corpus, doc_id, line_no, pos order by i) - row_number() over (partition by corpus, doc_id, line_no, pos, c order by i) as g, doc_id, line_no, pos from chars),
    l as (select corpus, c, count(*) as length from r group by corpus, c, g, doc_id, line_no, pos)
    select corpus, length::int as length, count(*) as runs from l group by all""")
def run_length_profile(spark, sf_dir):
    """Runs of one letter within words, by length; words are counted first."""
    words = stats.freq(C.tokens(C.lines(spark, sf_dir)), ["corpus"], "word")
    r = words.select("corpus", "n", F.explode(T.runs(F.col("word"))).alias("r"))
    return r.groupBy("corpus", F.col("r.length").alias("length")).agg(F.sum("n").alias("runs"))


# ---- places in a line


def first_letters(lines: DataFrame) -> DataFrame:
    return C.tokens(lines).withColumn("cls", F.substring("word", 1, 1))


def rank_t(tokens: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """(by, t, classes): variance between classes of the mean relative place of interior words, weighted by words."""
    inner = tokens.where((F.col("pos") >= 2) & (F.col("pos") < F.col("line_len") - 2))
    u = (F.col("pos") - 1.5) / (F.col("line_len") - 4)
    per = inner.groupBy(*by, "cls").agg(F.sum(u).alias("s"), F.count("*").alias("n")).where(F.col("n") >= least)
    # sum n (m - g)² / N = sum s²/n / N - (sum s / N)²
    n = F.sum("n")
    g = F.sum("s") / n
    return per.groupBy(*by).agg(
        F.greatest(F.sum(F.col("s") * F.col("s") / F.col("n")) / n - g * g, F.lit(0.0)).alias("t"), F.count("*").alias("classes")
    )


@analysis(oracle=f"""with {sql.TOKENS}, u as (select corpus, word[1] as cls, (pos - 1.5) / (line_len - 4) as u from tokens where pos >= 2 and pos < line_len - 2),
    c as (select corpus, cls, avg(u) as m, count(*) as n from u group by all having count(*) >= 20),
    g as (select corpus, sum(m * n) / sum(n) as g from c group by corpus)
    select corpus, count(*) as classes, round(sum(n * (m - g) * (m - g)) / sum(n), 6) as t from c join g using (corpus) group by corpus""")
def rank_statistic_t(spark, sf_dir):
    return rank_t(first_letters(C.lines(spark, sf_dir)), ["corpus"]).select("corpus", "classes", r6("t"))


BIN = """case when pos = 0 then 'p1' when pos = 1 then 'p2' when pos = line_len - 1 then 'pL' when pos = line_len - 2 then 'pL-1'
    else 'm' || (least((pos - 2) * 3 // (line_len - 4), 2) + 1) end"""


@analysis(oracle=f"with {sql.TOKENS} select corpus, {BIN} as bin, count(*) as n, round(avg(length(word)), 6) as mean_len from tokens where line_len >= 5 group by all")
def position_bins(spark, sf_dir):
    t = C.tokens(C.lines(spark, sf_dir)).where("line_len >= 5")
    b = t.groupBy("corpus", T.position_bin(F.col("pos"), F.col("line_len")).alias("bin"))
    return b.agg(F.count("*").alias("n"), F.round(F.avg(F.length("word")), 6).alias("mean_len"))


@analysis(oracle=f"with {sql.TOKENS} select corpus, 'P' || least(pos * 5 // greatest(line_len - 1, 1), 4) as bin, count(*) as n from tokens group by all")
def quintile_bins(spark, sf_dir):
    t = C.tokens(C.lines(spark, sf_dir))
    return t.groupBy("corpus", T.quintile_bin(F.col("pos"), F.col("line_len")).alias("bin")).agg(F.count("*").alias("n"))


@analysis(k=12, oracle=f"""with {sql.TOKENS}, c as (select corpus, word[1] as cls, count(*) as n from tokens group by all),
    t as (select *, row_number() over (partition by corpus order by n desc, cls) <= 12 as keep from c)
    select corpus, case when keep then cls else '#' end as cls, sum(n)::bigint as n from t group by 1, 2""")
def top_k_class_recode(spark, sf_dir, k=12):
    return recode(stats.freq(first_letters(C.lines(spark, sf_dir)), ["corpus"], "cls"), k).groupBy("corpus", "to").agg(F.sum("n").alias("n")).withColumnRenamed("to", "cls")


def recode(counts: DataFrame, k: int) -> DataFrame:
    """Class counts with `to`: the class itself for a corpus's k most frequent, "#" for the rest."""
    w = Window.partitionBy("corpus").orderBy(F.desc("n"), "cls")
    return counts.withColumn("to", F.when(F.row_number().over(w) <= k, F.col("cls")).otherwise("#"))


@analysis(oracle=f"""with {sql.TOKENS}, f as (select corpus, {BIN} as bin, unnest(['len', 'first', 'last', 'gallows']) as feature,
      unnest([case when length(word) < 7 then length(word)::varchar else '7+' end, word[1], word[-1], case when regexp_matches(word, '[tkpf]') then '1' else '0' end]) as value from tokens where line_len >= 5)
    select corpus, bin, feature, value, count(*) as n from f group by all""")
def positional_features(spark, sf_dir):
    """Feature values by place in the line, long form."""
    t = C.tokens(C.lines(spark, sf_dir)).where("line_len >= 5")
    e = t.select("corpus", T.position_bin(F.col("pos"), F.col("line_len")).alias("bin"), F.explode(T.word_features(F.col("word"))).alias("f"))
    return e.groupBy("corpus", "bin", "f.feature", "f.value").agg(F.count("*").alias("n"))


@analysis(oracle=f"""with {sql.LINES}, p as (select corpus, source, doc_id, line_no, sum((line_no % 5 = 0)::int) over (partition by doc_id order by line_no rows unbounded preceding) as par, words from lines)
    select corpus, count(*) as paragraphs, round(avg(n), 6) as mean_lines, round(avg(k), 6) as mean_words from (select corpus, doc_id, par, count(*) as n, sum(len(words)) as k from p group by all) group by corpus""")
def paragraph_assembly(spark, sf_dir):
    """Lines put together to paragraphs, of which every fifth line of a text starts one: a running count of starts."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = C.lines(spark, sf_dir).withColumn("par", F.sum((F.col("line_no") % 5 == 0).cast("int")).over(w))
    per = p.groupBy("corpus", "doc_id", "par").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("k"))
    return per.groupBy("corpus").agg(F.count("*").alias("paragraphs"), F.round(F.avg("n"), 6).alias("mean_lines"), F.round(F.avg("k"), 6).alias("mean_words"))


@analysis(oracle=f"""with {sql.LINES}, s as (select corpus, doc_id, line_no, case when line_no % 4 = 0 then words[1] end as head, words from lines)
    select corpus, doc_id, line_no, last_value(head ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as section from s""")
def forward_fill_section(spark, sf_dir):
    """Each line's section: the first word of the last line before it that heads one, every fourth line here."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line_no") % 4 == 0, F.element_at("words", 1))
    return C.lines(spark, sf_dir).select("corpus", "doc_id", "line_no", F.last(head, ignorenulls=True).over(w).alias("section"))


@analysis(oracle=f"""with {sql.PAIRS}, t as (select corpus, a as word, 'right' as side, b as other from pairs union all select corpus, b, 'left', a from pairs),
    c as (select corpus, word, side, other, count(*) as n from t where word in ('the', 'and', 'of') group by all)
    select corpus, word, side, other, n from c qualify row_number() over (partition by corpus, word, side order by n desc, other) <= 10""")
def word_contexts(spark, sf_dir, words=("the", "and", "of")):
    """The ten most frequent neighbours on either side of the words asked for, in every corpus."""
    p = C.pairs(C.lines(spark, sf_dir))
    t = p.select("corpus", F.col("a").alias("word"), F.lit("right").alias("side"), F.col("b").alias("other")).unionByName(
        p.select("corpus", F.col("b").alias("word"), F.lit("left").alias("side"), F.col("a").alias("other"))
    )
    c = stats.freq(t.where(F.col("word").isin(*words)), ["corpus", "word", "side"], "other")
    w = Window.partitionBy("corpus", "word", "side").orderBy(F.desc("n"), "other")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


@analysis(oracle="""with l as (select event_type, user_id, ts, event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before from events)
    select user_id, count(*) as n, count(before) as with_previous, max(event_id - before) as longest_step from l group by user_id""")
def lag_gap(spark, sf_dir):
    """Steps between a user's consecutive events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = C.table(spark, sf_dir, "events").withColumn("before", F.lag("event_id").over(w))
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count("before").alias("with_previous"), F.max(F.col("event_id") - F.col("before")).alias("longest_step")
    )


# ---- fingerprint

FEATURES = (
    "n_tokens", "n_types", "mean_wlen", "ttr_5000", "hapax_mid", "heaps_beta", "zipf_alpha", "h0_char", "h1_char", "h2_char",
    "h2_ratio", "h_word", "pos_predict", "line_init_jsd", "line_final_jsd", "adj_exact", "adj_near",
)


def fingerprint(lines: DataFrame, first: int = 5000) -> DataFrame:
    """One row of 17 features for each corpus of (corpus, doc_id, line_no, words); null where a feature is undefined.

    The corpora share every aggregation. Order-bound features use each type's first place, not a sort of the tokens.
    """
    by = ["corpus"]
    numbered = C.tokens(order.number_tokens(lines))
    types = numbered.groupBy(*by, "word").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    base = types.groupBy(*by).agg(
        F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), (F.sum(F.col("n") * F.length("word")) / F.sum("n")).alias("mean_wlen"),
        F.count_if(F.col("first") < first).alias("seen_first"), stats.plogp().alias("h_word"),
    )
    base = base.withColumn("ttr_5000", F.col("seen_first") / F.least("n_tokens", F.lit(first)))
    mid = base.select(*by, F.floor(F.col("n_tokens") / 2).alias("mid"))
    half = numbered.join(F.broadcast(mid), by).where(F.col("ord") < F.col("mid")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    half = half.groupBy(*by).agg((F.count_if(F.col("n") == 1) / F.count("*")).alias("hapax_mid"))
    parts = [
        half,
        stats.heaps(types, by).withColumnRenamed("beta", "heaps_beta"),
        stats.zipf(types, by).withColumnRenamed("alpha", "zipf_alpha"),
        char_stack(numbered, by, ["doc_id", "line_no", "pos"]),
        position_predictability(numbered, by),
        edge_jsd(lines, by),
        adjacency(lines, by),
    ]
    out = base
    for p in parts:  # one row a corpus
        out = out.join(p, by, "left")
    return out.select(*by, *(F.col(f).cast("double").alias(f) for f in FEATURES))


def documents_and_benchmark(spark, sf_dir) -> DataFrame:
    """The languages as corpora, and the benchmark as one more."""
    docs = C.lines(spark, sf_dir, ())
    bench = C.split_lines(C.table(spark, sf_dir, "benchmark"), F.lit("benchmark"), "item_id")
    return docs.unionByName(bench)


def _fp_sql(tokens: str) -> str:
    """17 features from `lines` and `tokens` of DuckDB, written out again."""
    return f"""{tokens},
    ordered as (select *, row_number() over (partition by corpus order by doc_id, line_no, pos) - 1 as ord from tokens),
    counts as (select corpus, word, count(*)::double as n, min(ord) as f from ordered group by all),
    base as (select corpus, sum(n) as n_tokens, count(*)::double as n_types, sum(n * length(word)) / sum(n) as mean_wlen, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h_word,
      count(*) filter (f < 5000) / least(sum(n), 5000) as ttr_5000 from counts group by corpus),
    hm as (select corpus, avg((k = 1)::int) as hapax_mid from (select o.corpus, word, count(*) as k from ordered o join base using (corpus) where ord < floor(n_tokens / 2) group by all) group by corpus),
    marks as (select corpus, floor(100 + i * ((n_tokens - 100) / 19.0) + 1e-9)::bigint as p from base, (select unnest(range(0, 20)) as i) where n_tokens >= 200),
    curve as (select m.corpus, p, count(*) as v from marks m join counts c on c.corpus = m.corpus and c.f < p group by all),
    hb as (select corpus, regr_slope(ln(v), ln(p)) as heaps_beta from curve group by corpus),
    zr as (select corpus, n, row_number() over (partition by corpus order by n desc) as r from counts),
    za as (select corpus, case when count(*) >= 10 then -regr_slope(ln(n), ln(r)) else 0 end as zipf_alpha from zr where r <= 500 group by corpus),
    cs as (select corpus, ord, string_split(word || ' ', '') as c from ordered),
    uni as (select corpus, c, count(*)::double as n from (select corpus, unnest(c) as c from cs) group by all),
    h1 as (select corpus, log2(count(*)) as h0_char, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h1_char from uni group by corpus),
    bi as (select corpus, c[i] as a, c[i + 1] as b from (select *, unnest(range(1, len(c))) as i from cs)
      union all select corpus, ' ', after from (select corpus, lead(c[1]) over (partition by corpus order by ord) as after from cs) where after is not null),
    j as (select corpus, a, b, count(*)::double as n from bi group by all),
    h2 as (select x.corpus, x.h - y.h as h2_char from (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from j group by corpus) x
      join (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select corpus, a, sum(n) as n from j group by all) group by corpus) y using (corpus)),
    spots as materialized (select corpus, i, c, count(*)::double as n from (select corpus, generate_subscripts(cs, 1) - 1 as i, unnest(cs) as c from (select corpus, string_split(word, '') as cs from tokens)) where i < 12 group by all),
    pp as (select x.corpus, avg(x.h) / any_value(y.h) as pos_predict from (select corpus, i, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from spots group by all having sum(n) >= 100) x
      join (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select corpus, c, sum(n) as n from spots group by all) group by corpus) y using (corpus) group by x.corpus),
    l3 as (select * from lines where len(words) >= 3),
    e as (select corpus, 'init' as kind, words[1][1] as c, 1 as edge from l3 union all select corpus, 'final', words[-1][-1], 1 from l3
      union all select corpus, 'init', unnest(list_transform(words[2:-2], lambda w: w[1])), 0 from l3
      union all select corpus, 'final', unnest(list_transform(words[2:-2], lambda w: w[-1])), 0 from l3),
    es as (select corpus, kind, c, sum(edge)::double as a, sum(1 - edge)::double as b from e group by all),
    ep as (select *, a / sum(a) over w as p, b / sum(b) over w as q from es window w as (partition by corpus, kind)),
    ed as (select corpus, kind, sum(0.5 * case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + 0.5 * case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as jsd from ep group by all),
    ej as (select corpus, max(jsd) filter (kind = 'init') as line_init_jsd, max(jsd) filter (kind = 'final') as line_final_jsd from ed group by corpus),
    ad as (select corpus, avg((words[i] = words[i + 1])::int) as adj_exact from (select *, unnest(range(1, len(words))) as i from lines) group by corpus),
    fp as (select corpus, n_tokens, n_types, mean_wlen, ttr_5000, hapax_mid, heaps_beta, zipf_alpha, h0_char, h1_char, h2_char, h2_char / h1_char as h2_ratio, h_word, pos_predict, line_init_jsd, line_final_jsd, adj_exact
      from base left join hm using (corpus) left join hb using (corpus) left join za using (corpus) left join h1 using (corpus) left join h2 using (corpus) left join pp using (corpus) left join ej using (corpus) left join ad using (corpus))"""


# adj_near counts characters, DuckDB's levenshtein bytes: the oracles leave that feature to adjacency_repetition
ORACLE_FEATURES = FEATURES[:-1]
FP_LINES = sql.LINES.replace("lines as (", "doclines as (", 1) + """,
lines as (
  select corpus, doc_id, line_no, words from doclines union all
  select 'benchmark', item_id, line_no, words from (select item_id, generate_subscripts(ls, 1) - 1 as line_no, regexp_extract_all(lower(unnest(ls)), '([\\p{L}]+)', 1) as words
    from (select *, string_split(text, chr(10)) as ls from benchmark)) where len(words) > 0),
tokens as (select corpus, doc_id, line_no, generate_subscripts(words, 1) - 1 as pos, len(words) as line_len, unnest(words) as word from lines)"""
FP = "with " + _fp_sql(FP_LINES)


@analysis(oracle=FP + " select corpus, " + ", ".join(f"round({f}, 5) as {f}" for f in ORACLE_FEATURES) + " from fp")
def corpus_fingerprint(spark, sf_dir):
    """The fingerprint of each language and of the benchmark, without adj_near, which DuckDB can't count."""
    fp = fingerprint(documents_and_benchmark(spark, sf_dir))
    return fp.select("corpus", *(F.round(f, 5).alias(f) for f in ORACLE_FEATURES))


NEAR = f""", {sql.ALPHABET}, pj as (select corpus, words[i] as a, words[i + 1] as b, count(*)::double as n from (select *, unnest(range(1, len(words))) as i from lines) group by all),
    an as (select corpus, sum(case when a <> b and abs(length(a) - length(b)) <= 0.25 * greatest(length(a), length(b)) and {sql.distance("a", "b")} <= 0.25 * greatest(length(a), length(b)) then n else 0 end) / sum(n) as adj_near from pj, alphabet group by corpus)"""


@analysis(oracle=FP + NEAR + " select corpus, " + ", ".join(f"round({f}, 5) as {f}" for f in FEATURES) + " from fp left join an using (corpus)")
def corpus_fingerprint_17(spark, sf_dir):
    """All 17 features."""
    fp = fingerprint(documents_and_benchmark(spark, sf_dir))
    return fp.select("corpus", *(F.round(f, 5).alias(f) for f in FEATURES))


COMPARED = ORACLE_FEATURES[2:]


def unpivoted(fp: DataFrame, features=COMPARED) -> DataFrame:
    """(corpus, feature, v) of the features that are defined."""
    return fp.unpivot(["corpus"], list(features), "feature", "v").where("v is not null and not isnan(v)")


def z_distance(fp: DataFrame, target: str) -> DataFrame:
    """(corpus, distance, features): mean |z| of the target by the other corpora's mean and spread, features without
    spread or known for fewer than two corpora left out."""
    long = unpivoted(fp)
    refs = long.where(F.col("corpus") != target).groupBy("feature").agg(
        F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.count("*").alias("k")
    )
    z = long.where(F.col("corpus") == target).join(refs, "feature").where("k >= 2 and sd >= 1e-12")
    return z.groupBy("corpus").agg(F.avg(F.abs((F.col("v") - F.col("mu")) / F.col("sd"))).alias("distance"), F.count("*").alias("features"))


UNPIVOT = FP + ", long as (select corpus, unnest([" + ", ".join(f"'{f}'" for f in COMPARED) + "]) as feature, unnest([" + ", ".join(COMPARED) + "]) as v from fp)"


@analysis(depends=("corpus_fingerprint",), target="benchmark", oracle=UNPIVOT + """, r as (select feature, avg(v) as mu, stddev_pop(v) as sd, count(*) as k from long where corpus <> 'benchmark' and v is not null group by all)
    select 'benchmark' as corpus, round(avg(abs((v - mu) / sd)), 4) as distance, count(*) as features from long join r using (feature) where corpus = 'benchmark' and v is not null and k >= 2 and sd >= 1e-12""")
def fingerprint_zdistance(spark, sf_dir, target="benchmark"):
    z = z_distance(fingerprint(documents_and_benchmark(spark, sf_dir)), target)
    return z.select("corpus", F.round("distance", 4).alias("distance"), "features")


def pairwise(fp: DataFrame) -> DataFrame:
    """(first, second, distance): mean difference of two corpora's features in units of the spread over all corpora."""
    long = unpivoted(fp)
    sd = long.groupBy("feature").agg(F.stddev_pop("v").alias("sd")).where("sd >= 1e-12")
    a = long.join(sd, "feature").select("feature", F.col("corpus").alias("first"), F.col("v").alias("x"), "sd")
    b = long.select("feature", F.col("corpus").alias("second"), F.col("v").alias("y"))
    both = a.join(b, "feature").where("first < second")
    return both.groupBy("first", "second").agg(F.avg(F.abs(F.col("x") - F.col("y")) / F.col("sd")).alias("distance"))


PAIRWISE = """, s as (select feature, stddev_pop(v) as sd from long where v is not null group by all),
    d as (select a.corpus as first, b.corpus as second, avg(abs(a.v - b.v) / sd) as distance from long a join long b on a.feature = b.feature and a.corpus < b.corpus join s on s.feature = a.feature where a.v is not null and b.v is not null and sd >= 1e-12 group by all)"""


@analysis(depends=("corpus_fingerprint",), oracle=UNPIVOT + PAIRWISE + " select first, second, round(distance, 4) as distance, row_number() over (order by round(distance, 4), first, second) as rank from d")
def pairwise_z_ranking(spark, sf_dir):
    d = pairwise(fingerprint(documents_and_benchmark(spark, sf_dir))).select("first", "second", F.round("distance", 4).alias("distance"))
    w = Window.partitionBy(F.lit(0)).orderBy("distance", "first", "second")  # a row for each pair of corpora
    return d.withColumn("rank", F.row_number().over(w))


HALF_LINES = FP_LINES.replace("select corpus, doc_id, line_no, words from doclines", "select corpus || '/' || (doc_id % 2) as corpus, doc_id, line_no, words from doclines").replace(
    "select 'benchmark', item_id", "select 'benchmark/' || (item_id % 2), item_id")


@analysis(depends=("corpus_fingerprint",), oracle="with " + _fp_sql(HALF_LINES) + UNPIVOT[len(FP):] + PAIRWISE + " select split_part(first, '/', 1) as corpus, round(distance, 4) as distance from d where split_part(first, '/', 1) = split_part(second, '/', 1)")
def halves_yardstick(spark, sf_dir):
    """How far the halves of one corpus, even and odd documents, are apart: the yardstick for distances of corpora."""
    lines = documents_and_benchmark(spark, sf_dir)
    lines = lines.withColumn("corpus", F.concat("corpus", F.lit("/"), (F.col("doc_id") % 2).cast("string")))
    d = pairwise(fingerprint(lines))
    own = F.substring_index("first", "/", 1)
    return d.where(own == F.substring_index("second", "/", 1)).select(own.alias("corpus"), F.round("distance", 4).alias("distance"))


@analysis(oracle=f"""with {sql.CHARS}, u as (select corpus, c, count(*)::double as n from chars group by all),
    k as (select corpus, word, count(*)::double as n from tokens group by all),
    f as (select corpus, avg(length(word)) as a, count(distinct word) / count(*) as b from tokens group by corpus),
    hc as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) as ic from u group by corpus),
    hw as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, avg((n = 1)::int) as hapax from k group by corpus)
    select f.corpus, round(a, 6) as mean_wlen, round(b, 6) as ttr, round(hc.h, 6) as h_char, round(ic, 6) as ic, round(hw.h, 6) as h_word, round(hapax, 6) as hapax_share, round(hc.h / hw.h, 6) as ratio
    from f join hc using (corpus) join hw using (corpus)""")
def seven_metric_fingerprint(spark, sf_dir):
    """The smaller fingerprint that encoding models are held against."""
    t = C.tokens(C.lines(spark, sf_dir))
    words = stats.freq(t, ["corpus"], "word")
    chars = stats.freq(C.characters(t), ["corpus"], "c")
    a = words.groupBy("corpus").agg(
        (F.sum(F.col("n") * F.length("word")) / F.sum("n")).alias("mean_wlen"), (F.count("*") / F.sum("n")).alias("ttr"),
        stats.plogp().alias("h_word"), F.avg((F.col("n") == 1).cast("int")).alias("hapax_share"),
    )
    b = stats.entropy(chars, ["corpus"], "h_char").join(stats.coincidence(chars, ["corpus"]), "corpus")
    j = a.join(b, "corpus").withColumn("ratio", F.col("h_char") / F.col("h_word"))
    return j.select("corpus", *(r6(c) for c in ("mean_wlen", "ttr", "h_char", "ic", "h_word", "hapax_share", "ratio")))
