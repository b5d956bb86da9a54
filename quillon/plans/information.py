"""Information: entropies, dependence of two variables, divergences of two populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import stats
from quillon.plans import sql
from quillon.plans.vocabulary import ordered_tokens, word_counts
from quillon.registry import analysis
from quillon.sources import corpus as C


def r6(name: str, out: str | None = None):
    return F.round(name, 6).alias(out or name)


# ---- characters

STACK = f"""with {sql.ORDERED}, cs as (select corpus, ord, string_split(word || ' ', '') as c from ordered),
    uni as (select corpus, unnest(c) as c from cs),
    nexts as (select corpus, ord, c[1] as first, lead(c[1]) over (partition by corpus order by ord) as after, c from cs),
    bi as (select corpus, c[i] as a, c[i + 1] as b from (select *, unnest(range(1, len(c))) as i from nexts)
           union all select corpus, ' ', after from nexts where after is not null),
    u as (select corpus, c, count(*) as n from uni group by all),
    h1 as (select corpus, log2(count(*)) as h0, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h1 from u group by corpus),
    j as (select corpus, a, b, count(*) as n from bi group by all),
    hj as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from j group by corpus),
    m as (select corpus, a, sum(n) as n from j group by all),
    hm as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from m group by corpus)
    select h1.corpus, round(h0, 6) as h0_char, round(h1, 6) as h1_char, round(hj.h - hm.h, 6) as h2_char, round((hj.h - hm.h) / h1, 6) as h2_ratio
    from h1 join hj using (corpus) join hm using (corpus)"""


def char_stack(tokens: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, h0_char, h1_char, h2_char, h2_ratio) of the character stream with a space after each word.

    The stream's pairs are those inside a word and its space, and from each word's space to the next word's first
    character, which every word but the corpus's first one gives: no order of tokens is needed, only which comes first.
    """
    spaced = tokens.withColumn("s", F.concat("word", F.lit(" ")))
    letters = spaced.select(*by, F.explode(F.split("s", "")).alias("c")).where("c <> ''")
    uni = stats.freq(letters, by, "c")
    h1 = uni.groupBy(*by).agg(F.log2(F.count("*").cast("double")).alias("h0_char"), stats.plogp().alias("h1_char"))
    places = F.sequence(F.lit(1), F.length("s") - 1)
    inner = spaced.select(*by, F.explode(F.transform(places, lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("ab"))
    inner = stats.freq(inner, by, "ab")
    begins = stats.freq(spaced.select(*by, F.concat(F.lit(" "), F.substring("word", 1, 1)).alias("ab")), by, "ab")
    first = spaced.groupBy(*by).agg(F.min(F.struct(*order, "word"))["word"].alias("w"))
    first = first.select(*by, F.concat(F.lit(" "), F.substring("w", 1, 1)).alias("ab"), F.lit(-1).cast("long").alias("n"))
    joint = inner.unionByName(begins).unionByName(first).groupBy(*by, "ab").agg(F.sum("n").alias("n")).where("n > 0")
    joint = joint.select(*by, F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b"), "n")
    h2 = stats.conditional_entropy(joint, by, "a", "h2_char")
    both = h1.join(h2, by)
    return both.withColumn("h2_ratio", F.when(F.col("h1_char") > 0, F.col("h2_char") / F.col("h1_char")))


@analysis(oracle=STACK)
def char_entropy_stack(spark, sf_dir):
    t = C.tokens(C.lines(spark, sf_dir))
    return char_stack(t, ["corpus"], ["doc_id", "line_no", "pos"]).select("corpus", r6("h0_char"), r6("h1_char"), r6("h2_char"), r6("h2_ratio"))


PREDICT = f"""with {sql.CHARS}, bi as (select corpus, c as b, lag(c) over (partition by corpus, doc_id, line_no, pos order by i) as a from chars),
    u as (select corpus, c, count(*) as n from chars group by all),
    hu as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from u group by corpus),
    j as (select corpus, a, b, count(*) as n from bi where a is not null group by all),
    hj as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from j group by corpus),
    m as (select corpus, a, sum(n) as n from j group by all),
    hm as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from m group by corpus)
    select hu.corpus, round((hj.h - hm.h) / hu.h, 6) as predictability from hu join hj using (corpus) join hm using (corpus)"""


@analysis(oracle=PREDICT)
def char_bigram_predictability(spark, sf_dir):
    """H(c | previous) / H(c) of characters within words."""
    t = C.tokens(C.lines(spark, sf_dir))
    uni = stats.entropy(stats.freq(C.characters(t), ["corpus"], "c"), ["corpus"], "h")
    places = F.when(F.length("word") > 1, F.sequence(F.lit(1), F.length("word") - 1))
    two = t.select("corpus", F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("ab"))
    joint = stats.freq(two, ["corpus"], "ab").select("corpus", F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b"), "n")
    cond = stats.conditional_entropy(joint, ["corpus"], "a", "hc")
    ratio = F.when(F.col("h") > 0, F.col("hc") / F.nullif("h", F.lit(0.0))).otherwise(1.0)
    return uni.join(cond, "corpus").select("corpus", F.round(ratio, 6).alias("predictability"))


@analysis(oracle=f"""with {sql.ORDERED}, bi as (select corpus, word as a, lead(word) over (partition by corpus order by ord) as b from ordered),
    u as (select corpus, a, count(*) as n from bi group by all),
    hu as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from u group by corpus),
    j as (select corpus, a, b, count(*) as n from bi where b is not null group by all),
    hj as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from j group by corpus),
    m as (select corpus, a, sum(n) as n from j group by all),
    hm as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from m group by corpus)
    select hu.corpus, round((hj.h - hm.h) / hu.h, 6) as ratio from hu join hj using (corpus) join hm using (corpus)""")
def word_bigram_entropy_ratio(spark, sf_dir):
    """H(next word | word) / H(word) over the unbroken stream.

    Pairs inside a line need no order; across lines, each line's last word meets the next line's first, by line number.
    """
    from quillon.operators.order import number_lines

    lines = C.lines(spark, sf_dir)
    inside = stats.freq(C.pairs(lines), ["corpus"], "a", "b")
    ends = number_lines(lines).select("corpus", "line_ord", F.element_at("words", 1).alias("b"), F.element_at("words", -1).alias("a"))
    after = ends.select("corpus", (F.col("line_ord") - 1).alias("line_ord"), "b")
    across = stats.freq(ends.select("corpus", "line_ord", "a").join(after, ["corpus", "line_ord"]), ["corpus"], "a", "b")
    joint = inside.unionByName(across).groupBy("corpus", "a", "b").agg(F.sum("n").alias("n"))
    cond = stats.conditional_entropy(joint, ["corpus"], "a", "hc")
    uni = stats.entropy(word_counts(spark, sf_dir), ["corpus"], "h")
    return uni.join(cond, "corpus").select("corpus", F.round(F.col("hc") / F.col("h"), 6).alias("ratio"))


@analysis(oracle=f"""with {sql.CHARS}, u as (select corpus, c, count(*) as n from chars group by all)
    select corpus, round(sum(n * (n - 1.0)) / (sum(n) * (sum(n) - 1.0)), 6) as ic from u group by corpus""")
def index_of_coincidence(spark, sf_dir):
    counts = stats.freq(C.characters(C.tokens(C.lines(spark, sf_dir))), ["corpus"], "c")
    return stats.coincidence(counts, ["corpus"]).select("corpus", r6("ic"))


@analysis(oracle=f"""with {sql.CHARS}, u as (select corpus, c, count(*)::double as n from chars group by all)
    select corpus, round(sum(n * n) / (sum(n) * sum(n)), 6) as hhi from u group by corpus""")
def char_hhi(spark, sf_dir):
    counts = stats.freq(C.characters(C.tokens(C.lines(spark, sf_dir))), ["corpus"], "c")
    return stats.concentration(counts, ["corpus"]).select("corpus", r6("hhi"))


def position_predictability(tokens: DataFrame, by: list[str], most: int = 12, least: int = 100) -> DataFrame:
    """(by, pos_predict): mean entropy of the places in a word that are seen `least` times, by that of all of them."""
    counts = stats.freq(C.characters(tokens, tuple(by)).where(F.col("i") < most), by, "i", "c")
    per = counts.groupBy(*by, "i").agg(stats.plogp().alias("h"), F.sum("n").alias("seen")).where(F.col("seen") >= least)
    whole = stats.entropy(counts.groupBy(*by, "c").agg(F.sum("n").alias("n")), by, "h_all")
    both = per.groupBy(*by).agg(F.avg("h").alias("h")).join(whole, by)
    return both.select(*by, F.when(F.col("h_all") > 0, F.col("h") / F.nullif("h_all", F.lit(0.0))).alias("pos_predict"))


POSITIONS = f"""with {sql.CHARS}, k as (select corpus, i, c, count(*) as n from chars where i < 12 group by all),
    per as (select corpus, i, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from k group by all having sum(n) >= 100),
    u as (select corpus, c, sum(n) as n from k group by all),
    a as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from u group by corpus)
    select per.corpus, round(avg(per.h) / any_value(a.h), 6) as pos_predict from per join a using (corpus) group by per.corpus"""


@analysis(oracle=POSITIONS)
def positional_predictability(spark, sf_dir):
    return position_predictability(C.tokens(C.lines(spark, sf_dir)), ["corpus"]).select("corpus", r6("pos_predict"))


# ---- two variables

HLP = """j as (select {by}{x} as x, {y} as y, count(*)::double as n from {t} group by all),
    hj as (select {k}log2(sum(n)) - sum(n * log2(n)) / sum(n) as hj from j {g}),
    hx as (select {k}log2(sum(n)) - sum(n * log2(n)) / sum(n) as hx from (select {k}x, sum(n) as n from j group by all) {g}),
    hy as (select {k}log2(sum(n)) - sum(n * log2(n)) / sum(n) as hy from (select {k}y, sum(n) as n from j group by all) {g})"""


def hlp(t: str, x: str, y: str) -> str:
    return "with " + HLP.format(by="", x=x, y=y, t=t, k="", g="")


def flags(spark, sf_dir) -> DataFrame:
    return stats.freq(C.table(spark, sf_dir, "lineitem"), [], "l_returnflag", "l_linestatus")


@analysis(oracle=hlp("lineitem", "l_returnflag", "l_linestatus") + " select round(hj - hx, 6) as h_cond from hj, hx")
def conditional_entropy_flags(spark, sf_dir):
    return stats.conditional_entropy(flags(spark, sf_dir), [], "l_returnflag").select(r6("h_cond"))


@analysis(oracle=hlp("lineitem", "l_returnflag", "l_linestatus") + """ select round(hx + hy - hj, 6) as mi, round(hx, 6) as h_x, round(hy, 6) as h_y,
    round((hx + hy - hj) / least(hx, hy), 6) as normalized from hj, hx, hy""")
def mutual_information_flags(spark, sf_dir):
    m = stats.mutual_information(flags(spark, sf_dir), [], "l_returnflag", "l_linestatus")
    return m.select(r6("mi"), r6("h_x"), r6("h_y"), r6("normalized"))


@analysis(oracle="with " + HLP.format(by="lang as lang, ", x="source", y="length(text) // 500", t="documents", k="lang, ", g="group by lang")
          + " select lang, round((hx + hy - hj) / least(hx, hy), 6) as normalized from hj join hx using (lang) join hy using (lang)")
def normalized_mi(spark, sf_dir):
    """Of a document's source and its length, by language."""
    d = C.table(spark, sf_dir, "documents").withColumn("size", F.floor(F.length("text") / 500))
    m = stats.mutual_information(stats.freq(d, ["lang"], "source", "size"), ["lang"], "source", "size")
    return m.select("lang", r6("normalized"))


@analysis(oracle="""with j as (select o_orderstatus as z, o_orderpriority as x, floor(o_totalprice / 50000) as y, count(*)::double as n from orders group by all),
    t as (select *, sum(n) over (partition by z) as nz, sum(n) over (partition by z, x) as nx, sum(n) over (partition by z, y) as ny from j)
    select round(sum(n * log2(n * nz / (nx * ny))) / sum(n), 6) as cmi from t""")
def conditional_mi_by_status(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 50000).alias("band"), F.lit(0).alias("all")
    )
    joint = stats.freq(o, ["all"], "o_orderstatus", "o_orderpriority", "band")
    return stats.conditional_mutual_information(joint, ["all"], "o_orderpriority", "band", "o_orderstatus").select(r6("cmi"))


@analysis(oracle="with " + HLP.format(by="", x="source", y="lang", t="documents", k="", g="") + " select round((hx + hy - hj) / hy, 6) as u from hj, hx, hy")
def uncertainty_coefficient(spark, sf_dir):
    return stats.uncertainty(stats.freq(C.table(spark, sf_dir, "documents"), [], "source", "lang"), [], "source", "lang").select(r6("u"))


@analysis(oracle="""with j as (select o_orderpriority as x, o_orderstatus as y, count(*)::double as n from orders group by all),
    t as (select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as total from j),
    c as (select max(total) * (sum(n * n / (nx * ny)) - 1) as chi2, max(total) as total, least(count(distinct x), count(distinct y)) - 1 as k from t)
    select round(chi2, 4) as chi2, round(sqrt(greatest(chi2, 0) / (total * k)), 6) as v from c""")
def cramers_v_orders(spark, sf_dir):
    j = stats.freq(C.table(spark, sf_dir, "orders"), [], "o_orderpriority", "o_orderstatus")
    x = stats.chi2(j, [], "o_orderpriority", "o_orderstatus")
    return x.crossJoin(stats.cramers_v(j, [], "o_orderpriority", "o_orderstatus")).select(F.round("chi2", 4).alias("chi2"), r6("v"))


@analysis(oracle="""with n as (select event_type, count(*)::double as n from events group by all),
    e as (select n, sum(n) over () / count(*) over () as expected from n),
    c as (select sum((n - expected) * (n - expected) / expected) as chi2, count(*) - 1 as df from e where expected >= 1),
    z as (select *, (pow(chi2 / df, 1 / 3.0) - (1 - 2 / (9.0 * df))) / sqrt(2 / (9.0 * df)) as z from c),
    q as (select *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) as t, abs(z) / sqrt(2) as x from z),
    f as (select *, t * exp(-x * x + -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807
      + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) as erfc from q)
    select round(chi2, 4) as chi2, df, round(case when z >= 0 then erfc / 2 else 1 - erfc / 2 end, 5) as p from f""")
def chi2_gof_event_types(spark, sf_dir):
    """Event types against equal shares."""
    n = stats.freq(C.table(spark, sf_dir, "events"), [], "event_type")
    w = Window.partitionBy(F.lit(0))
    n = n.withColumn("expected", F.sum("n").over(w) / F.count("*").over(w))
    return stats.chi2_fit(n, []).select(F.round("chi2", 4).alias("chi2"), "df", F.round("p", 5).alias("p"))


PMI = f"""with {sql.PAIRS}, j as (select corpus, a, b, count(*)::double as n from pairs group by all),
    t as (select *, sum(n) over (partition by corpus, a) as na, sum(n) over (partition by corpus, b) as nb, sum(n) over (partition by corpus) as total from j)
    select corpus, a, b, n::bigint as n, round(VALUE, 6) as NAME from t where n >= 5"""


def pmi_table(spark, sf_dir, least: int) -> DataFrame:
    """(corpus, a, b, n, pmi) of adjacent words seen together `least` times."""
    j = stats.freq(C.pairs(C.lines(spark, sf_dir)), ["corpus"], "a", "b")
    na = j.groupBy("corpus", "a").agg(F.sum("n").alias("na"))
    nb = j.groupBy("corpus", "b").agg(F.sum("n").alias("nb"))
    total = j.groupBy("corpus").agg(F.sum("n").alias("total"))
    t = j.where(F.col("n") >= least).join(na, ["corpus", "a"]).join(nb, ["corpus", "b"]).join(F.broadcast(total), "corpus")
    return t.withColumn("pmi", F.log2(F.col("n") * F.col("total").cast("double") / (F.col("na").cast("double") * F.col("nb"))))


@analysis(least=5, oracle=PMI.replace("VALUE", "log2(n * total / (na * nb))").replace("NAME", "pmi"))
def pmi_pairs(spark, sf_dir, least=5):
    return pmi_table(spark, sf_dir, least).select("corpus", "a", "b", "n", r6("pmi"))


@analysis(k=20, oracle=PMI.replace("VALUE", "greatest(log2(n * total / (na * nb)), 0)").replace("NAME", "ppmi") + " qualify row_number() over (partition by corpus order by ppmi desc, a, b) <= 20")
def ppmi_topk(spark, sf_dir, k=20):
    p = pmi_table(spark, sf_dir, 5).select("corpus", "a", "b", "n", F.round(F.greatest("pmi", F.lit(0.0)), 6).alias("ppmi"))
    w = Window.partitionBy("corpus").orderBy(F.desc("ppmi"), "a", "b")
    return p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


# ---- two populations

JSD = f"""with {sql.COUNTS}, v as (select corpus, word, n * 1.0 / sum(n) over (partition by corpus) as p from counts),
    cp as (select distinct corpus from counts),
    j as (select a.corpus as first, b.corpus as second, v.word, sum(case when v.corpus = a.corpus then p else 0 end) as p, sum(case when v.corpus = b.corpus then p else 0 end) as q
          from cp a join cp b on a.corpus < b.corpus join v on v.corpus in (a.corpus, b.corpus) group by all),
    d as (select first, second, sum(0.5 * case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + 0.5 * case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as jsd from j group by all)"""


def lang_sides(spark, sf_dir) -> DataFrame:
    """Word counts of every two languages side by side."""
    c = word_counts(spark, sf_dir)
    names = c.select("corpus").distinct()  # one row a language
    two = names.select(F.col("corpus").alias("first")).join(F.broadcast(names.select(F.col("corpus").alias("second"))), F.col("first") < F.col("second"))
    left = c.join(F.broadcast(two), F.col("corpus") == F.col("first")).select("first", "second", "word", "n")
    right = c.join(F.broadcast(two), F.col("corpus") == F.col("second")).select("first", "second", "word", "n")
    return stats.sides(left, right, ["first", "second"], "word")


@analysis(oracle=JSD + " select first, second, round(jsd, 6) as jsd from d")
def jsd_lang_pairs(spark, sf_dir):
    return stats.jsd(lang_sides(spark, sf_dir), ["first", "second"]).select("first", "second", r6("jsd"))


@analysis(oracle=JSD + " select first, second, round(sqrt(jsd), 6) as distance from d")
def jsd_distance(spark, sf_dir):
    d = stats.jsd(lang_sides(spark, sf_dir), ["first", "second"], "distance", distance=True)
    return d.select("first", "second", r6("distance"))


@analysis(oracle=f"""with {sql.TOKENS}, c as (select corpus, length(word) as k, count(*) as n from tokens group by all),
    a as (select corpus, k, n * 1.0 / sum(n) over (partition by corpus) as p from c),
    w as (select k, sum(n) * 1.0 / sum(sum(n)) over () as q from c group by k)
    select corpus, round(sum(p * log2(p / greatest(q, 1e-10))), 6) as kl from a join w using (k) group by corpus""")
def kl_length_dist(spark, sf_dir):
    """Word lengths of each language from those of all."""
    c = stats.freq(C.tokens(C.lines(spark, sf_dir)).select("corpus", F.length("word").alias("k")), ["corpus"], "k")
    every = c.groupBy("k").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(c.select("corpus").distinct()))
    return stats.kl(stats.sides(c, every, ["corpus"], "k"), ["corpus"]).select("corpus", r6("kl"))


@analysis(oracle=f"""with {sql.COUNTS}, s as (select word, sum(case when corpus = 'en' then n else 0 end)::double as a, sum(case when corpus = 'fr' then n else 0 end)::double as b
      from counts where corpus in ('en', 'fr') group by word), t as (select *, sum(a) over () as ta, sum(b) over () as tb from s)
    select word, round(ln((a + 0.5) / (ta - a + 0.5)) - ln((b + 0.5) / (tb - b + 0.5)), 6) as log_odds from t where a + b >= 50""")
def log_odds_lang(spark, sf_dir):
    c = word_counts(spark, sf_dir)
    two = stats.sides(c.where("corpus = 'en'").drop("corpus"), c.where("corpus = 'fr'").drop("corpus"), [], "word")
    totals = two.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    odds = two.crossJoin(F.broadcast(totals)).where("a + b >= 50")
    a = F.ln((F.col("a") + 0.5) / (F.col("ta") - F.col("a") + 0.5))
    return odds.select("word", F.round(a - F.ln((F.col("b") + 0.5) / (F.col("tb") - F.col("b") + 0.5)), 6).alias("log_odds"))


@analysis(oracle=f"""with {sql.COUNTS}, s as (select corpus, count(*) as k from counts group by corpus),
    j as (select a.corpus as first, b.corpus as second, count(*) as shared from counts a join counts b on a.word = b.word and a.corpus < b.corpus group by all)
    select first, second, shared, round(shared / (x.k + y.k - shared), 6) as jaccard from j join s x on x.corpus = first join s y on y.corpus = second""")
def jaccard_vocab_langs(spark, sf_dir):
    """By words with the set of languages that have them: pairs come from the few sets, not from joined vocabularies."""
    c = word_counts(spark, sf_dir)
    held = c.groupBy("word").agg(F.array_sort(F.collect_set("corpus")).alias("held"))
    sizes = c.groupBy("corpus").agg(F.count("*").alias("k"))
    sets = held.groupBy("held").agg(F.count("*").alias("n"))
    pairs = sets.select("n", "held", F.explode("held").alias("first")).select("n", "first", F.explode("held").alias("second")).where("first < second")
    both = pairs.groupBy("first", "second").agg(F.sum("n").alias("shared"))
    a = sizes.select(F.col("corpus").alias("first"), F.col("k").alias("ka"))
    b = sizes.select(F.col("corpus").alias("second"), F.col("k").alias("kb"))
    j = both.join(a, "first").join(b, "second")
    return j.select("first", "second", "shared", F.round(F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared")), 6).alias("jaccard"))


COSINE = f"""with {sql.TOKENS}, f as (select corpus, source, word, count(*)::double as n from tokens group by all),
    best as (select corpus, word, row_number() over (partition by corpus order by sum(n) desc, word) as r from f group by corpus, word),
    top as (select corpus, word from best where r <= 50),
    v as (select f.* from f join top using (corpus, word)),
    norm as (select corpus, source, sqrt(sum(n * n)) as z from v group by all),
    j as (select a.corpus, a.source as first, b.source as second, sum(a.n * b.n) as dot from v a join v b on a.corpus = b.corpus and a.word = b.word and a.source < b.source group by all)
    select j.corpus, first, second, round(dot / (x.z * y.z), 6) as cosine from j join norm x on x.corpus = j.corpus and x.source = first join norm y on y.corpus = j.corpus and y.source = second"""


@analysis(top=50, oracle=COSINE)
def cosine_source_profiles(spark, sf_dir, top=50):
    """Sources compared by their counts of a language's `top` words: one array per source, then pairs of sources."""
    f = stats.freq(C.tokens(C.lines(spark, sf_dir)), ["corpus", "source"], "word")
    w = Window.partitionBy("corpus").orderBy(F.desc("n"), "word")
    best = f.groupBy("corpus", "word").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    v = f.join(F.broadcast(best.select("corpus", "word", "r")), ["corpus", "word"])
    per = v.groupBy("corpus", "source").agg(F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(top)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double"))
    per = per.select("corpus", "source", dense.alias("v"))
    a = per.select("corpus", F.col("source").alias("first"), F.col("v").alias("x"))
    b = per.select("corpus", F.col("source").alias("second"), F.col("v").alias("y"))
    both = a.join(b, "corpus").where("first < second")
    return both.select("corpus", "first", "second", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x, y):
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm > 0, dot(x, y) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


# ---- order and prefixes

LEADS = ", ".join(f"lead(x, {d}) over w" for d in (1, 2, 3, 5, 10, 20, 40, 80))
MI_D = f"""with {sql.ORDERED}, s as (select corpus, ord, word[1] as x from ordered),
    e as (select corpus, x, unnest([1, 2, 3, 5, 10, 20, 40, 80]) as d, unnest([{LEADS}]) as y from s window w as (partition by corpus order by ord)),
    j as (select corpus, d, x, y, count(*)::double as n from e where y is not null group by all),
    t as (select *, sum(n) over (partition by corpus, d, x) as nx, sum(n) over (partition by corpus, d, y) as ny, sum(n) over (partition by corpus, d) as total from j),
    m as (select corpus, d, sum(n * log2(n * total / (nx * ny))) / max(total) as mi from t group by all)"""

DISTANCES = (1, 2, 3, 5, 10, 20, 40, 80)


def mi_by_distance(spark, sf_dir) -> DataFrame:
    """(corpus, d, mi) of the first letters of words d apart in the corpus: an equi-join on shifted places."""
    s = ordered_tokens(spark, sf_dir).select("corpus", "ord", F.substring("word", 1, 1).alias("x"))
    moved = s.select("corpus", F.explode(F.array(*map(F.lit, DISTANCES))).alias("d"), F.col("x").alias("y"), "ord")
    moved = moved.withColumn("ord", F.col("ord") - F.col("d"))
    joint = stats.freq(s.join(moved, ["corpus", "ord"]), ["corpus", "d"], "x", "y")
    return stats.mutual_information(joint, ["corpus", "d"], "x", "y").select("corpus", "d", "mi")


@analysis(oracle=MI_D + " select corpus, d, round(mi, 6) as mi from m")
def mi_distance_profile(spark, sf_dir):
    return mi_by_distance(spark, sf_dir).select("corpus", "d", r6("mi"))


@analysis(oracle=MI_D + """ select corpus, round(sum((b - a) * (mi + after) / 2) filter (a >= 20), 6) as meaning_area, round(sum((b - a) * (mi + after) / 2) filter (b <= 10), 6) as generative_area
    from (select corpus, d as a, lead(d) over w as b, mi, lead(mi) over w as after from m window w as (partition by corpus order by d)) group by corpus""")
def text_meaning_area(spark, sf_dir):
    """Areas under the curve from 20 to 80 and from 1 to 10, by trapezoids."""
    w = Window.partitionBy("corpus").orderBy("d")
    m = mi_by_distance(spark, sf_dir).select("corpus", F.col("d").alias("a"), F.lead("d").over(w).alias("b"), "mi", F.lead("mi").over(w).alias("next"))
    area = (F.col("b") - F.col("a")) * (F.col("mi") + F.col("next")) / 2
    return m.groupBy("corpus").agg(
        F.round(F.sum(F.when(F.col("a") >= 20, area)), 6).alias("meaning_area"),
        F.round(F.sum(F.when(F.col("b") <= 10, area)), 6).alias("generative_area"),
    )


BRANCH = f"""with {sql.COUNTS}, p as (select corpus, k as depth, word[:k] as prefix, word[k + 1:k + 1] as after, sum(n)::double as n
      from (select *, unnest(range(0, least(length(word), 8))) as k from counts) group by all),
    e as (select corpus, depth, prefix, sum(n) as total, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from p group by all having sum(n) >= 2),
    d as (select corpus, depth, count(*) as nodes, avg(h) as mean_h, sum(h * total) / sum(total) as weighted_h from e group by all)"""


def branching(spark, sf_dir, depth: int = 8) -> DataFrame:
    """(corpus, depth, nodes, mean_h, weighted_h): entropy of the next letter over the prefixes seen twice or more."""
    c = word_counts(spark, sf_dir)
    cuts = F.sequence(F.lit(0), F.least(F.length("word"), F.lit(depth)) - 1)
    e = c.select("corpus", "word", "n", F.explode(cuts).alias("depth"))
    p = e.groupBy("corpus", "depth", F.expr("substring(word, 1, depth)").alias("prefix"), F.expr("substring(word, depth + 1, 1)").alias("after")).agg(F.sum("n").alias("n"))
    h = p.groupBy("corpus", "depth", "prefix").agg(stats.plogp().alias("h"), F.sum("n").alias("total")).where("total >= 2")
    return h.groupBy("corpus", "depth").agg(
        F.count("*").alias("nodes"), F.avg("h").alias("mean_h"), (F.sum(F.col("h") * F.col("total")) / F.sum("total")).alias("weighted_h")
    )


@analysis(oracle=BRANCH + " select corpus, depth::int as depth, nodes, round(mean_h, 6) as mean_h, round(weighted_h, 6) as weighted_h from d")
def prefix_branching_entropy(spark, sf_dir):
    return branching(spark, sf_dir).select("corpus", "depth", "nodes", r6("mean_h"), r6("weighted_h"))


PEAKS = """ select corpus, depth::int as depth, round(weighted_h, 6) as weighted_h from (select *, lag(weighted_h) over w as l, lead(weighted_h) over w as r from d window w as (partition by corpus order by depth)) where weighted_h > l and weighted_h > r"""


@analysis(oracle=BRANCH + PEAKS)
def boundary_peaks(spark, sf_dir):
    """Depths at which more ways lead on than before and after."""
    w = Window.partitionBy("corpus").orderBy("depth")
    d = branching(spark, sf_dir).select("corpus", "depth", "weighted_h", F.lag("weighted_h").over(w).alias("l"), F.lead("weighted_h").over(w).alias("r"))
    return d.where("weighted_h > l and weighted_h > r").select("corpus", "depth", r6("weighted_h"))


@analysis(oracle=f"""with {sql.PAIRS}, j as (select a.corpus, a.a, a.b, count(*)::double as n from pairs a group by all),
    p as (select corpus, source_half as half, a, b, count(*)::double as n from (select *, doc_id % 2 as source_half from pairs) group by all),
    r as (select *, sum(n) over (partition by corpus, half, a) as na from p),
    x as (select * from r where half = 0 and na >= 50), y as (select * from r where half = 1 and na >= 50),
    pair as (select x.corpus, x.n / x.na as u, y.n / y.na as v from x join y using (corpus, a, b))
    select corpus, count(*) as cells, round(corr(u, v), 6) as r from pair group by corpus having count(*) >= 3 and stddev_pop(u) > 0 and stddev_pop(v) > 0""")
def transition_matrix_correlation(spark, sf_dir):
    """Word transitions of even and odd documents: correlation over the cells that both have, of rows seen 50 times."""
    p = C.pairs(C.lines(spark, sf_dir), keep=("corpus", "doc_id")).withColumn("half", F.pmod("doc_id", F.lit(2)))
    j = stats.freq(p, ["corpus", "half"], "a", "b")
    rows = j.groupBy("corpus", "half", "a").agg(F.sum("n").alias("na")).where("na >= 50")
    t = j.join(rows, ["corpus", "half", "a"]).withColumn("p", F.col("n") / F.col("na"))
    x = t.where("half = 0").select("corpus", "a", "b", F.col("p").alias("u"))
    y = t.where("half = 1").select("corpus", "a", "b", F.col("p").alias("v"))
    out = x.join(y, ["corpus", "a", "b"]).groupBy("corpus").agg(
        F.count("*").alias("cells"), stats.guarded_corr("u", "v").alias("r"), F.stddev_pop("u").alias("su"), F.stddev_pop("v").alias("sv")
    )
    return out.where("cells >= 3 and su > 0 and sv > 0").select("corpus", "cells", r6("r"))
