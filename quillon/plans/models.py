"""Language models and held-out scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import nulls, stats
from quillon.plans import sql
from quillon.plans.information import r6
from quillon.plans.line_effects import BIN, recode
from quillon.registry import analysis
from quillon.sources import corpus as C

ALPHA = 0.5


def bigrams(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, n): letter pairs of words with a space on either side; words are counted before they are cut."""
    words = tokens.groupBy(*by, "word").agg(F.count("*").alias("n"))
    s = words.select(*by, "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("s"))
    e = s.select(*by, "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("ab"))
    return e.groupBy(*by, F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b")).agg(F.sum("n").alias("n"))


def score(model: DataFrame, test: DataFrame, by: list[str], vocabulary: DataFrame, alpha: float) -> DataFrame:
    """(by, bits, n): mean -log2 p of the test pairs, p = (n(a, b) + alpha) / (n(a) + alpha * letters)."""
    rows = model.groupBy(*[c for c in model.columns if c not in ("b", "n")]).agg(F.sum("n").alias("na"))
    keys = [c for c in model.columns if c not in ("a", "b", "n")]
    j = test.join(model.select(*keys, "a", "b", F.col("n").alias("nab")), [*keys, "a", "b"], "left").join(rows, [*keys, "a"], "left")
    j = j.join(vocabulary, keys) if keys else j.crossJoin(F.broadcast(vocabulary))
    p = (F.coalesce("nab", F.lit(0)) + alpha) / (F.coalesce("na", F.lit(0)) + alpha * F.col("letters"))
    return j.groupBy(*by).agg((F.sum(-F.log2(p) * F.col("n")) / F.sum("n")).alias("bits"), F.sum("n").alias("n"))


BI = f"""with {sql.TOKENS}, w as (select corpus, doc_id % 5 = 0 as test, ' ' || word || ' ' as s from tokens),
    e as (select corpus, test, s[i] as a, s[i + 1] as b from (select *, unnest(range(1, length(s))) as i from w)),
    m as (select corpus, a, b, count(*) as nab from e where not test group by all),
    r as (select corpus, a, sum(nab) as na from m group by all),
    v as (select corpus, count(distinct b) as letters from m group by all)"""


@analysis(alpha=0.5, oracle=BI + """, t as (select corpus, a, b, count(*) as n from e where test group by all)
    select t.corpus, round(sum(-log2((coalesce(nab, 0) + 0.5) / (coalesce(na, 0) + 0.5 * letters)) * n) / sum(n), 6) as bits, sum(n)::bigint as n
    from t left join m using (corpus, a, b) left join r on r.corpus = t.corpus and r.a = t.a join v on v.corpus = t.corpus group by t.corpus""")
def bigram_lm_bits(spark, sf_dir, alpha=0.5):
    """Bits per symbol of every fifth document under a letter model of the others."""
    t = C.tokens(C.lines(spark, sf_dir)).withColumn("test", F.col("doc_id") % 5 == 0)
    b = bigrams(t, ["corpus", "test"])
    model, test = b.where("not test").drop("test"), b.where("test").drop("test")
    letters = model.groupBy("corpus").agg(F.count_distinct("b").alias("letters"))
    return score(model, test, ["corpus"], letters, alpha).select("corpus", r6("bits"), "n")


@analysis(alpha=1.0, oracle=BI + """, t as (select corpus as tested, a, b, count(*) as n from e where test group by all), k as (select t.tested, v.corpus as model, t.a, t.b, t.n, letters from t cross join v)
    select k.model, k.tested, round(pow(2, sum(-log2((coalesce(nab, 0) + 1) / (coalesce(na, 0) + letters)) * n) / sum(n)), 5) as perplexity
    from k left join m on m.corpus = k.model and m.a = k.a and m.b = k.b left join r on r.corpus = k.model and r.a = k.a group by k.model, k.tested""")
def cross_perplexity(spark, sf_dir, alpha=1.0):
    """Every language's held-out letters under every language's model."""
    t = C.tokens(C.lines(spark, sf_dir)).withColumn("test", F.col("doc_id") % 5 == 0)
    b = bigrams(t, ["corpus", "test"])
    model = b.where("not test").select(F.col("corpus").alias("model"), "a", "b", "n")
    letters = model.groupBy("model").agg(F.count_distinct("b").alias("letters"))
    # a row for each pair of letters and model
    test = b.where("test").select(F.col("corpus").alias("tested"), "a", "b", "n").crossJoin(F.broadcast(letters.select("model")))
    s = score(model, test, ["model", "tested"], letters, alpha)
    return s.select("model", "tested", F.round(F.pow(F.lit(2.0), "bits"), 5).alias("perplexity"))


SPLITS = 10


def features_by_bin(lines: DataFrame, least: int = 5, keep: str = "doc_id") -> DataFrame:
    t = C.tokens(lines).where(F.col("line_len") >= least)
    return t.select(
        "corpus", keep, T.position_bin(F.col("pos"), F.col("line_len")).alias("bin"), F.explode(T.word_features(F.col("word"))).alias("f")
    ).select("corpus", keep, "bin", "f.feature", "f.value")


def split_masks(lines: DataFrame, seed: str, splits: int) -> DataFrame:
    """lines with `mask`, whose bit k says that the k-th split holds the document out: a fifth of them, by a hash of (k, doc_id)."""
    bits = [F.when(nulls.uniform(nulls.draw(seed, F.lit(k), "doc_id")) < 0.2, F.lit(1 << k)).otherwise(0) for k in range(splits)]
    return lines.withColumn("mask", sum(bits[1:], bits[0]))


def split_cells(rows: DataFrame, by: list[str], splits: int) -> DataFrame:
    """(by, split, train, test): rows with a mask counted for all splits in one pass; only the cells are taken apart."""
    held = [F.sum(F.col("mask").bitwiseAND(F.lit(1 << k)) / (1 << k)).cast("long") for k in range(splits)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*held).alias("held"))
    cells = sums.select(*by, "n", F.posexplode("held").alias("split", "test"))
    return cells.select(*by, "split", (F.col("n") - F.col("test")).alias("train"), "test")


def positional_gains(lines: DataFrame, splits: int = SPLITS, alpha: float = ALPHA) -> DataFrame:
    """(corpus, split, gain): bits per interior word that a model by place in the line gains on held-out documents."""
    told = features_by_bin(split_masks(lines, "gain", splits), keep="mask")
    keys = ["corpus", "split", "feature"]
    cells = split_cells(told, ["corpus", "feature", "bin", "value"], splits)
    w, wb, wv = (Window.partitionBy(*keys, *x) for x in ((), ("bin",), ("value",)))
    s = cells.select(
        *keys, "bin", "train", "test", F.sum("train").over(wb).alias("in_bin"), F.sum("train").over(wv).alias("of_value"),
        F.sum("train").over(w).alias("all"), "value",
    )
    known = s.where("of_value > 0").groupBy(*keys).agg(F.count_distinct("value").alias("v"))
    s = s.join(known, keys).where("bin like 'm%' and test > 0")
    gain = F.log2((F.col("train") + alpha) / (F.col("in_bin") + alpha * (F.col("v") + 1))) - F.log2(
        (F.col("of_value") + alpha) / (F.col("all") + alpha * (F.col("v") + 1))
    )
    per = s.groupBy("corpus", "split").agg(F.sum(gain * F.col("test")).alias("bits"), F.sum(F.when(F.col("feature") == "len", F.col("test"))).alias("n"))
    return per.select("corpus", "split", (F.col("bits") / F.col("n")).alias("gain"))


HELD = "('0x' || substring(md5('{seed}|' || split || '|' || doc_id), 1, 12))::bigint / 281474976710656.0 < 0.2"
GAIN = f"""with {sql.TOKENS}, f as (select corpus, doc_id, {BIN} as bin, unnest(['len', 'first', 'last', 'gallows']) as feature,
      unnest([case when length(word) < 7 then length(word)::varchar else '7+' end, word[1], word[-1], case when regexp_matches(word, '[tkpf]') then '1' else '0' end]) as value from tokens where line_len >= 5),
    d as (select corpus, doc_id, bin, feature, value, count(*) as n from f group by all),
    r as (select *, {HELD.format(seed="gain")} as held from d, (select unnest(range(0, 10)) as split)),
    tr as (select corpus, split, feature, bin, value, sum(n)::double as n from r where not held group by all),
    te as (select corpus, split, feature, bin, value, sum(n)::double as n from r where held and bin like 'm%' group by all),
    g as (select corpus, split, feature, value, sum(n) as n from tr group by all),
    tot as (select corpus, split, feature, sum(n) as n, count(*) as v from g group by all),
    b as (select corpus, split, feature, bin, sum(n) as n from tr group by all),
    s as (select te.corpus, te.split, te.feature, te.n, log2((coalesce(tr.n, 0) + 0.5) / (coalesce(b.n, 0) + 0.5 * (tot.v + 1))) - log2((coalesce(g.n, 0) + 0.5) / (tot.n + 0.5 * (tot.v + 1))) as gain
      from te left join tr using (corpus, split, feature, bin, value) left join b using (corpus, split, feature, bin) left join g using (corpus, split, feature, value) join tot using (corpus, split, feature)),
    x as (select corpus, split, sum(gain * n) / sum(n) filter (feature = 'len') as gain from s group by all)"""


@analysis(splits=SPLITS, oracle=GAIN + " select corpus, round(median(gain), 5) as gain, round(min(gain), 5) as low, round(max(gain), 5) as high from x group by corpus")
def positional_gain(spark, sf_dir, splits=SPLITS):
    g = positional_gains(C.lines(spark, sf_dir), splits)
    return g.groupBy("corpus").agg(F.round(F.percentile("gain", 0.5), 5).alias("gain"), F.round(F.min("gain"), 5).alias("low"), F.round(F.max("gain"), 5).alias("high"))


def class_events(lines: DataFrame, k: int = 12, least: int = 5, keep: str = "doc_id") -> DataFrame:
    """(corpus, doc_id or what else is kept, bin, prev, cls): classes by first letter, a corpus's k most frequent and "#"; "^" starts a line."""
    kept = lines.where(F.size("words") >= least)
    counts = stats.freq(C.tokens(kept).withColumn("cls", F.substring("word", 1, 1)), ["corpus"], "cls")
    table = recode(counts, k).groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("cls", "to"))).alias("map"))
    coded = kept.join(table, "corpus").select(  # a map of an alphabet for each corpus
        "corpus", keep, F.transform("words", lambda w: F.element_at("map", F.substring(w, 1, 1))).alias("words")
    )
    chain = F.arrays_zip(F.concat(F.array(F.lit("^")), F.slice("words", F.lit(1), F.size("words") - 1)).alias("prev"), F.col("words").alias("cls"))
    e = coded.select("corpus", keep, F.size("words").alias("line_len"), F.posexplode(chain).alias("pos", "x"))
    return e.select("corpus", keep, T.position_bin(F.col("pos"), F.col("line_len")).alias("bin"), "x.prev", "x.cls")


RPOS = f"""with {sql.TOKENS}, t5 as (select *, word[1] as c0 from tokens where line_len >= 5),
    kc as (select corpus, c0, row_number() over (partition by corpus order by count(*) desc, c0) <= 12 as keep from t5 group by corpus, c0),
    c as (select corpus, doc_id, {BIN} as bin, case when keep then c0 else '#' end as cls, line_no, pos from t5 join kc using (corpus, c0)),
    e as (select corpus, doc_id, bin, coalesce(lag(cls) over (partition by corpus, doc_id, line_no order by pos), '^') as prev, cls from c),
    r as (select *, {HELD.format(seed="class")} as held from (select corpus, doc_id, bin, prev, cls, count(*) as n from e group by all), (select unnest(range(0, 10)) as split)),
    tr as (select * from r where not held), te as (select corpus, split, bin, prev, cls, sum(n) as n from r where held group by all),
    u as (select corpus, split, cls, sum(n) as n from tr group by all), ut as (select corpus, split, sum(n) as n, count(distinct cls) + 1 + (max((cls = '#')::int) = 0)::int as v from u group by all),
    p as (select corpus, split, bin, cls, sum(n) as n from tr group by all), pt as (select corpus, split, bin, sum(n) as n from p group by all),
    b as (select corpus, split, prev, cls, sum(n) as n from tr group by all), bt as (select corpus, split, prev, sum(n) as n from b group by all),
    s as (select te.corpus, te.split, te.n, -log2((coalesce(u.n, 0) + 0.5) / (ut.n + 0.5 * v)) as lu, -log2((coalesce(p.n, 0) + 0.5) / (coalesce(pt.n, 0) + 0.5 * v)) as lp, -log2((coalesce(b.n, 0) + 0.5) / (coalesce(bt.n, 0) + 0.5 * v)) as lb
      from te left join u using (corpus, split, cls) join ut using (corpus, split) left join p using (corpus, split, bin, cls) left join pt using (corpus, split, bin) left join b using (corpus, split, prev, cls) left join bt using (corpus, split, prev)),
    x as (select corpus, split, (sum(lu * n) - sum(lp * n)) / sum(lu * n) as r_pos, (sum(lu * n) - sum(lb * n)) / sum(lu * n) as r_bi from s group by all)
    select corpus, round(median(r_pos), 5) as r_pos, round(median(r_bi), 5) as r_bi from x group by corpus"""


@analysis(splits=SPLITS, k=12, oracle=RPOS)
def r_pos_r_bi(spark, sf_dir, splits=SPLITS, k=12):
    """Shares of the held-out log loss of word classes that place in the line, or the class before, take away."""
    events = class_events(split_masks(C.lines(spark, sf_dir), "class", splits), k, keep="mask")
    keys = ["corpus", "split"]
    cells = split_cells(events, ["corpus", "bin", "prev", "cls"], splits)

    def seen(*cols):  # tables of classes and places, a few thousand rows a split
        return F.sum("train").over(Window.partitionBy(*keys, *cols))

    s = cells.select(
        *keys, "cls", "test", seen("cls").alias("u"), seen().alias("ut"), seen("bin", "cls").alias("p"), seen("bin").alias("pt"),
        seen("prev", "cls").alias("b"), seen("prev").alias("bt"),
    )
    known = s.where("u > 0").groupBy(*keys).agg(
        (F.count_distinct("cls") + 1 + F.when(F.max((F.col("cls") == "#").cast("int")) == 0, 1).otherwise(0)).alias("v")
    )
    s = s.join(known, keys)

    def loss(n: str, total: str):
        return F.sum(-F.log2((F.col(n) + ALPHA) / (F.col(total) + ALPHA * F.col("v"))) * F.col("test"))

    x = s.groupBy(*keys).agg(loss("u", "ut").alias("lu"), loss("p", "pt").alias("lp"), loss("b", "bt").alias("lb"))
    x = x.select("corpus", ((F.col("lu") - F.col("lp")) / F.col("lu")).alias("r_pos"), ((F.col("lu") - F.col("lb")) / F.col("lu")).alias("r_bi"))
    return x.groupBy("corpus").agg(F.round(F.percentile("r_pos", 0.5), 5).alias("r_pos"), F.round(F.percentile("r_bi", 0.5), 5).alias("r_bi"))


@analysis(oracle="""with c as (select role, least(turn, 4)::int as bin, least(length(text) // 100, 9) as len, conv_id % 5 = 0 as test, count(*)::double as n from conversations group by all),
    t as (select * from c where not test), b as (select bin, role, sum(n) as n from t group by all), g as (select role, sum(n) as n from t group by all), v as (select count(*) as v, sum(n) as total from g), bt as (select bin, sum(n) as n from b group by all),
    s as (select c.bin, sum(c.n) as n, sum(c.n * (log2((coalesce(b.n, 0) + 0.5) / (coalesce(bt.n, 0) + 0.5 * (v + 1))) - log2((coalesce(g.n, 0) + 0.5) / (total + 0.5 * (v + 1))))) as gain
      from c left join b using (bin, role) left join g using (role) left join bt using (bin) cross join v where c.test group by c.bin)
    select bin, n::bigint as n, round(gain / n, 5) as gain from s""")
def record_battery(spark, sf_dir):
    """Conversations as records: what a turn's number says about its role, in bits on held-out conversations."""
    c = C.table(spark, sf_dir, "conversations").select(F.least(F.col("turn"), F.lit(4)).cast("int").alias("bin"), "role", (F.col("conv_id") % 5 == 0).alias("test"))
    n = c.groupBy("bin", "role").agg(F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test"))
    one, w = Window.partitionBy(F.lit(0)), Window.partitionBy
    s = n.select(
        "bin", "test", "train", F.sum("train").over(w("bin")).alias("bt"), F.sum("train").over(w("role")).alias("g"), F.sum("train").over(one).alias("t"),
        F.size(F.collect_set(F.when(F.col("train") > 0, F.col("role"))).over(one)).alias("v"),
    )
    gain = F.log2((F.col("train") + ALPHA) / (F.col("bt") + ALPHA * (F.col("v") + 1))) - F.log2((F.col("g") + ALPHA) / (F.col("t") + ALPHA * (F.col("v") + 1)))
    return s.where("test > 0").groupBy("bin").agg(F.sum("test").alias("n"), F.round(F.sum(gain * F.col("test")) / F.sum("test"), 5).alias("gain"))


@analysis(oracle=f"""with {sql.TOKENS}, c as (select corpus, source, word, count(*)::double as n from tokens group by all), g as (select corpus, word, sum(n) as n from c group by all),
    v as (select corpus, count(*) as v, sum(n) as t from g group by corpus), st as (select corpus, source, sum(n) as n from c group by all)
    select c.corpus, c.source, round(sum(c.n * (log2((c.n + 0.5) / (st.n + 0.5 * v)) - log2((g.n + 0.5) / (t + 0.5 * v)))) / sum(c.n), 6) as ratio
    from c join g using (corpus, word) join v using (corpus) join st on st.corpus = c.corpus and st.source = c.source group by c.corpus, c.source""")
def section_likelihood_ratio(spark, sf_dir):
    """Bits per word that a source's own word frequencies gain over its language's."""
    c = stats.freq(C.tokens(C.lines(spark, sf_dir)), ["corpus", "source"], "word")
    g = c.groupBy("corpus", "word").agg(F.sum("n").alias("g"))
    v = g.groupBy("corpus").agg(F.count("*").alias("v"), F.sum("g").alias("t"))
    st = c.groupBy("corpus", "source").agg(F.sum("n").alias("st"))
    j = c.join(g, ["corpus", "word"]).join(v, "corpus").join(st, ["corpus", "source"])
    lr = F.log2((F.col("n") + 0.5) / (F.col("st") + 0.5 * F.col("v"))) - F.log2((F.col("g") + 0.5) / (F.col("t") + 0.5 * F.col("v")))
    return j.groupBy("corpus", "source").agg(F.round(F.sum(lr * F.col("n")) / F.sum("n"), 6).alias("ratio"))


@analysis(oracle=f"""with {sql.TOKENS}, u as (select corpus, source, word[1] as c, count(*)::double as n from tokens group by all), m as (select corpus, c, sum(n) / sum(sum(n)) over (partition by corpus) as p from u group by corpus, c)
    select u.corpus, source, round(sum(n * log2(p)) / sum(n), 6) as mean_log_prob from u join m using (corpus, c) group by all""")
def character_log_prob(spark, sf_dir):
    """First letters of each source scored under its language's shares."""
    u = stats.freq(C.tokens(C.lines(spark, sf_dir)).withColumn("c", F.substring("word", 1, 1)), ["corpus", "source"], "c")
    m = u.groupBy("corpus", "c").agg(F.sum("n").alias("m"))
    t = u.groupBy("corpus").agg(F.sum("n").alias("t"))
    j = u.join(m, ["corpus", "c"]).join(t, "corpus")
    return j.groupBy("corpus", "source").agg(F.round(F.sum(F.col("n") * F.log2(F.col("m") / F.col("t"))) / F.sum("n"), 6).alias("mean_log_prob"))
