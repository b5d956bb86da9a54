"""Joins and predicates over the tables: lexicons, coverage, ranges, neighbours, options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import stats
from quillon.plans import sql
from quillon.plans.vocabulary import word_counts
from quillon.registry import analysis
from quillon.sources import corpus as C


@analysis(oracle="""select n_name, r_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer
    left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by all""")
def equi_gloss_join(spark, sf_dir):
    """Each row glossed from two small tables."""
    c, n, r = (C.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@analysis(oracle="select lang, count(*) as n, sum(n_chars)::bigint as chars from documents where doc_id in (select doc_id from labels) group by lang")
def semi_labeled_docs(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@analysis(oracle="select lang, count(*) as n from documents where doc_id not in (select doc_id from labels) group by lang")
def anti_unlabeled_docs(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return d.groupBy("lang").agg(F.count("*").alias("n"))


@analysis(oracle=f"""with {sql.COUNTS} select coalesce(a.word, b.word) as word, coalesce(a.n, 0) as n_de, coalesce(b.n, 0) as n_es
    from (select * from counts where corpus = 'de') a full join (select * from counts where corpus = 'es') b on a.word = b.word""")
def outer_vocab_counts(spark, sf_dir):
    c = word_counts(spark, sf_dir)
    two = stats.sides(c.where("corpus = 'de'"), c.where("corpus = 'es'"), [], "word")
    return two.select("word", F.col("a").cast("long").alias("n_de"), F.col("b").cast("long").alias("n_es"))


BANDS = [("low", 0.0, 900.0), ("middle", 900.0, 1200.0), ("upper", 1200.0, 1600.0), ("top", 1600.0, 1e12)]


@analysis(oracle="with b(band, lo, hi) as (values " + ", ".join(f"('{n}', {a!r}::double, {b!r}::double)" for n, a, b in BANDS)
          + ") select band, count(*) as n, round(avg(p_retailprice), 4) as mean from part join b on p_retailprice >= lo and p_retailprice < hi group by band")
def range_section_join(spark, sf_dir):
    """Values put into the range that holds them; the ranges are a fixed, small table."""
    b = spark.createDataFrame(BANDS, "band string, lo double, hi double")
    p = C.table(spark, sf_dir, "part")
    j = p.join(F.broadcast(b), (p.p_retailprice >= b.lo) & (p.p_retailprice < b.hi))
    return j.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@analysis(oracle=f"""with {sql.TOKENS}, v as (select distinct corpus, source, word from tokens), k as (select corpus, source, count(*) as k from v group by all),
    j as (select a.corpus, a.source as first, b.source as second, count(*) as common from v a join v b on a.corpus = b.corpus and a.word = b.word and a.source < b.source group by all)
    select j.corpus, first, second, common, round(common / (x.k + y.k - common), 6) as jaccard from j join k x on x.corpus = j.corpus and x.source = first join k y on y.corpus = j.corpus and y.source = second""")
def all_pairs_source_similarity(spark, sf_dir):
    """Vocabularies of every two sources: each word's sources are one set, and equal sets are counted before they are paired."""
    v = C.tokens(C.lines(spark, sf_dir)).groupBy("corpus", "word").agg(F.array_sort(F.collect_set("source")).alias("held"))
    sets = v.groupBy("corpus", "held").agg(F.count("*").alias("n"))
    one = sets.select("corpus", "held", "n", F.explode("held").alias("first"))
    sizes = one.groupBy("corpus", "first").agg(F.sum("n").alias("k"))
    two = one.select("corpus", "n", "first", F.explode("held").alias("second")).where("first < second")
    common = two.groupBy("corpus", "first", "second").agg(F.sum("n").alias("common"))
    a = sizes.withColumnRenamed("k", "ka")
    b = sizes.select("corpus", F.col("first").alias("second"), F.col("k").alias("kb"))
    j = common.join(a, ["corpus", "first"]).join(b, ["corpus", "second"])
    return j.select("corpus", "first", "second", "common", F.round(F.col("common") / (F.col("ka") + F.col("kb") - F.col("common")), 6).alias("jaccard"))


@analysis(oracle="""with f as (select distinct l_returnflag as f from lineitem), s as (select distinct o_orderstatus as s from orders), t as (select distinct event_type as t from events)
    select f, s, t, f || s || t as option from f, s, t""")
def option_cross_join(spark, sf_dir):
    """Every combination of three closed sets of options."""
    f = C.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f")).distinct()
    s = C.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s")).distinct()
    t = C.table(spark, sf_dir, "events").select(F.col("event_type").alias("t")).distinct()
    return f.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(t)).withColumn("option", F.concat("f", "s", "t"))


@analysis(oracle="""with a as (select event_id, user_id, ts from events where event_type = (select min(event_type) from events)), b as (select event_id, user_id, ts from events where event_type = (select max(event_type) from events))
    select b.event_id, b.user_id, coalesce(max(a.event_id), -1) as before from b left join a on a.user_id = b.user_id and (a.ts < b.ts or a.ts = b.ts and a.event_id < b.event_id) group by all""")
def asof_prev_event(spark, sf_dir):
    """Each event of one type with the user's last one before it of another: a running last value over the union."""
    e = C.table(spark, sf_dir, "events")
    ends = e.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))  # one row
    t = e.crossJoin(F.broadcast(ends)).where("event_type in (first, last)")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    told = t.withColumn("before", F.last(F.when(F.col("event_type") == F.col("first"), F.col("event_id")), ignorenulls=True).over(w))
    return told.where(F.col("event_type") == F.col("last")).select("event_id", "user_id", F.coalesce("before", F.lit(-1).cast("long")).alias("before"))


@analysis(oracle="""with o as (select o_custkey, o_orderkey, o_orderdate, lead(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) - o_totalprice as step from orders)
    select o_custkey, count(*) as n, round(sum(step), 2) as steps from o group by o_custkey""")
def adjacent_pairs(spark, sf_dir):
    """Only neighbours in order are compared, by a window instead of a join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = C.table(spark, sf_dir, "orders").withColumn("step", F.lead("o_totalprice").over(w) - F.col("o_totalprice"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("step"), 2).alias("steps"))


@analysis(oracle=f"""with {sql.COUNTS}, s as (select corpus, word[:2] as stem, word[3:] as ending, n from counts where length(word) between 3 and 5),
    st as (select corpus, stem from s group by corpus, stem qualify row_number() over (partition by corpus order by sum(n) desc, stem) <= 10),
    en as (select corpus, ending from s group by corpus, ending qualify row_number() over (partition by corpus order by sum(n) desc, ending) <= 10)
    select st.corpus, st.stem, en.ending, coalesce(sum(s.n), 0)::bigint as n from st join en using (corpus) left join s on s.corpus = st.corpus and s.stem = st.stem and s.ending = en.ending group by all""")
def stem_affix_grid(spark, sf_dir):
    """Ten stems by ten endings of each language with their counts, empty cells included."""
    s = word_counts(spark, sf_dir).where(F.length("word").between(3, 5))
    s = s.select("corpus", F.substring("word", 1, 2).alias("stem"), F.expr("substring(word, 3)").alias("ending"), "n")

    def top(c):
        w = Window.partitionBy("corpus").orderBy(F.desc("n"), c)
        return s.groupBy("corpus", c).agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(w)).where("r <= 10").select("corpus", c)

    grid = top("stem").join(top("ending"), "corpus")
    cells = s.groupBy("corpus", "stem", "ending").agg(F.sum("n").alias("n"))
    return grid.join(cells, ["corpus", "stem", "ending"], "left").select("corpus", "stem", "ending", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@analysis(oracle="""with c as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as before from conversations)
    select role, coalesce(before, '^') as before, count(*) as n, round(avg(length(text)), 4) as mean_chars from c group by 1, 2""")
def turn_transitions(spark, sf_dir):
    """Records in order: which role follows which."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = C.table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("role").over(w), F.lit("^")))
    return c.groupBy("role", "before").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@analysis(oracle="""select o_orderpriority as b, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o,
    count(*) filter (o_orderstatus = 'P') as p from orders group by all""")
def contingency_pivot(spark, sf_dir):
    """A contingency table as wide rows, for display."""
    o = C.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("b"))
    return o.agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))


@analysis(oracle="""with b as (select distinct unnest(regexp_extract_all(lower(text), '([\\p{L}]+)', 1)) as w from benchmark), v as (select w, w as v from b union select w, replace(w, 'th', 't') from b union select w, replace(w, 'er', 'r') from b union select w, replace(w, 'ou', 'u') from b)
    select v, count(distinct w) as words from v group by v having count(distinct w) > 1""")
def phonetic_variants(spark, sf_dir):
    """Dictionary words that fall together under spelling variants."""
    b = C.table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    v = b.select("w", F.explode(T.variants(F.col("w"), [("th", "t"), ("er", "r"), ("ou", "u")])).alias("v"))
    return v.groupBy("v").agg(F.count_distinct("w").alias("words")).where("words > 1")
