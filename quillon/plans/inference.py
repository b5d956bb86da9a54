"""Correlations, effect sizes, thresholds, intervals, regressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import stats
from quillon.plans import sql
from quillon.plans.information import r6
from quillon.registry import analysis
from quillon.sources import corpus as C


@analysis(oracle="select l_returnflag, count(*) as n, round(case when stddev_pop(l_quantity) > 0 and stddev_pop(l_extendedprice) > 0 then corr(l_quantity, l_extendedprice) else 0 end, 6) as r from lineitem group by all")
def pearson_guarded(spark, sf_dir):
    li = C.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(stats.guarded_corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@analysis(oracle="""with r as (select p_brand, row_number() over (partition by p_brand order by p_size, p_partkey)::double as x, row_number() over (partition by p_brand order by p_retailprice, p_partkey)::double as y from part)
    select p_brand, round(corr(x, y), 6) as rho from r group by p_brand having count(*) >= 3""")
def spearman_ordinal(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    kept = p.groupBy("p_brand").agg(F.count("*").alias("k")).where("k >= 3")
    return stats.spearman(p.join(kept, "p_brand", "left_semi"), ["p_brand"], "p_size", "p_retailprice", ["p_partkey"]).select("p_brand", r6("rho"))


@analysis(oracle="""with c as (select l_returnflag, l_quantity - avg(l_quantity) over w as x, l_tax - avg(l_tax) over w as y from lineitem window w as (partition by l_returnflag, l_linestatus))
    select l_returnflag, round(corr(x, y), 5) as r from c group by all""")
def partial_corr_by_class(spark, sf_dir):
    """Centred by class through a join with the class means, so that a hot class is not one task's window."""
    li = C.table(spark, sf_dir, "lineitem")
    means = li.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("mx"), F.avg("l_tax").alias("my"))
    c = li.join(means, ["l_returnflag", "l_linestatus"])
    c = c.withColumn("x", F.col("l_quantity") - F.col("mx")).withColumn("y", F.col("l_tax") - F.col("my"))
    return c.groupBy("l_returnflag").agg(F.round(stats.guarded_corr("x", "y"), 5).alias("r"))


@analysis(oracle="""with d as (select lang, n_chars::double as x, toxic = 1 as g from documents join labels using (doc_id)),
    s as (select lang, avg(x) filter (g) as ma, avg(x) filter (not g) as mb, var_samp(x) filter (g) as va, var_samp(x) filter (not g) as vb, count(*) filter (g) as na, count(*) filter (not g) as nb from d group by lang)
    select lang, round(coalesce((ma - mb) / sqrt(nullif(((na - 1) * va + (nb - 1) * vb) / nullif(na + nb - 2, 0), 0)), 0), 5) as d from s""")
def cohens_d(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.round(stats.cohens_d("n_chars", F.col("toxic") == 1), 5).alias("d"))


@analysis(oracle="""with d as (select lang, n_chars as v, sum(quality)::bigint as ones, count(*) as n from documents join labels using (doc_id) group by all),
    r as (select lang, v, lead(v) over w as nx, sum(ones) over w as l1, sum(n) over w as ln, sum(ones) over (partition by lang) as t1, sum(n) over (partition by lang) as tn from d window w as (partition by lang order by v)),
    c as (select lang, (v + nx) / 2 as threshold, greatest((ln - l1) + (t1 - l1), tn - (ln - l1) - (t1 - l1)) / tn as accuracy from r where nx is not null)
    select lang, threshold, round(accuracy, 6) as accuracy from c qualify row_number() over (partition by lang order by accuracy desc, threshold) = 1""")
def best_threshold(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels"), "doc_id")
    return stats.best_threshold(d, ["lang"], "n_chars", "quality").select("lang", "threshold", r6("accuracy"))


@analysis(oracle="select event_type, round(quantile_cont(value, 0.025), 6) as low, round(median(value), 6) as mid, round(quantile_cont(value, 0.975), 6) as high, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd from events group by event_type")
def percentile_ci(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(
        F.round(F.percentile("value", 0.025), 6).alias("low"), F.round(F.percentile("value", 0.5), 6).alias("mid"), F.round(F.percentile("value", 0.975), 6).alias("high"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"),
    )


@analysis(oracle="select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by all")
def ols_slope_r2(spark, sf_dir):
    li = C.table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return li.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@analysis(oracle="""with s as (select count(*)::double as n, sum(l_quantity) as a, sum(l_discount) as b, sum(l_extendedprice) as y, sum(l_quantity * l_quantity) as aa, sum(l_discount * l_discount) as bb, sum(l_quantity * l_discount) as ab, sum(l_quantity * l_extendedprice) as ay, sum(l_discount * l_extendedprice) as bl from lineitem),
    c as (select aa - a * a / n as saa, bb - b * b / n as sbb, ab - a * b / n as sab, ay - a * y / n as say, bl - b * y / n as sby from s)
    select round((say * sbb - sby * sab) / (saa * sbb - sab * sab), 3) as quantity, round((sby * saa - say * sab) / (saa * sbb - sab * sab), 1) as discount from c""")
def ols_two_predictors(spark, sf_dir):
    """Least squares from sums of products alone: one aggregation, whatever the rows."""
    s = C.table(spark, sf_dir, "lineitem").agg(
        F.covar_pop("l_quantity", "l_quantity").alias("saa"), F.covar_pop("l_discount", "l_discount").alias("sbb"), F.covar_pop("l_quantity", "l_discount").alias("sab"),
        F.covar_pop("l_quantity", "l_extendedprice").alias("say"), F.covar_pop("l_discount", "l_extendedprice").alias("sby"),
    )
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    return s.select(
        F.round((F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab")) / det, 3).alias("quantity"),
        F.round((F.col("sby") * F.col("saa") - F.col("say") * F.col("sab")) / det, 1).alias("discount"),
    )


@analysis(oracle=f"""with {sql.TOKENS}, h as (select corpus, word from tokens group by all having count(*) = 1), p as (select t.corpus, t.source, count(*)::double as n from tokens t join h using (corpus, word) group by all),
    e as (select corpus, source, count(*)::double as k from tokens group by all), w as (select corpus, source, k / sum(k) over (partition by corpus) as share from e),
    x as (select p.corpus, n, share * sum(n) over (partition by p.corpus) as expected from p join w using (corpus, source))
    select corpus, sum(n)::bigint as hapaxes, round(sum((n - expected) * (n - expected) / greatest(expected, 1)), 4) as chi2, count(*) as sections from x group by corpus""")
def hapax_section_chi2(spark, sf_dir):
    """Once-only words by source against the sources' shares of all words."""
    t = C.tokens(C.lines(spark, sf_dir))
    once = t.groupBy("corpus", "word").agg(F.count("*").alias("k"), F.max("source").alias("source")).where("k = 1")
    p = once.groupBy("corpus", "source").agg(F.count("*").alias("n"))
    sizes = t.groupBy("corpus", "source").agg(F.count("*").alias("k"))
    totals = sizes.groupBy("corpus").agg(F.sum("k").alias("all")).join(p.groupBy("corpus").agg(F.sum("n").alias("total")), "corpus")
    x = p.join(sizes, ["corpus", "source"]).join(totals, "corpus").withColumn("expected", F.col("k") / F.col("all") * F.col("total"))
    value = F.pow(F.col("n") - F.col("expected"), F.lit(2.0)) / F.greatest("expected", F.lit(1.0))
    return x.groupBy("corpus").agg(F.sum("n").alias("hapaxes"), F.round(F.sum(value), 4).alias("chi2"), F.count("*").alias("sections"))


@analysis(oracle="""with j as (select l_returnflag as r, extract(month from l_shipdate) as c, ln(count(*)) as v from lineitem group by all)
    select r, c::int as c, round(v - avg(v) over (partition by r) - avg(v) over (partition by c) + avg(v) over (), 6) as residual from j""")
def double_centred_table(spark, sf_dir):
    """Logs of counts without row, column and grand means."""
    j = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.month("l_shipdate").alias("c")).agg(F.ln(F.count("*").cast("double")).alias("v"))
    every = Window.partitionBy(F.lit(0))  # a small table
    res = F.col("v") - F.avg("v").over(Window.partitionBy("r")) - F.avg("v").over(Window.partitionBy("c")) + F.avg("v").over(every)
    return j.select("r", "c", F.round(res, 6).alias("residual"))
