"""Statistics of counted tables. Every function keeps its groups: one job serves any number of corpora."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freq(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """(by, values, n): how often each combination of values occurs."""
    return df.groupBy(*by, *values).agg(F.count("*").alias("n"))


def plogp(n: str | Column = "n") -> Column:
    """Entropy in bits of a column of counts, as an aggregate: log2 N - sum(n log2 n) / N; 0 for none."""
    c = (F.col(n) if isinstance(n, str) else n).cast("double")
    total = F.sum(c)
    h = F.log2(total) - F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / total
    return F.coalesce(F.when(total > 0, F.greatest(h, F.lit(0.0))), F.lit(0.0))


def entropy(counts: DataFrame, by: Sequence[str], out: str = "entropy") -> DataFrame:
    return counts.groupBy(*by).agg(plogp().alias(out))


def _merged(counts: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return counts.groupBy(*by, x).agg(F.sum("n").alias("n"))


def conditional_entropy(joint: DataFrame, by: Sequence[str], given: str, out: str = "h_cond") -> DataFrame:
    """H(y | given) = H(joint) - H(given), for a table of (by, given, y, n)."""
    # the margin's n log n by a second aggregation over the same grouped rows
    margin = _merged(joint, by, given).groupBy(*by).agg(plogp().alias("h_given"))
    whole = joint.groupBy(*by).agg(plogp().alias("h_joint"))
    return whole.join(margin, list(by)).select(*by, F.greatest(F.col("h_joint") - F.col("h_given"), F.lit(0.0)).alias(out)) if by else (
        whole.crossJoin(margin).select(F.greatest(F.col("h_joint") - F.col("h_given"), F.lit(0.0)).alias(out))
    )


def with_margins(joint: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """The joint table with nx, ny and total: row, column and whole sums of its group."""
    sums = {"nx": [*by, x], "ny": [*by, y], "total": list(by)}
    out = joint
    for name, cols in sums.items():
        w = Window.partitionBy(*cols) if cols else Window.partitionBy(F.lit(0))
        out = out.withColumn(name, F.sum("n").over(w).cast("double"))
    return out.withColumn("n", F.col("n").cast("double"))


def mutual_information(joint: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, mi, h_x, h_y, normalized): I(x; y) in bits and by the smaller entropy; all 0 where nothing is counted."""
    parts = joint.groupBy(*by).agg(plogp().alias("h_xy"))
    hx = _merged(joint, by, x).groupBy(*by).agg(plogp().alias("h_x"))
    hy = _merged(joint, by, y).groupBy(*by).agg(plogp().alias("h_y"))
    if by:
        all_ = parts.join(hx, list(by)).join(hy, list(by))
    else:  # one row each
        all_ = parts.crossJoin(hx).crossJoin(hy)
    mi = F.greatest(F.col("h_x") + F.col("h_y") - F.col("h_xy"), F.lit(0.0))
    low = F.least("h_x", "h_y")
    return all_.select(*by, mi.alias("mi"), "h_x", "h_y", F.when(low > 0, mi / low).otherwise(0.0).alias("normalized"))


def conditional_mutual_information(joint: DataFrame, by: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """(by, cmi): I(x; y | z), each z weighted by its share."""
    inner = mutual_information(joint, [*by, z], x, y).select(*by, z, "mi")
    sizes = joint.groupBy(*by, z).agg(F.sum("n").alias("n"))
    both = inner.join(sizes, [*by, z])
    return both.groupBy(*by).agg((F.sum(F.col("mi") * F.col("n")) / F.sum("n")).alias("cmi"))


def uncertainty(joint: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, u): the share of H(y) that x takes away; 0 where H(y) is 0."""
    m = mutual_information(joint, by, x, y)
    return m.select(*by, F.when(F.col("h_y") > 0, F.col("mi") / F.col("h_y")).otherwise(0.0).alias("u"))


def chi2(joint: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, chi2, total, rows, cols): of independence, from the cells that occur: N (sum n² / (r c) - 1)."""
    m = with_margins(joint, by, x, y)
    value = F.max("total") * (F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))) - 1)
    return m.groupBy(*by).agg(
        value.alias("chi2"), F.max("total").alias("total"), F.count_distinct(x).alias("rows"), F.count_distinct(y).alias("cols")
    )


def cramers_v(joint: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, v): 0 where either side has fewer than two categories."""
    c = chi2(joint, by, x, y)
    k = F.least("rows", "cols") - 1
    v = F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("total") * F.greatest(k, F.lit(1))))
    return c.select(*by, F.when(k > 0, v).otherwise(0.0).alias("v"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution by a rational approximation of erfc (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # The coefficients of the published Chebyshev fit.
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + c
    erfc = t * F.exp(-x * x + poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def chi2_fit(observed: DataFrame, by: Sequence[str], expected: str = "expected") -> DataFrame:
    """(by, chi2, df, p): goodness of fit over cells expected at least once; p by Wilson and Hilferty's cube root."""
    ok = observed.where(F.col(expected) >= 1)
    out = ok.groupBy(*by).agg(
        F.sum(F.pow(F.col("n") - F.col(expected), F.lit(2.0)) / F.col(expected)).alias("chi2"), (F.count("*") - 1).alias("df")
    )
    k = F.greatest(F.col("df"), F.lit(1)).cast("double")
    z = (F.pow(F.col("chi2") / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    return out.withColumn("p", F.when(F.col("df") > 0, normal_tail(z)).otherwise(1.0))


def sides(left: DataFrame, right: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, a, b): counts of two populations by value, 0 where one lacks it; one shuffle for both."""
    both = left.select(*by, value, F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        right.select(*by, value, F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    )
    return both.groupBy(*by, value).agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))


def shares(two: DataFrame, by: Sequence[str]) -> DataFrame:
    """sides() with p and q, the shares of each population; an empty one has shares of 0."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))

    def share(c: str) -> Column:
        total = F.sum(c).over(w)
        return F.when(total > 0, F.col(c) / total).otherwise(0.0)

    return two.withColumn("p", share("a")).withColumn("q", share("b"))


def _half(p: str, m: Column) -> Column:
    return F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / m)).otherwise(0.0)


def jsd(two: DataFrame, by: Sequence[str], out: str = "jsd", distance: bool = False) -> DataFrame:
    """(by, jsd): Jensen-Shannon divergence in bits of sides(), or its root, the distance."""
    s = shares(two, by)
    m = (F.col("p") + F.col("q")) / 2
    d = F.greatest(F.sum((_half("p", m) + _half("q", m)) / 2), F.lit(0.0))
    return s.groupBy(*by).agg((F.sqrt(d) if distance else d).alias(out))


def kl(two: DataFrame, by: Sequence[str], floor: float = 1e-10, out: str = "kl") -> DataFrame:
    """(by, kl): of the first population from the second, whose shares are at least `floor`."""
    s = shares(two, by)
    return s.groupBy(*by).agg(F.sum(_half("p", F.greatest(F.col("q"), F.lit(floor)))).alias(out))


def log_odds(two: DataFrame, by: Sequence[str], prior: float = 0.5) -> DataFrame:
    """sides() with log_odds of the two populations for each value, `prior` added to every count."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    a, b = F.col("a") + prior, F.col("b") + prior
    ta, tb = F.sum("a").over(w) - F.col("a") + prior, F.sum("b").over(w) - F.col("b") + prior
    return two.withColumn("log_odds", F.ln(a / ta) - F.ln(b / tb))


def concentration(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, hhi): sum of squared shares."""
    n = F.col("n").cast("double")
    return counts.groupBy(*by).agg((F.sum(n * n) / F.pow(F.sum(n), F.lit(2.0))).alias("hhi"))


def coincidence(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ic): the chance that two draws without putting back are equal; 0 for fewer than two."""
    n, total = F.col("n").cast("double"), F.sum(F.col("n").cast("double"))
    return counts.groupBy(*by).agg(F.when(total >= 2, F.sum(n * (n - 1)) / (total * (total - 1))).otherwise(0.0).alias("ic"))


def zipf(counts: DataFrame, by: Sequence[str], top: int = 500, least: int = 10, base10: bool = False) -> DataFrame:
    """(by, alpha): minus the slope of log frequency on log rank over the `top` most frequent; 0 for fewer than `least`."""
    log = F.log10 if base10 else F.ln
    w = Window.partitionBy(*by).orderBy(F.desc("n"))
    ranked = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    slope = F.regr_slope(log(F.col("n").cast("double")), log(F.col("r").cast("double")))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= least, -slope).otherwise(0.0).alias("alpha"))


def first_seen(tokens: DataFrame, by: Sequence[str], value: str = "word") -> DataFrame:
    """(by, value, first, n): each type's first place and count."""
    return tokens.groupBy(*by, value).agg(F.min("ord").alias("first"), F.count("*").alias("n"))


def heaps(types: DataFrame, by: Sequence[str], points: int = 20, start: int = 100, least: int = 200) -> DataFrame:
    """(by, beta): slope of log types on log tokens at `points` evenly spaced sizes; null for fewer than `least` tokens.

    A type is in the first p tokens if its first place is below p, so types fall into the interval between two points
    and the counts add up over the 20 intervals: no running set, no row per token.
    """
    sizes = types.groupBy(*by).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    at = sizes.withColumn(
        "points",
        F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)),
            lambda i: F.floor(F.lit(float(start)) + i * ((F.col("total") - start) / (points - 1)) + 1e-9).cast("long"),
        ),
    )
    placed = types.join(at, list(by)).select(
        *by, "points", F.size(F.filter("points", lambda p: p <= F.col("first"))).alias("slot")
    )
    slots = placed.groupBy(*by, "points", "slot").agg(F.count("*").alias("new"))
    w = Window.partitionBy(*by).orderBy("slot")
    seen = slots.withColumn("seen", F.sum("new").over(w))
    # a slot without new types has no row: each point takes the last row before it
    per = seen.groupBy(*by, "points").agg(F.array_sort(F.collect_list(F.struct("slot", "seen"))).alias("s"))
    exploded = per.select(*by, "s", F.posexplode("points").alias("i", "p"))
    known = F.array_max(F.transform(F.filter("s", lambda x: x["slot"] <= F.col("i")), lambda x: x["seen"]))
    curve = exploded.select(*by, "p", known.alias("v"))
    return curve.groupBy(*by).agg(F.regr_slope(F.ln(F.col("v").cast("double")), F.ln(F.col("p").cast("double"))).alias("beta"))


def guarded_corr(x: str, y: str, least: int = 3) -> Column:
    """Pearson's r as an aggregate; 0 for fewer than `least` rows or a side without variance."""
    varied = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    cov, sx, sy = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    return F.when(varied & (F.count("*") >= least), cov / F.nullif(sx * sy, F.lit(0.0))).otherwise(0.0)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, ties: Sequence[str]) -> DataFrame:
    """(by, rho): Pearson's r of ordinal ranks, equal values ranked by `ties`."""
    a = df.withColumn("rx", F.row_number().over(Window.partitionBy(*by).orderBy(x, *ties)).cast("double"))
    b = a.withColumn("ry", F.row_number().over(Window.partitionBy(*by).orderBy(y, *ties)).cast("double"))
    return b.groupBy(*by).agg(guarded_corr("rx", "ry").alias("rho"))


def partial_corr(df: DataFrame, by: Sequence[str], x: str, y: str, control: str) -> DataFrame:
    """(by, r): of x and y with each class of `control` centred on its own means."""
    w = Window.partitionBy(*by, control)
    c = df.withColumn("cx", F.col(x) - F.avg(x).over(w)).withColumn("cy", F.col(y) - F.avg(y).over(w))
    return c.groupBy(*by).agg(guarded_corr("cx", "cy").alias("r"))


def cohens_d(value: str, first: Column) -> Column:
    """Difference of means by the pooled standard deviation, as an aggregate; `first` marks one population's rows."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / F.nullif(na + nb - 2, F.lit(0)))
    return F.when(pooled > 0, (F.avg(a) - F.avg(b)) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)


def best_threshold(df: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """(by, threshold, accuracy): the cut between two distinct values that parts label 1 from 0 best, either way round.

    Counts per distinct value come first, so the running sums are over distinct values.
    """
    per = df.groupBy(*by, F.col(value).alias("v")).agg(
        F.sum(F.col(label).cast("long")).alias("ones"), F.count("*").alias("n")
    )
    w = Window.partitionBy(*by).orderBy("v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    run = per.select(
        *by, "v", F.lead("v").over(w).alias("next"), F.sum("ones").over(upto).alias("l1"), F.sum("n").over(upto).alias("ln"),
        F.sum("ones").over(whole).alias("t1"), F.sum("n").over(whole).alias("tn"),
    )
    right = (F.col("ln") - F.col("l1")) + (F.col("t1") - F.col("l1"))
    acc = F.greatest(right, F.col("tn") - right) / F.col("tn")
    cuts = run.where("next is not null").select(*by, ((F.col("v") + F.col("next")) / 2).alias("threshold"), acc.alias("accuracy"))
    best = cuts.groupBy(*by).agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "threshold", "accuracy")).alias("b"))
    return best.select(*by, "b.threshold", "b.accuracy")


def burstiness(mean: Column, std: Column) -> Column:
    """(sd - mean) / (sd + mean) of gaps; 0 where both are."""
    return F.when(std + mean > 0, (std - mean) / F.nullif(std + mean, F.lit(0.0))).otherwise(0.0)
