"""Agreement and test statistics over long tables of paired scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def weight(a: Column, b: Column, q: int, kind: str) -> Column:
    """Agreement of two scores on a scale of ``q``: linear, quadratic or ordinal weights."""
    d = F.abs(a - b).cast("double")
    if kind == "linear":
        return 1 - d / (q - 1)
    if kind == "quadratic":
        return 1 - d * d / ((q - 1) ** 2)
    return 1 - (d + 1) * d / (q * (q - 1))


def chance(q: int, kind: str) -> float:
    """Mean weight of all pairs of scores on a scale of ``q``."""
    one = {"linear": lambda d: 1 - d / (q - 1), "quadratic": lambda d: 1 - d * d / (q - 1) ** 2, "ordinal": lambda d: 1 - (d + 1) * d / (q * (q - 1))}[kind]
    return sum(one(abs(i - j)) for i in range(q) for j in range(q)) / q**2


def uniform_kappa(df: DataFrame, keys: list[str], a: str, b: str, q: int, kind: str) -> DataFrame:
    """n, kappa, se of each key: agreement beyond that of scores spread evenly over the scale (Brennan and Prediger)."""
    pe = chance(q, kind)
    per = df.withColumn("__k", (weight(F.col(a), F.col(b), q, kind) - pe) / (1 - pe))
    return per.groupBy(*keys).agg(F.count("__k").alias("n"), F.avg("__k").alias("kappa"), (F.stddev_samp("__k") / F.sqrt(F.count("__k"))).alias("se"))


def cohen_kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two labels by key; null where chance agreement is complete. Rows with a null label do not count.

    Counted by pair of labels first: what is joined are a few marginals per key.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    whole = cells.groupBy(*keys).agg(F.sum("__n").alias("n"), (F.sum(F.when(F.col("__a") == F.col("__b"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias("agreement"))
    left = cells.groupBy(*keys, F.col("__a").alias("__l")).agg(F.sum("__n").alias("__p"))
    right = cells.groupBy(*keys, F.col("__b").alias("__l")).agg(F.sum("__n").alias("__q"))
    by = [*keys, "__l"]
    expected = left.join(right, by).groupBy(*keys).agg(F.sum(F.col("__p").cast("double") * F.col("__q")).alias("__e")) if keys else left.join(right, by).agg(F.sum(F.col("__p").cast("double") * F.col("__q")).alias("__e"))
    out = whole.join(expected, keys, "left") if keys else whole.join(F.broadcast(expected))  # one row each
    pe = F.coalesce("__e", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return out.withColumn("kappa", F.when(pe < 1, (F.col("agreement") - pe) / (1 - pe))).drop("__e")


def wilcoxon(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """n, w, ties, z, zeros, median of the signed differences ``d`` by key; zeros do not take part in n, w and z.

    Differences are counted by value first, so ranks are taken over the few distinct ones and no key's rows are gathered.
    """
    values = df.where(F.col(d).isNotNull()).groupBy(*keys, F.col(d).cast("double").alias("__d")).agg(F.count("*").alias("__c"))
    some = values.where("__d <> 0").withColumn("__m", F.abs("__d"))
    by_size = some.groupBy(*keys, "__m").agg(F.sum("__c").alias("__t"), F.sum(F.when(F.col("__d") > 0, F.col("__c")).otherwise(0)).alias("__pos"))
    before = F.sum("__t").over(Window.partitionBy(*keys).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1))
    ranked = by_size.withColumn("__rank", F.coalesce(before, F.lit(0)) + (F.col("__t") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(
        F.sum("__t").alias("n"), F.sum(F.col("__pos") * F.col("__rank")).alias("__plus"), F.sum((F.col("__t") - F.col("__pos")) * F.col("__rank")).alias("__minus"),
        F.sum(F.col("__t") * F.col("__t") * F.col("__t") - F.col("__t")).cast("double").alias("ties"),
    )
    n = F.col("n").cast("double")
    w = F.least("__plus", "__minus")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24))
    median = values.groupBy(*keys).agg(F.expr("percentile(__d, 0.5, __c)").alias("median"), F.coalesce(F.sum(F.when(F.col("__d") == 0, F.col("__c"))), F.lit(0)).alias("zeros"))
    return sums.withColumn("w", w).withColumn("z", z).join(median, keys).select(*keys, "n", "w", "ties", "z", "zeros", "median")


#: Differences up to which the exact law of W is taken, where there are no ties and no zeros. Fixed value.
MOST_EXACT = 50


def wilcoxon_p(w: Column, n: Column, ties: Column, zeros: Column, z: Column) -> Column:
    """The two-sided probability of W: by its exact law for small samples without ties and zeros, else by the normal law of z. For the few rows of a result."""

    def tail(w, n, ties, zeros, z):
        def one(w, n, ties, zeros, z):
            if n and n <= MOST_EXACT and not ties and not zeros:
                ways = [1]
                for rank in range(1, int(n) + 1):
                    longer = ways + [0] * rank
                    for i, c in enumerate(ways):
                        longer[i + rank] += c
                    ways = longer
                return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2 ** int(n))
            return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))

        return type(w)([one(*x) for x in zip(w, n, ties, zeros, z)])

    return F.pandas_udf(tail, DoubleType())(w, n, ties, zeros, z)


def two_sided(z: Column) -> Column:
    """The two-sided normal probability of each z. For the few rows of a result: Spark has no error function."""

    def tail(values):
        return values.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))

    return F.pandas_udf(tail, "double")(z)


def beta_part(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by continued fractions."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def t_tail(t: float, df: float) -> float:
    """The two-sided probability of Student's t."""
    return beta_part(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    """The probability of an F as large or larger."""
    return beta_part(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection over its distribution."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def t_half_width(n: Column, se: Column, level: float = 0.95) -> Column:
    """Half of the t interval of a mean of ``n`` values; null for fewer than two. For the few rows of a result."""

    def half(n, se):
        return type(se)([t_quantile((1 + level) / 2, int(k) - 1) * s if k and k > 1 and s is not None and not math.isnan(s) else None for k, s in zip(n, se)])

    return F.pandas_udf(half, DoubleType())(n, se)


def t_probability(t: Column, n: Column) -> Column:
    """The two-sided probability of ``t`` with ``n`` - 1 degrees of freedom. For the few rows of a result."""

    def tail(t, n):
        return type(t)([None if x is None or math.isnan(x) or not k or k < 2 else t_tail(x, k - 1) for x, k in zip(t, n)])

    return F.pandas_udf(tail, DoubleType())(t, n)


def bootstrap_mean(df: DataFrame, keys: list[str], cluster: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """mean, low, high of each key: a 95 % interval from resampling whole clusters with replacement.

    Sums by cluster are made first. A task gets one row per cluster of its key.
    """
    sums = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    kinds = dict(df.dtypes)

    def one(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(cluster)
        s, c = pdf["__s"].to_numpy(float), pdf["__c"].to_numpy(float)
        random = np.random.default_rng(seed)
        means = []
        for _ in range(rounds):
            i = random.integers(0, len(s), len(s))
            means.append(s[i].sum() / c[i].sum())
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([[*key, s.sum() / c.sum(), low, high]], columns=[*keys, "mean", "low", "high"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", mean double, low double, high double"
    return sums.groupBy(*keys).applyInPandas(one, schema)


def icc(df: DataFrame, subject: str, rater: str, score: str) -> DataFrame:
    """n_subjects, n_raters, icc: two-way agreement of single ratings, over subjects that every rater rated once. Means are taken by aggregates only."""
    n_raters = df.select(rater).distinct().count()
    per = df.groupBy(subject, rater).agg(F.avg(score).alias("x"))
    whole = per.groupBy(subject).agg(F.count("*").alias("c"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q")).where(F.col("c") == n_raters)
    by_subject = whole.agg(F.count("*").alias("n"), F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("smm"), F.sum("q").alias("q")).first()
    raters = per.join(whole.select(subject), subject, "left_semi").groupBy(rater).agg(F.avg("x").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("rmm")).first()
    n, k = by_subject.n, n_raters
    value = None
    if n > 1 and k > 1:
        grand = by_subject.sm / n
        ss_s, ss_r = k * (by_subject.smm - n * grand**2), n * (raters.rmm - k * grand**2)
        ss_e = by_subject.q - n * k * grand**2 - ss_s - ss_r
        ms_s, ms_r, ms_e = ss_s / (n - 1), ss_r / (k - 1), ss_e / ((n - 1) * (k - 1))
        value = (ms_s - ms_e) / (ms_s + (k - 1) * ms_e + k * (ms_r - ms_e) / n)
    return df.sparkSession.createDataFrame([(n, k, value)], "n_subjects long, n_raters long, icc double")


def icc_pairs(df: DataFrame, subject: str, rater: str, score: str) -> DataFrame:
    """left_rater, right_rater, n and the six intraclass correlations (icc1, icc2, icc3 of single ratings, icc1k, icc2k, icc3k of their means) of every two raters.

    They are taken over the subjects that both rated; a rater's several scores of a subject count by their mean. Null where they are undefined. A subject makes
    no more pairs than there are pairs of raters.
    """
    per = df.groupBy(F.col(subject).alias("s"), F.col(rater).alias("r")).agg(F.avg(score).alias("v")).where("s IS NOT NULL AND r IS NOT NULL AND v IS NOT NULL")
    both = per.select("s", F.col("r").alias("left_rater"), F.col("v").alias("x")).join(per.select("s", F.col("r").alias("right_rater"), F.col("v").alias("y")), "s").where("left_rater < right_rater")
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("left_rater", "right_rater").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x + y * y).alias("sq"), F.sum((x + y) * (x + y)).alias("sp"))
    n, k = F.col("n"), 2
    base = (F.col("sx") + F.col("sy")) * (F.col("sx") + F.col("sy")) / (k * n)
    of_subjects, of_raters, whole = F.col("sp") / k - base, (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / n - base, F.col("sq") - base
    told = sums.select(
        "left_rater", "right_rater", "n", F.try_divide(of_subjects, n - 1).alias("r"), of_raters.alias("c"), F.try_divide(whole - of_subjects - of_raters, n - 1).alias("e"), ((whole - of_subjects) / n).alias("w")
    )
    r, c, e, w = (F.col(f) for f in "rcew")
    return told.select(
        "left_rater", "right_rater", "n", F.try_divide(r - w, r + w).alias("icc1"), F.try_divide(r - e, r + e + k * (c - e) / n).alias("icc2"), F.try_divide(r - e, r + e).alias("icc3"),
        F.try_divide(r - w, r).alias("icc1k"), F.try_divide(r - e, r + (c - e) / n).alias("icc2k"), F.try_divide(r - e, r).alias("icc3k"),
    )


def shapiro(values) -> tuple[float, float]:
    """W and its p of up to 5000 values, by Royston's approximation."""
    import numpy as np

    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([_normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    a = c.copy()
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    elif n > 3:
        a = m / math.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    else:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(g - math.log(1 - w))
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, ln = math.log(1 - w), math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return float(w), 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def shapiro_counts(values, counts) -> tuple[float, float | None]:
    """W and its p of a frequency table. W is that of all values; p is None beyond 5000 of them, where Royston's approximation does not hold.

    The normal scores are summed over each value's ranks, a million at a time, so the memory does not depend on the counts.
    """
    import numpy as np

    order = np.argsort(values)
    x, c = np.asarray(values, dtype=float)[order], np.asarray(counts, dtype=np.int64)[order]
    ends = np.cumsum(c)
    n = int(ends[-1])
    if n <= 5000:
        return shapiro(np.repeat(x, c))
    if len(x) == 1:
        return float("nan"), None
    scores, squares = np.zeros(len(x)), 0.0
    for first in range(1, n + 1, 1_000_000):
        rank = np.arange(first, min(first + 1_000_000, n + 1))
        m = _normal_quantiles((rank - 0.375) / (n + 0.25))
        scores += np.bincount(np.searchsorted(ends, rank), weights=m, minlength=len(x))
        squares += m @ m
    top = np.array([_normal_quantile((i - 0.375) / (n + 0.25)) for i in (n, n - 1)])
    u = 1 / math.sqrt(n)
    # The two largest and the two smallest values have weights of their own, as in shapiro.
    ends_of = np.array([np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, top[0] / math.sqrt(squares)], u), np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, top[1] / math.sqrt(squares)], u)])
    phi = (squares - 2 * (top @ top)) / (1 - 2 * (ends_of @ ends_of))
    at = lambda *ranks: x[np.searchsorted(ends, ranks)]
    inner = x @ scores / math.sqrt(phi) + (ends_of - top / math.sqrt(phi)) @ (at(n, n - 1) - at(1, 2))
    return float(inner**2 / (c @ (x - c @ x / n) ** 2)), None


def _normal_quantiles(p):
    """Quantiles of the standard normal distribution over an array, by the formulas of ``statistics.NormalDist`` (Wichura's AS 241)."""
    import numpy as np

    q = p - 0.5
    r = 0.180625 - q * q
    middle = q * np.polyval([2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0], r)
    middle /= np.polyval([5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0], r)
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    near = np.polyval([7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0], r - 1.6)
    near /= np.polyval([1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0], r - 1.6)
    far = np.polyval([2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0], r - 5)
    far /= np.polyval([2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0], r - 5)
    return np.where(np.abs(q) <= 0.425, middle, np.copysign(np.where(r <= 5, near, far), q))


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def bootstrap_gap(df: DataFrame, keys: list[str], cluster: str, side: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """gap, low, high of each key: the mean where ``side`` is true less the mean where it is false, clusters resampled for both at once."""
    sums = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull() & F.col(side).isNotNull()).groupBy(*keys, cluster).agg(
        *(x for s, c in (("t", F.col(side)), ("f", ~F.col(side))) for x in (F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0)).cast("double").alias(f"__s{s}"), F.count(F.when(c, F.col(value))).alias(f"__c{s}")))
    )
    kinds = dict(df.dtypes)

    def one(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(cluster)
        x = pdf[["__st", "__ct", "__sf", "__cf"]].to_numpy(float)
        random = np.random.default_rng(seed)
        gap = lambda s: s[0] / s[1] - s[2] / s[3] if s[1] and s[3] else np.nan
        gaps = [gap(x[random.integers(0, len(x), len(x))].sum(0)) for _ in range(rounds)]
        low, high = np.nanpercentile(gaps, [2.5, 97.5]) if not np.all(np.isnan(gaps)) else (None, None)
        return pd.DataFrame([[*key, gap(x.sum(0)), low, high]], columns=[*keys, "gap", "low", "high"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", gap double, low double, high double"
    return sums.groupBy(*keys).applyInPandas(one, schema)


def manova(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """n, groups, wilks, pillai, f (of wilks), p of a one-way comparison of several scores at once, from sums of products by group; rows with a null take no part."""
    import numpy as np

    whole = df.where(F.col(group).isNotNull()).dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.count("*").cast("double").alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)), *(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias(f"q{i}_{j}") for i, j in pairs)]
    # One row of sums per group.
    rows = whole.groupBy(group).agg(*sums).collect()
    n, wilks, pillai = sum(r["n"] for r in rows), None, None
    if len(rows) > 1 and n > len(rows) + len(columns):
        k = len(columns)
        total, mean_sum = np.zeros((k, k)), np.zeros((k, k))
        s_all = np.zeros(k)
        for r in rows:
            s = np.array([r[f"s{i}"] for i in range(k)])
            for i, j in pairs:
                total[i, j] += r[f"q{i}_{j}"]
            mean_sum += np.outer(s, s) / r["n"]
            s_all += s
        total = np.triu(total) + np.triu(total, 1).T
        within, between = total - mean_sum, mean_sum - np.outer(s_all, s_all) / n
        wilks = float(np.linalg.det(within) / np.linalg.det(within + between))
        pillai = float(np.trace(between @ np.linalg.inv(within + between)))
    f = p = None
    if wilks is not None and wilks > 0:
        # Rao's F; for two groups it is exact.
        k, q = len(columns), len(rows) - 1
        t = math.sqrt((k * k * q * q - 4) / (k * k + q * q - 5)) if k * k + q * q > 5 else 1.0
        d1, d2 = k * q, t * (n - 1 - (k + q + 1) / 2) - k * q / 2 + 1
        f = (1 - wilks ** (1 / t)) / wilks ** (1 / t) * d2 / d1
        p = f_tail(f, d1, d2)
    return df.sparkSession.createDataFrame([(int(n), len(rows), wilks, pillai, f, p)], "n long, groups long, wilks double, pillai double, f double, p double")
