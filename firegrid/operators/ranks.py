"""Rank statistics: the sums in Spark, tails of distributions on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.operators.prefix import running_sums


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Average ranks with ties. Ranks come from running counts of distinct values."""
    each = running_sums(df.groupBy(*by, value).agg(F.count("*").alias("t")), by, value, {"upto": "t"})
    return df.join(each.withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2).drop("upto"), [*by, value])


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, H (tie-corrected) and degrees of freedom."""
    ranked = average_ranks(df.select(group, value, F.lit(1).alias("one")), value, ["one"])
    sums = ranked.groupBy(group).agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), (F.count("*") - 1).alias("df"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return total.crossJoin(ties).select("n", h.alias("h"), "df")  # one row each


def _by_pairs(counts: DataFrame, group: str) -> DataFrame:
    """counts once for each pair a < b of groups that its own group is in: an equi-join on the group."""
    names = counts.select(group).distinct()  # as many rows as groups
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    return counts.join(pairs.select("a", "b", F.explode(F.array("a", "b")).alias(group)), group)


def pair_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Cliff's delta and the largest distance of distribution functions for each pair of groups a < b."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("t"))
    both = _by_pairs(counts, group).groupBy("a", "b", value).agg(
        F.sum(F.when(F.col(group) == F.col("a"), F.col("t")).otherwise(0)).alias("ta"), F.sum(F.when(F.col(group) == F.col("b"), F.col("t")).otherwise(0)).alias("tb")
    )
    x = running_sums(both, ["a", "b"], value, {"ca": "ta", "cb": "tb"})
    x = x.join(both.groupBy("a", "b").agg(F.sum("ta").alias("na"), F.sum("tb").alias("nb")), ["a", "b"])  # a row a pair
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    u = F.col("ta").cast("double") * (2 * F.col("cb") - F.col("tb")) / 2
    return x.groupBy("a", "b", "na", "nb").agg(F.sum(u).alias("u"), F.max(gap).alias("ks")).select("a", "b", (2 * F.col("u") / (F.col("na") * F.col("nb")) - 1).alias("cliff_delta"), "ks")


def dunn(df: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, z (tie-corrected) and two-sided p for each pair of groups a < b, unadjusted."""
    ranked = average_ranks(df.select(group, value, F.lit(1).alias("one")), value, ["one"])
    means = ranked.groupBy(group).agg(F.avg("rank").alias("m"), F.count("*").cast("double").alias("n"))  # a row a group
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("t").alias("all"))
    a, b = means.toDF("a", "ma", "na"), means.toDF("b", "mb", "nb")
    n = F.col("all")
    spread = n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))
    z = (F.col("ma") - F.col("mb")) / F.sqrt(spread * (1 / F.col("na") + 1 / F.col("nb")))
    tails = F.pandas_udf(lambda zs: zs.map(normal_tail, na_action="ignore"), "double")  # Spark has no normal tail; k^2 rows
    return a.join(b, F.col("a") < F.col("b")).crossJoin(ties).select("a", "b", z.alias("z")).withColumn("p", tails("z"))  # ties: one row


def rank_sum(df: DataFrame, group: str, value: str, min_n: int = 10) -> DataFrame:
    """Two-sided rank-sum test of each pair of groups a < b: z with continuity and tie correction, and p; the share of the
    pooled values apart (ks) and its asymptotic p. Values that are no finite number count for nothing; z and both p are
    null where a group has fewer than min_n values."""
    df = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    counts = df.groupBy(group, value).agg(F.count("*").cast("double").alias("t"))
    both = _by_pairs(counts, group).groupBy("a", "b", value).agg(F.sum("t").alias("t"))
    sizes = counts.groupBy(group).agg(F.sum("t").alias("n"))
    ties = both.groupBy("a", "b").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    x = pair_statistics(df, group, value).join(ties, ["a", "b"]).join(sizes.toDF("a", "n1"), "a").join(sizes.toDF("b", "n2"), "b")
    n, prod = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    off = F.col("cliff_delta") * prod / 2
    sigma = F.sqrt(prod / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(off - F.signum(off) * 0.5, sigma)
    tails = F.pandas_udf(lambda zs: zs.map(normal_tail, na_action="ignore"), "double")
    enough = F.least("n1", "n2") >= min_n
    apart = F.pandas_udf(lambda x: x.map(kolmogorov_tail, na_action="ignore"), "double")  # k^2 rows
    return x.select(
        "a", "b", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.when(enough, z).alias("z"), "cliff_delta", "ks", F.when(enough, F.col("ks") * F.sqrt(prod / n)).alias("scaled")
    ).withColumns({"p": tails("z"), "ks_p": apart("scaled")}).drop("scaled")


def holm(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    w = Window.partitionBy(*family)
    order = w.orderBy(p)
    step = F.least(F.lit(1.0), (F.count(p).over(w) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("s", step).withColumn("adjusted", F.max("s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("s")


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_tail(x: float) -> float:
    """Upper tail of the limit of the scaled largest distance."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def bonferroni(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    w = Window.partitionBy(*family)
    return df.withColumn("adjusted", F.least(F.lit(1.0), F.count(p).over(w) * F.col(p)))


def dunn_if_apart(df: DataFrame, group: str, value: str, alpha: float = 0.05, adjust=bonferroni) -> DataFrame:
    """Dunn's test with adjusted p, if the groups differ at all at alpha; else no row."""
    whole = kruskal(df, group, value).first()
    z = dunn(df, group, value)
    if whole.h is None or whole.df < 1 or chi2_tail(whole.h, whole.df) >= alpha:
        z = z.limit(0)
    return adjust(z.withColumn("family__", F.lit(1)), "p", ["family__"]).drop("family__")


def kruskal_by(df: DataFrame, panel: str, group: str, value: str) -> DataFrame:
    """panel, n, h, df and p for each panel with two groups and more: one plan for all panels."""
    each = running_sums(df.groupBy(panel, value).agg(F.count("*").alias("t")), [panel], value, {"upto": "t"})
    ranked = df.select(panel, group, value).join(each.withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2), [panel, value])
    sums = ranked.groupBy(panel, group).agg(F.sum("rank").alias("s"), F.count("*").alias("k"))
    total = sums.groupBy(panel).agg(F.sum("k").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), (F.count("*") - 1).alias("df")).where("df >= 1")
    t = F.col("t").cast("double")
    ties = each.groupBy(panel).agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    tail = F.pandas_udf(lambda h, k: (h.combine(k, lambda x, d: None if x != x else chi2_tail(x, int(d)))).astype("float64"), "double")  # a row a panel
    return total.join(ties, panel).select(panel, "n", h.alias("h"), "df").withColumn("p", tail("h", "df"))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail by the series of the lower regularized incomplete gamma function, or its continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def letters(groups: list[str], differ: set[frozenset[str]]) -> dict[str, str]:
    """Compact letters: groups share a letter if no pair of them differs (insert and absorb)."""
    columns = [set(groups)]
    for pair in sorted(map(sorted, differ)):
        for col in [c for c in columns if set(pair) <= c]:
            columns.remove(col)
            columns += [col - {pair[0]}, col - {pair[1]}]
        columns = [c for i, c in enumerate(columns) if not any(c < d or (c == d and j < i) for j, d in enumerate(columns))]
    columns.sort(key=lambda c: min(groups.index(g) for g in c) if c else 0)
    return {g: "".join(chr(97 + k) for k, c in enumerate(columns) if g in c) or "a" for g in groups}
