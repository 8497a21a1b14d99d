"""Tests on contingency tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatica.functions.cells import significance


def chi_square_p(statistic, df):
    """Upper tail of the chi-square distribution with ``df`` degrees of freedom, for one pair of numbers."""
    if statistic is None or df is None or df < 1:
        return None
    half = statistic / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return min(1.0, total)


def chi_square(table: DataFrame, row: str, column: str = "phenotype") -> DataFrame:
    """Pearson's test of independence on counts ``n``: statistic, df, p. Levels without any count are left out.

    For even degrees of freedom the p-value is a finite sum.
    """
    t = table.where("n > 0")
    whole = Window.partitionBy()
    parts = t.groupBy(row, column).agg(F.sum("n").cast("double").alias("n")).withColumns({"r": F.sum("n").over(Window.partitionBy(row)), "c": F.sum("n").over(Window.partitionBy(column)), "total": F.sum("n").over(whole)})
    found = parts.agg((F.max("total") * (F.sum(F.col("n") * F.col("n") / F.col("r") / F.col("c")) - 1)).alias("statistic"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).cast("int").alias("df"))

    @F.pandas_udf("double")
    def p_value(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([chi_square_p(a, int(b)) if b == b and a == a else None for a, b in zip(s, d, strict=True)])

    return found.withColumn("p", p_value("statistic", "df"))


def ln_factorial(n: Column) -> Column:
    """ln n! of a whole number: exact logarithms up to 20, Stirling's series beyond (within 1e-13 of itself)."""
    small = F.array(*[F.lit(math.log(math.factorial(k))) for k in range(21)])
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.element_at(small, F.least(n, F.lit(20)).cast("int") + 1)).otherwise(series)


def fisher_pairs(table: DataFrame, row: str = "treatment", column: str = "phenotype") -> DataFrame:
    """Two-sided exact test of every level of ``column`` against the rest, for every pair of levels of ``row``.

    ``table``: counts ``n``. Returns the level, group_a < group_b, a, b (cells of the level), ra, rb (all cells), odds
    ratio of the sample, p and its stars. p adds up the tables no likelier than the observed one. Tables over 40 standard
    deviations from the mean weigh nothing in double precision and are not listed, so a test lists as many tables as the root
    of the number of cells. Log-factorials are expressions, so there is no join but that of the pairs.
    """
    sums = table.groupBy(row).agg(F.sum("n").alias("all"))
    t = table.groupBy(row, column).agg(F.sum("n").alias("n")).join(sums, row)
    a = t.select(F.col(column), F.col(row).alias("group_a"), F.col("n").alias("a"), F.col("all").alias("ra"))
    b = t.select(F.col(column).alias("_c"), F.col(row).alias("group_b"), F.col("n").alias("b"), F.col("all").alias("rb"))
    pairs = a.join(b, (F.col(column) == F.col("_c")) & (F.col("group_a") < F.col("group_b"))).drop("_c")
    k1, ra, rb = F.col("a") + F.col("b"), F.col("ra"), F.col("rb")
    whole = (ra + rb).cast("double")
    mean = ra * k1 / whole
    reach = 40 * F.sqrt(mean * rb / whole * (whole - k1) / F.greatest(whole - 1, F.lit(1.0))) + 40
    low = F.greatest(F.lit(0).cast("long"), k1 - rb, F.floor(mean - reach))
    high = F.least(ra, k1, F.ceil(mean + reach))
    log = lambda k: -(ln_factorial(k) + ln_factorial(ra - k) + ln_factorial(k1 - k) + ln_factorial(rb - k1 + k))
    key = [column, "group_a", "group_b", "a", "b", "ra", "rb"]
    k = pairs.withColumn("seen", log(F.col("a"))).withColumn("k", F.explode(F.sequence(low, high))).select(*key, "seen", log(F.col("k")).alias("lp"))
    top = F.max("lp").over(Window.partitionBy(*key))  # the common factor drops out of the ratio
    k = k.withColumns({"seen": F.col("seen") - top, "lp": F.col("lp") - top})
    p = F.coalesce(F.sum(F.when(F.col("lp") <= F.col("seen") + math.log1p(1e-7), F.exp("lp"))), F.lit(0.0)) / F.sum(F.exp("lp"))
    out = k.groupBy(*key).agg(F.least(p, F.lit(1.0)).alias("p"))
    odds = F.when((F.col("b") > 0) & (F.col("ra") > F.col("a")), F.col("a") * (F.col("rb") - F.col("b")) / (F.col("b") * (F.col("ra") - F.col("a"))))
    return out.withColumn("sample_odds_ratio", odds).withColumn("stars", significance(F.col("p")))


def conditional_odds(pairs: DataFrame, steps: int = 60) -> DataFrame:
    """``pairs`` (a of ra against b of rb) with ``odds_ratio``, the conditional maximum-likelihood estimate: the odds at which the mean of the
    noncentral hypergeometric distribution with the table's margins is a. 0 where a is the least the margins allow, infinite where
    it is the most.

    The logarithm of the odds is found by Newton steps inside a bracket that every step narrows, over an array of the tables within 12
    standard deviations (and 60) of the observed one; what lies beyond weighs nothing in double precision.
    """
    a, b, ra, rb = (F.col(c) for c in ("a", "b", "ra", "rb"))
    k1 = a + b
    low, high = F.greatest(F.lit(0), k1 - rb), F.least(ra, k1)
    inverse = sum(1 / F.greatest(c.cast("double"), F.lit(1.0)) for c in (a, ra - a, b, rb - b))
    reach = F.ceil(12 / F.sqrt(inverse)) + 60
    log = lambda k: -(ln_factorial(k) + ln_factorial(ra - k) + ln_factorial(k1 - k) + ln_factorial(rb - k1 + k))
    tables = F.transform(F.sequence(F.greatest(low, a - reach), F.least(high, a + reach)), lambda k: F.struct((k - a).cast("double").alias("k"), log(k).alias("l")))
    number = lambda v: F.lit(float(v))

    def step(t: Column, tables: Column) -> Column:
        """Mean (less a) and variance at the log-odds ``t``."""
        top = F.array_max(F.transform(tables, lambda p: p["l"] + t * p["k"]))
        start = F.struct(number(0).alias("n"), number(0).alias("x"), number(0).alias("xx"))

        def sums(m: Column) -> Column:
            weighed = F.transform(tables, lambda p: F.struct(F.exp(p["l"] + t * p["k"] - m).alias("w"), p["k"].alias("k")))
            return F.aggregate(weighed, start, lambda s, p: F.struct((s["n"] + p["w"]).alias("n"), (s["x"] + p["w"] * p["k"]).alias("x"), (s["xx"] + p["w"] * p["k"] * p["k"]).alias("xx")), lambda s: F.struct((s["x"] / s["n"]).alias("mean"), (s["xx"] / s["n"] - s["x"] / s["n"] * s["x"] / s["n"]).alias("variance")))

        return F.transform(F.array(top), sums)[0]

    def narrowed(s: Column, tables: Column) -> Column:
        def moved(m: Column) -> Column:
            lo, hi = F.when(m["mean"] > 0, s["lo"]).otherwise(s["t"]), F.when(m["mean"] > 0, s["t"]).otherwise(s["hi"])
            newton = s["t"] - m["mean"] / F.greatest(m["variance"], number(1e-300))
            return F.struct(lo.alias("lo"), hi.alias("hi"), F.when((newton >= lo) & (newton <= hi), newton).otherwise((lo + hi) / 2).alias("t"))

        return F.transform(F.array(step(s["t"], tables)), moved)[0]

    near = F.ln((a + 0.5) * (rb - b + 0.5) / ((b + 0.5) * (ra - a + 0.5)))
    begin = F.struct((near - 40).alias("lo"), (near + 40).alias("hi"), near.alias("t"))
    root = F.transform(F.array(tables), lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, lambda s, _: narrowed(s, t), lambda s: s["t"]))[0]
    return pairs.withColumn("odds_ratio", F.when(a <= low, number(0)).when(a >= high, F.lit(float("inf"))).otherwise(F.exp(root)))
