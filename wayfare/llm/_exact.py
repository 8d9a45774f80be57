"""Exact discrete distributions as SQL expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: log(n!) up to here comes from a product, beyond it from Stirling's series.
_TABLE = 24
_LOGS = [math.lgamma(n + 1) for n in range(_TABLE)]


def log_factorial(n: Column) -> Column:
    """log(n!) to about 1e-14 of its size."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    table = F.array(*map(F.lit, _LOGS))
    return F.when(n < _TABLE, F.element_at(table, (F.least(n, F.lit(_TABLE - 1)) + 1).cast("int"))).otherwise(series)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / float(1 << 53)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n * p; 1 where k is not below the mean.

    The terms are summed from k downwards; they shrink faster than geometrically, and
    the sum stops where nothing can be added any more.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    terms = F.least(k, (40 * F.sqrt(nd * p * (1 - p) + 1)).cast("bigint") + 40)
    one = F.struct(k.cast("bigint").alias("k"), n.cast("bigint").alias("n"), F.exp(log_last).alias("last"), terms.cast("bigint").alias("terms"))

    def total(x: Column) -> Column:
        start = F.struct(x["last"].alias("sum"), x["last"].alias("term"), x["k"].alias("i"))

        def step(s: Column, _: Column) -> Column:
            term = s["term"] * s["i"].cast("double") * (1 - p) / ((x["n"] - s["i"] + 1).cast("double") * p)
            return F.struct((s["sum"] + term).alias("sum"), term.alias("term"), (s["i"] - 1).alias("i"))

        places = F.when(x["terms"] > 0, F.sequence(F.lit(1).cast("bigint"), x["terms"])).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.aggregate(places, start, step, lambda s: F.least(s["sum"], F.lit(1.0)))

    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.element_at(F.transform(F.array(one), total), 1))
