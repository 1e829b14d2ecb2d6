"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: Abramowitz and Stegun 7.1.26, error function polynomial
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
NORMAL_FROM_DF = 30
# fixed values: two-sided normal quantiles
Z_BY_LEVEL = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
# fixed values: Lanczos coefficients for g = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: str | Column, places: int) -> Column:
    """Round with halves going up, also below zero."""
    scale = float(10**places)
    return F.floor(_c(x) * scale + 0.5) / scale


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / (2.0**0.5)))


def log_gamma(x: Column) -> Column:
    """Lanczos approximation for x > 0.5."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, a in enumerate(LANCZOS[1:], start=1):
        total = total + F.lit(a) / (z + float(i))
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.log(t) - t + F.log(total)


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta by its power series (x < 1)."""
    front = F.exp(a * F.log(x) + b * F.log(1.0 - x) - (log_gamma(a) + log_gamma(b) - log_gamma(a + b)) - F.log(a))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, k: F.struct(
            (acc["t"] * x * (a + b + (k.cast("double") - 1.0)) / (a + k.cast("double"))).alias("t"),
            (acc["s"] + acc["t"] * x * (a + b + (k.cast("double") - 1.0)) / (a + k.cast("double"))).alias("s"),
        ),
    )
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(front * series["s"])


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > t): normal tail from 30 degrees of freedom on, incomplete beta below.

    The series converges fastest below x = 1/2, so the symmetric form serves the other half.
    """
    x = F.try_divide(df, df + t * t)
    a, b = df / 2.0, F.lit(0.5)
    small = F.when(x < 0.5, incomplete_beta(x, a, b)).otherwise(1.0 - incomplete_beta(1.0 - x, b, a))
    return F.when(df >= NORMAL_FROM_DF, 2.0 * (1.0 - normal_cdf(F.abs(t)))).otherwise(small)


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation; 1 where r is undefined (reported as 0), 0 for a perfect one."""
    df = (n - 2).cast("double")
    t = r * F.sqrt(F.try_divide(df, 1.0 - r * r))
    p = t_two_sided(t, df)
    return F.when((n < 3) | (r == 0), F.lit(1.0)).when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def z_for(level: float) -> float:
    if level not in Z_BY_LEVEL:
        raise ValueError(f"confidence level {level} is not one of {sorted(Z_BY_LEVEL)}")
    return Z_BY_LEVEL[level]
