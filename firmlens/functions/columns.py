"""Column expressions with R-like missing-value semantics (NULL and NaN are both missing)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: str | Column) -> Column:
    c = as_col(c)
    return c.isNull() | F.isnan(c)


def finite(c: str | Column) -> Column:
    """TRUE only for ordinary numbers; never NULL."""
    c = as_col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def all_present(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & ~missing(c)
    return out


def to_double(c: str | Column) -> Column:
    """Tolerant coercion: text that is no number becomes NULL."""
    return as_col(c).try_cast("double")


def join_key(c: str | Column) -> Column:
    """Trimmed text key; the empty text is missing."""
    return F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))


def zero_missing(c: str | Column) -> Column:
    return F.nullif(as_col(c), F.lit(0.0))


def safe_div(num: str | Column, den: str | Column) -> Column:
    num, den = as_col(num), as_col(den)
    return F.when(finite(num) & finite(den) & (den != 0), num / den)


def negative_flag(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(~missing(c), (c < 0).cast("int"))


def clamp(c: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """Clamp keeping NULL; ``least``/``greatest`` alone would turn NULL into a bound."""
    c = as_col(c)
    return F.when(~missing(c), F.least(F.greatest(c, as_col(lo)), as_col(hi)))


def parse_flag(c: str | Column) -> Column:
    """Tolerant three-valued flag parse."""
    s = F.upper(F.trim(as_col(c).cast("string")))
    return (
        F.when(s.isin("TRUE", "T", "1", "YES"), F.lit(True))
        .when(s.isin("FALSE", "F", "0", "NO"), F.lit(False))
    )


def precision_weight(sd: str | Column, eps: float) -> Column:
    sd = as_col(sd)
    w = F.lit(1.0) / F.greatest(sd * sd, F.lit(eps))
    return F.when(finite(sd) & finite(w) & (w > 0), w)


def normal_log_density(y, mu, sd) -> Column:
    """log N(y; mu, sd)."""
    y, mu = as_col(y), as_col(mu)
    s = F.greatest(as_col(sd), F.lit(2.220446049250313e-16))
    u = (y - mu) / s
    return F.lit(-0.5 * math.log(2 * math.pi)) - F.log(s) - u * u / 2


# Coefficients of the g = 7, n = 9 Lanczos series for the gamma function.
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def lgamma(x: str | Column) -> Column:
    """log Gamma(x) for x >= 0.5 as a plain column expression."""
    z = as_col(x) - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def student_log_density(y, eta, sigma, nu) -> Column:
    """log density of a located and scaled Student t."""
    y, eta, sigma, nu = map(as_col, (y, eta, sigma, nu))
    u = (y - eta) / sigma
    return (
        lgamma((nu + 1) / 2) - lgamma(nu / 2)
        - F.lit(0.5) * F.log(nu * math.pi) - F.log(sigma)
        - (nu + 1) / 2 * F.log1p(u * u / nu)
    )


def order_hash(*parts) -> Column:
    """Deterministic replacement for a random draw: md5 of seed, context and key."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded report value; ``+ 0.0`` removes negative zero."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)


def correlation(a: str | Column, b: str | Column) -> Column:
    """Aggregate Pearson correlation of two jointly present columns; NULL when either is constant.

    The built-in ``corr`` raises on a constant column under ANSI arithmetic.
    """
    sa, sb = F.stddev_samp(a), F.stddev_samp(b)
    return F.when((sa > 0) & (sb > 0), F.covar_samp(a, b) / (sa * sb))
