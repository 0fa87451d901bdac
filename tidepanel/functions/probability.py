"""Normal and Student-t probabilities as SQL expressions.

Spark has neither an error function nor a t distribution, so the published
approximations are written as plain expressions that stay inside codegen.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Hart's double-precision rational form as printed in West (2005),
# "Better approximations to cumulative normal functions" (highest power first).
_CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
_CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# Wichura (1988), algorithm AS 241, PPND16 (lowest power first).
_PPF_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
          1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3)
_PPF_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
          2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
          5.2264952788528545610e3)
_PPF_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
          3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
          2.27238449892691845833e-2, 7.74545014278341407640e-4)
_PPF_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
          1.05075007164441684324e-9)
_PPF_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7)
_PPF_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15)

# Above this many degrees of freedom the t tail uses Hill's expansion.
T_SERIES_MAX_DF = 60


def _horner(coefs, x: str) -> str:
    """Nested polynomial text, ``coefs`` from the highest power down."""
    text = f"CAST({coefs[0]!r} AS DOUBLE)"
    for c in coefs[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def norm_cdf_sql(x: str) -> str:
    """SQL text of the standard normal distribution function of column ``x``."""
    a = f"abs({x})"
    body = f"(exp(-{a} * {a} / 2e0) * {_horner(_CDF_NUM, a)} / {_horner(_CDF_DEN, a)})"
    tail = (f"(exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / "
            f"({a} + 4e0 / ({a} + 0.65e0))))) / CAST({math.sqrt(2 * math.pi)!r} AS DOUBLE))")
    lower = f"CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {body} ELSE {tail} END"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1e0 - ({lower}) ELSE ({lower}) END)"


def norm_ppf_sql(p: str) -> str:
    """SQL text of the standard normal quantile; NULL outside (0, 1)."""
    q = f"({p} - 0.5e0)"
    r0 = f"(0.180625e0 - {q} * {q})"
    centre = f"({q} * {_horner(_PPF_A[::-1], r0)} / {_horner(_PPF_B[::-1], r0)})"
    s = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    r1, r2 = f"({s} - 1.6e0)", f"({s} - 5e0)"
    near = f"({_horner(_PPF_C[::-1], r1)} / {_horner(_PPF_D[::-1], r1)})"
    far = f"({_horner(_PPF_E[::-1], r2)} / {_horner(_PPF_F[::-1], r2)})"
    sign = f"(CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END)"
    return (f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 0.425e0 THEN {centre} "
            f"WHEN {s} <= 5e0 THEN {sign} * {near} ELSE {sign} * {far} END END)")


def _hill_y(t: str, df: str) -> str:
    return f"(({df} - 0.5e0) * ln(1e0 + {t} * {t} / {df}))"


def _hill_deviate(y: str, df: str) -> str:
    b = f"(48e0 * ({df} - 0.5e0) * ({df} - 0.5e0))"
    return (f"((((((-0.4e0 * {y} - 3.3e0) * {y} - 24e0) * {y} - 85.5e0) / "
            f"(0.8e0 * {y} * {y} + 100e0 + {b}) + {y} + 3e0) / {b} + 1e0) * sqrt({y}))")


def hill_t_sql(t: str, df: str) -> str:
    """Normal deviate equivalent to ``|t|`` with many degrees of freedom (Hill 1970)."""
    return _hill_deviate(_hill_y(t, df), df)


def norm_cdf(column: str) -> Column:
    return F.expr(norm_cdf_sql(column))


def norm_ppf(column: str) -> Column:
    return F.expr(norm_ppf_sql(column))


def norm_ppf_value(p: float) -> float:
    """Quantile of one fixed probability, evaluated while the plan is built."""
    return NormalDist().inv_cdf(p)


def _tail_sum(n: Column, cos2: Column, odd: bool) -> Column:
    """Abramowitz-Stegun 26.7.3/4: 1 + sum of running products times cos^2k."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        factor = (2 * k) / (2 * k + 1) if odd else (2 * k - 1) / (2 * k)
        term = acc["term"] * factor * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ks = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, start, step)["total"]


def t_two_sided(t: str, df: str) -> Column:
    """Two-sided p-value of a t statistic with a whole number of degrees of freedom.

    Up to ``T_SERIES_MAX_DF`` the finite trigonometric series is exact; beyond it
    Hill's expansion (error below 1e-12 there) keeps the cost constant.
    """
    tc = F.abs(F.col(t))
    nu = F.col(df).cast("int")
    theta = F.atan(tc / F.sqrt(nu))
    sin_t, cos_t = F.sin(theta), F.cos(theta)
    cos2 = cos_t * cos_t
    even = 1 - sin_t * _tail_sum(F.floor(nu / 2).cast("int") - 1, cos2, odd=False)
    odd = 1 - (2 / math.pi) * (
        theta + sin_t * cos_t * _tail_sum(F.floor((nu - 1) / 2).cast("int") - 1, cos2, odd=True))
    one = 1 - 2 * theta / math.pi
    # One-element lambdas name the intermediate values, so each is computed once.
    td, nd = f"CAST({t} AS DOUBLE)", f"CAST({df} AS DOUBLE)"
    large = F.expr(f"transform(transform(array({_hill_y(td, nd)}), y -> -{_hill_deviate('y', nd)}), "
                   f"z -> 2e0 * {norm_cdf_sql('z')})[0]")
    return (F.when(F.col(t).isNull() | F.col(df).isNull() | (F.col(df) < 1), F.lit(None).cast("double"))
            .when(F.col(df) > T_SERIES_MAX_DF, large)
            .when(nu == 1, one)
            .when(nu % 2 == 0, even)
            .otherwise(odd))
