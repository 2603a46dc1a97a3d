"""erfc, the normal quantile and chi-square (1 df) in three forms: numpy, Spark columns, DuckDB text.

erfc is W. J. Cody's rational Chebyshev approximation (Math. Comp. 1969), the quantile is M. Wichura's
AS 241 (1988). Neither Spark nor DuckDB has these functions; as composed expressions they stay in codegen.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_A = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_B = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_C = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_D = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
_ISP = 1 / math.sqrt(math.pi)
_QA = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
_QB = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
_QC = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
_QD = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
_QE = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
_QF = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)

MIN_P = 1e-300
GC_MEDIAN = 0.4549364


def _horner(c, x):
    out = c[0]
    for k in c[1:]:
        out = out * x + k
    return out


# ---------------------------------------------------------------- numpy
def erfc(x) -> np.ndarray:
    x = np.asarray(x, float)
    y = np.abs(x)
    y2 = y * y
    with np.errstate(all="ignore"):
        small = 1 - y * _horner(_A, y2) / _horner(_B, y2)
        mid = np.exp(-y2) * _horner(_C, y) / _horner(_D, y)
        i = 1 / y2
        big = np.exp(-y2) / y * (_ISP - i * _horner(_P, i) / _horner(_Q, i))
        out = np.where(y <= 0.46875, small, np.where(y <= 4, mid, np.where(y > 26.7, 0.0, big)))
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - out, out))


def norm_ppf(p) -> np.ndarray:
    p = np.asarray(p, float)
    q = p - 0.5
    with np.errstate(all="ignore"):
        r = 0.180625 - q * q
        centre = q * _horner(_QA, r) / _horner(_QB, r)
        t = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
        tail = np.where(t <= 5, _horner(_QC, t - 1.6) / _horner(_QD, t - 1.6), _horner(_QE, t - 5) / _horner(_QF, t - 5))
    return np.where(np.abs(q) <= 0.425, centre, np.where(q < 0, -tail, tail))


def chi2_isf(p) -> np.ndarray:
    """Upper quantile of chi-square with one degree of freedom."""
    z = norm_ppf(np.asarray(p, float) / 2)
    return z * z


def sigmoid(x) -> np.ndarray:
    return 0.5 * (np.tanh(np.asarray(x, float) * 0.5) + 1)


# ---------------------------------------------------------------- Spark columns
def erfc_col(x: Column) -> Column:
    y = F.abs(x)
    y2 = y * y
    small = 1 - y * _horner(_A, y2) / _horner(_B, y2)
    mid = F.exp(-y2) * _horner(_C, y) / _horner(_D, y)
    i = 1 / y2
    big = F.exp(-y2) / y * (F.lit(_ISP) - i * _horner(_P, i) / _horner(_Q, i))
    out = F.when(y <= 0.46875, small).when(y <= 4, mid).when(y > 26.7, F.lit(0.0)).otherwise(big)
    return F.when(x < 0, 2 - out).otherwise(out)


def p_from_z(z: Column) -> Column:
    """Two-sided normal p-value."""
    return erfc_col(F.abs(z) / math.sqrt(2))


def chi2_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom; NaN stays NaN."""
    return F.when(F.isnan(x), F.lit(float("nan"))).otherwise(erfc_col(F.sqrt(x / 2)))


def norm_ppf_col(p: Column) -> Column:
    q = p - 0.5
    r = 0.180625 - q * q
    t = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(t <= 5, _horner(_QC, t - 1.6) / _horner(_QD, t - 1.6)).otherwise(_horner(_QE, t - 5) / _horner(_QF, t - 5))
    return F.when(F.abs(q) <= 0.425, q * _horner(_QA, r) / _horner(_QB, r)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def chi2_isf_col(p: Column) -> Column:
    z = norm_ppf_col(p / 2)
    return z * z


# ---------------------------------------------------------------- DuckDB text
def _h(c, x: str) -> str:
    out = repr(float(c[0]))
    for k in c[1:]:
        out = f"({out} * {x} + {float(k)!r})"
    return out


def erfc_sql(x: str) -> str:
    """erfc of a column or parenthesised expression, as DuckDB text."""
    y, y2, i = f"abs({x})", f"({x} * {x})", f"(1 / ({x} * {x}))"
    out = (
        f"CASE WHEN {y} <= 0.46875 THEN 1 - {y} * {_h(_A, y2)} / {_h(_B, y2)} WHEN {y} <= 4 THEN exp(-{y2}) * {_h(_C, y)} / {_h(_D, y)} "
        f"WHEN {y} > 26.7 THEN 0.0 ELSE exp(-{y2}) / {y} * ({_ISP!r} - {i} * {_h(_P, i)} / {_h(_Q, i)}) END"
    )
    return f"(CASE WHEN {x} < 0 THEN 2 - {out} ELSE {out} END)"


def p_from_z_sql(z: str) -> str:
    return erfc_sql(f"(abs({z}) / {math.sqrt(2)!r})")


def norm_ppf_sql(p: str) -> str:
    q = f"({p} - 0.5)"
    r = f"(0.180625 - {q} * {q})"
    t = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    a, b = f"({t} - 1.6)", f"({t} - 5)"
    tail = f"(CASE WHEN {t} <= 5 THEN {_h(_QC, a)} / {_h(_QD, a)} ELSE {_h(_QE, b)} / {_h(_QF, b)} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_h(_QA, r)} / {_h(_QB, r)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def chi2_isf_sql(p: str) -> str:
    z = norm_ppf_sql(f"({p} / 2)")
    return f"({z} * {z})"
