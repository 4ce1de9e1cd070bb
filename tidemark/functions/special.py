"""Distribution functions as plan expressions, by the commons-math classes that Spark ships with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERF = "org.apache.commons.math3.special.Erf"
BETA = "org.apache.commons.math3.special.Beta"
GAMMA = "org.apache.commons.math3.special.Gamma"
EULER = 0.5772156649


def _call(cls: str, name: str, *args: Column) -> Column:
    held = [a.cast("double") for a in args]
    called = F.reflect(F.lit(cls), F.lit(name), *held).cast("double")
    missing = held[0].isNull()
    for a in held[1:]:
        missing = missing | a.isNull()
    return F.when(~missing, called)


def norm_cdf(z: Column) -> Column:
    return 0.5 * (1 + _call(ERF, "erf", z / F.sqrt(F.lit(2.0))))


def norm_ppf(p: Column) -> Column:
    return F.sqrt(F.lit(2.0)) * _call(ERF, "erfInv", 2 * p - 1)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) with dof degrees of freedom."""
    return _call(BETA, "regularizedBeta", dof / (dof + t * t), dof / 2, F.lit(0.5))


def chi2_sf(x: Column, k: int) -> Column:
    return 1 - _call(GAMMA, "regularizedGammaP", F.lit(k / 2), x / 2)


def f_sf(x: Column, d1: Column, d2: Column) -> Column:
    """P(F > x) with d1 and d2 degrees of freedom."""
    return _call(BETA, "regularizedBeta", d2 / (d2 + d1 * x), d2 / 2, d1 / 2)
