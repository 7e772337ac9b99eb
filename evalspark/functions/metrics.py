"""Column expressions for derived metrics and interval statistics.

All are pure ``Column -> Column`` builders evaluated inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.schemas import WILSON_Z95


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pass_rate(n_passed="n_passed", n_known="n_passed_known") -> Column:
    """n_passed / n_known, 0.0 when nothing with a known verdict."""
    n_passed, n_known = _c(n_passed), _c(n_known)
    return F.when(n_known > 0, n_passed / n_known).otherwise(F.lit(0.0))


def cost_per_pass(avg_cost="avg_cost_usd", rate="pass_rate") -> Column:
    """Expected spend for one passing run; NULL if cost unknown or rate <= 0."""
    avg_cost, rate = _c(avg_cost), _c(rate)
    return F.when(avg_cost.isNotNull() & (rate > 0), avg_cost / rate)


def wilson_bounds(successes, n, z: float = WILSON_Z95) -> tuple[Column, Column]:
    """(lower, upper) of the Wilson score interval; (0, 1) when n <= 0."""
    s, n = _c(successes), _c(n)
    z2 = z * z
    p = s / n
    denom = F.lit(1.0) + F.lit(z2) / n
    center = (p + F.lit(z2) / (F.lit(2) * n)) / denom
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4) * n * n)) / denom
    lo = F.when(n > 0, F.greatest(F.lit(0.0), center - margin)).otherwise(F.lit(0.0))
    hi = F.when(n > 0, F.least(F.lit(1.0), center + margin)).otherwise(F.lit(1.0))
    return lo, hi


def intervals_disjoint(a_lo, a_hi, b_lo, b_hi, slack: float = 0.0) -> Column:
    """True iff the two intervals do not overlap (strict, optional slack)."""
    a_lo, a_hi, b_lo, b_hi = map(_c, (a_lo, a_hi, b_lo, b_hi))
    return ((a_hi + F.lit(slack)) < b_lo) | ((b_hi + F.lit(slack)) < a_lo)


def lower_is_better(v, lo, hi) -> Column:
    """Min-max map where the smallest value scores 1.0 and the largest 0.0;
    an axis on which all values are equal scores 1.0 for everyone."""
    v, lo, hi = _c(v), _c(lo), _c(hi)
    return F.when(hi == lo, F.lit(1.0)).otherwise((hi - v) / (hi - lo))
