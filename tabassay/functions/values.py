"""Value functions: metric to a value in [0, 1], as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabassay.constants import REFERENCE_POINTS


def _clamped(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def _at(objective: str, name: str, given: float | Column | None) -> Column:
    value = REFERENCE_POINTS[objective][name] if given is None else given
    return value if isinstance(value, Column) else F.lit(float(value))


def linear_value(objective: str, x: Column, x_worst: float | Column | None = None, x_best: float | Column | None = None) -> Column:
    """0 at x_worst, 1 at x_best, clamped; a degenerate range has value null."""
    worst, best = _at(objective, "x_worst", x_worst), _at(objective, "x_best", x_best)
    return F.when(worst != best, _clamped((x - worst) / F.nullif(best - worst, F.lit(0.0))))


def v_fidelity(x: Column, x_worst=None, x_best=None) -> Column:
    return linear_value("fidelity", x, x_worst, x_best)


def v_privacy(x: Column, x_worst=None, x_best=None) -> Column:
    return linear_value("privacy", x, x_worst, x_best)


def v_utility(x: Column, x_worst=None, x_best=None) -> Column:
    return linear_value("utility", x, x_worst, x_best)


def v_fairness(x: Column, x_worst=None, x_best=None) -> Column:
    return linear_value("fairness", x, x_worst, x_best)


def v_efficiency(x: Column, x_best: float | None = None, x_ceiling: float | None = None) -> Column:
    """1 up to x_best minutes, then falling with the logarithm to 0 at x_ceiling."""
    best, ceiling = _at("efficiency", "x_best", x_best), _at("efficiency", "x_ceiling", x_ceiling)
    return F.when(x <= best, 1.0).otherwise(_clamped(F.lit(1.0) - F.ln(x / best) / F.ln(ceiling / best)))


VALUE_FORMS = ("linear", "concave", "convex", "logistic", "step")


def value_form(form: Column, x: Column) -> Column:
    """x transformed by the form that the column form names; an unknown form is linear."""
    return (
        F.when(form == "concave", F.sqrt(x)).when(form == "convex", x * x)
        .when(form == "logistic", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-10.0) * (x - F.lit(0.5)))))
        .when(form == "step", (x > 0.5).cast("double")).otherwise(x)
    )
