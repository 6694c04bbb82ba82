"""Closed-form engineering tools as Column functions; inputs and outputs are doubles or arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tuning factors (gain, integral time, derivative time) by objective; the integral time is in delays for the last, in time constants otherwise.
TUNING = {"setpoint_tracking_0_overshoot": (0.6, 1.0, 0.5), "setpoint_tracking_20_overshoot": (0.95, 1.35, 0.47), "disturbance_rejection": (1.2, 2.0, 0.42)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pid_tuning(gain: Column, lag: Column, delay: Column, objective: str = "setpoint_tracking_0_overshoot") -> Column:
    """struct(kp, ki, kd, ti, td) for a first-order plant with delay."""
    p, i, d = TUNING[objective]
    kp = F.lit(p) / (gain * delay / lag)
    ti = F.lit(i) * (delay if objective == "disturbance_rejection" else lag)
    td = F.lit(d) * delay
    return F.struct(kp.alias("kp"), (kp / ti).alias("ki"), (kp * td).alias("kd"), ti.alias("ti"), td.alias("td"))


def barrier_filter(x: Column, wanted: Column, alpha: Column, least: Column) -> Column:
    """struct(h, bound, u, active): the input nearest to `wanted` that keeps x over `least`."""
    h = x - least
    bound = -alpha * h
    return F.struct(h.alias("h"), bound.alias("bound"), F.greatest(wanted, bound).alias("u"), (wanted < bound).alias("active"))


def dynamic_inversion(a: Column, b: Column, x: Column, reference: Column, gain: Column) -> Column:
    """struct(v, u, residual) of the scalar plant a x + b u."""
    v = -gain * (x - reference)
    u = (v - a * x) / b
    return F.struct(v.alias("v"), u.alias("u"), F.abs(a * x + b * u - v).alias("residual"))


def feedback_linearization(drift: Column, b: Column, k1: Column, k2: Column, x1: Column, x2: Column) -> Column:
    """struct(v, u, re1, im1, re2, im2, stable); the poles solve s^2 + k2 s + k1 = 0."""
    v = -k1 * x1 - k2 * x2
    under = k2 * k2 - 4 * k1
    real = F.sqrt(F.greatest(under, F.lit(0.0))) / 2
    imag = F.sqrt(F.greatest(-under, F.lit(0.0))) / 2
    re1, re2 = -k2 / 2 + real, -k2 / 2 - real
    return F.struct(v.alias("v"), ((v - drift) / b).alias("u"), re1.alias("re1"), imag.alias("im1"), re2.alias("re2"), (-imag).alias("im2"), ((re1 < 0) & (re2 < 0)).alias("stable"))


def cubic_is_hurwitz(c0: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """Whether c0 + c1 s + c2 s^2 + c3 s^3 has its roots in the left half plane (Routh, either sign)."""
    sign = F.signum(c3)
    positive = (c0 * sign > 0) & (c1 * sign > 0) & (c2 * sign > 0) & (c3 != 0)
    return positive & (c1 * c2 > c0 * c3)


def interval_cubic_is_hurwitz(low: Column, high: Column) -> Column:
    """The four corner polynomials of an interval cubic, ascending coefficients."""
    corner = lambda *pick: [(high if p else low)[i] for i, p in enumerate(pick)]
    tests = [cubic_is_hurwitz(*corner(*c)) for c in ((0, 0, 1, 1), (1, 1, 0, 0), (1, 0, 0, 1), (0, 1, 1, 0))]
    return tests[0] & tests[1] & tests[2] & tests[3]


def small_gain(g1: Column, g2: Column) -> Column:
    """struct(product, certified, margin)."""
    p = g1 * g2
    return F.struct(p.alias("product"), (p < 1).alias("certified"), F.when(p < 1, 1 - p).otherwise(0.0).alias("margin"))


def peak_product(weights: Column, sensitivity: Column) -> Column:
    """struct(peak, satisfied) over a grid."""
    peak = F.array_max(F.zip_with(weights, sensitivity, lambda w, t: w * t))
    return F.struct(peak.alias("peak"), (peak < 1).alias("satisfied"))


def allocation(b: Column, wanted: Column) -> Column:
    """struct(u, achieved, norm): the smallest input vector with b u = wanted."""
    u = F.transform(b, lambda x: wanted / dot(b, b) * x)
    return F.struct(u.alias("u"), dot(b, u).alias("achieved"), F.sqrt(dot(u, u)).alias("norm"))


def fault_isolation(b: Column, command: Column, measured: Column) -> Column:
    """struct(expected, residual, detected, losses): the loss of each actuator that alone would explain the residual."""
    expected = dot(b, command)
    residual = measured - expected
    losses = F.zip_with(b, command, lambda x, u: F.when(F.abs(x * u) > 1e-9, -residual / (x * u)))
    return F.struct(expected.alias("expected"), residual.alias("residual"), (F.abs(residual) > 1e-4).alias("detected"), losses.alias("losses"))
