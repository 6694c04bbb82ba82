"""Recomputation of ground truths, as Column expressions.

A record has a kind, numbers s (map<string,double>) and lists v
(map<string,array<double>>).  A check recomputes the claimed values; a record
that lacks a value gives null, which is an error row for the caller, and an
unknown kind gives null too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def all_close(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: close(x, y)), lambda x: x)


def _flag(x: Column) -> Column:
    return x > 0.5


def _degrees(x: Column) -> Column:
    return F.degrees(x)


def _frequency(s, v):
    size = s("gain") / F.sqrt(1 + F.pow(s("tau") * s("omega"), 2))
    return close(s("magnitude"), size) & close(s("magnitude_db"), 20 * F.log10(size)) & close(s("phase_deg"), -_degrees(F.atan(s("tau") * s("omega"))))


def _second_order(s, v):
    root = F.sqrt(1 - s("zeta") * s("zeta"))
    wd = s("omega_n") * root
    return close(s("damped_frequency"), wd) & close(s("overshoot_percent"), 100 * F.exp(-F.pi() * s("zeta") / root)) & close(s("peak_time"), F.pi() / wd) & close(s("settling_time"), 4 / (s("zeta") * s("omega_n")))


def _sensitivity(s, v):
    re, im = s("l_re"), s("l_im")
    n = (1 + re) * (1 + re) + im * im
    return close(s("s_re"), (1 + re) / n) & close(s("s_im"), -im / n) & close(s("t_re"), (re * (1 + re) + im * im) / n) & close(s("t_im"), im / n)


def _lead(s, v):
    phi = F.radians(s("phase_deg"))
    alpha = (1 - F.sin(phi)) / (1 + F.sin(phi))
    return close(s("alpha"), alpha) & close(s("tau"), 1 / (s("omega_m") * F.sqrt(alpha)))


def _riccati(s, v):
    """Backward scalar recursion over `steps` from p_final; the gains stand first to last."""
    a, b, q, r = s("a"), s("b"), s("q"), s("r")
    zero = F.struct(s("p_final").alias("p"), F.array().cast("array<double>").alias("k"))

    def step(acc, _):
        k = a * b * acc["p"] / (r + b * b * acc["p"])
        return F.struct((q + a * a * acc["p"] - a * b * acc["p"] * k).alias("p"), F.concat(F.array(k), acc["k"]).alias("k"))

    done = F.aggregate(F.sequence(F.lit(1), s("steps").cast("int")), zero, step)
    return all_close(v("gains"), done["k"]) & close(s("p_initial"), done["p"])


def _isolation(s, v):
    b, u = v("b"), v("u")
    miss = F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.abs(F.aggregate(F.zip_with(b, u, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) - F.get(b, i) * F.get(u, i) - s("measured")))
    return F.array_position(miss, F.array_min(miss)) - 1 == s("lost")


def _event(s, v):
    return (F.abs(s("held") - s("x")) >= s("sigma") * F.abs(s("x"))) == _flag(s("triggered"))


def _safe(s, v):
    u = F.least(F.greatest(s("u_nom"), s("lower")), s("upper"))
    return close(s("u"), u) & (s("lower") <= s("u") + 1e-9) & (s("u") <= s("upper") + 1e-9)


def _return(s, v):
    terms = F.transform(v("rewards"), lambda r, t: r * F.pow(s("gamma"), t))
    return all_close(v("terms"), terms) & close(s("value"), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def _autocorrelation(s, v):
    r, lag = v("residual"), s("lag").cast("int")
    pairs = F.zip_with(F.slice(r, lag + 1, F.size(r) - lag), F.slice(r, F.lit(1), F.size(r) - lag), lambda x, y: x * y)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return close(s("acf"), total(pairs) / total(F.transform(r, lambda x: x * x)))


#: kind -> check(s, v); s and v look values up.
CHECKS = {
    "scalar_dynamic_inversion": lambda s, v: close(s("v"), -s("k") * (s("x") - s("r"))) & close(s("u"), (s("v") - s("a") * s("x")) / s("b")),
    "gain_schedule_interpolation": lambda s, v: close(s("w"), (s("sigma") - s("low")) / (s("high") - s("low"))) & s("w").between(0, 1) & close(s("k"), (1 - s("w")) * s("k_low") + s("w") * s("k_high")),
    "scalar_cbf_filter": lambda s, v: close(s("h"), s("x") - s("x_min")) & close(s("u"), F.greatest(s("u_nom"), -s("alpha") * s("h"))),
    "scalar_stationary_covariance": lambda s, v: (F.abs(s("a")) < 1) & close(s("p"), s("q") / (1 - s("a") * s("a"))),
    "minimum_norm_allocation": lambda s, v: all_close(v("u"), F.transform(v("b"), lambda x: x * s("tau") / F.aggregate(v("b"), F.lit(0.0), lambda a, y: a + y * y))),
    "iid_jump_mean_square": lambda s, v: close(s("rho"), s("p") * s("a1") * s("a1") + (1 - s("p")) * s("a2") * s("a2")) & ((s("rho") < 1) == _flag(s("stable"))),
    "relative_event_trigger": _event,
    "symmetric_tube_tightening": lambda s, v: close(s("tight"), s("bound") - s("error")) & (s("tight") >= 0),
    "finite_discounted_return": _return,
    "nonlinear_equilibrium_feedforward": lambda s, v: close(s("u"), s("a") * F.pow(s("r"), 3) / s("b")),
    "robust_safe_input_interval": _safe,
    "single_actuator_loss_isolation": _isolation,
    "first_order_frequency": _frequency,
    "first_order_step": lambda s, v: close(s("final"), s("gain")) & close(s("at_tau"), s("gain") * (1 - F.exp(F.lit(-1.0)))) & close(s("settling"), -s("tau") * F.ln(F.lit(0.02))),
    "second_order_transient": _second_order,
    "sensitivity_complex": _sensitivity,
    "lead_parameters": _lead,
    "root_locus_real_axis": lambda s, v: (F.size(F.filter(v("singularities"), lambda x: x > s("x"))) % 2 == 1) == _flag(s("on_locus")),
    "crossover_margins": lambda s, v: close(s("gain_margin"), 1 / s("magnitude")) & close(s("gain_margin_db"), -20 * F.log10(s("magnitude"))) & close(s("phase_margin"), 180 + s("phase_deg")),
    "scalar_kf_predict": lambda s, v: close(s("x_next"), s("a") * s("x") + s("b") * s("u")) & close(s("p_next"), s("a") * s("a") * s("p") + s("q")),
    "finite_horizon_lqr": _riccati,
    "mpc_prediction": lambda s, v: all_close(v("f"), F.transform(F.sequence(F.lit(1), s("n").cast("int")), lambda i: F.pow(s("a"), i))),
    "cubic_equilibria": lambda s, v: all_close(v("x"), F.array(-F.sqrt(s("a") / s("b")), F.lit(0.0), F.sqrt(s("a") / s("b")))) & all_close(v("slope"), F.transform(v("x"), lambda x: s("a") - 3 * s("b") * x * x)),
    "nonlinear_jacobian": lambda s, v: all_close(v("poles"), F.array(-s("a"), -s("b"))),
    "scalar_linear_cubic_lyapunov": lambda s, v: ((s("a") > 0) & (s("b") > 0)) == _flag(s("stable")),
    "feedback_linearization": lambda s, v: (s("b") != 0) & close(s("pole1") + s("pole2"), -s("k2")) & close(s("pole1") * s("pole2"), s("k1")),
    "zero_dynamics": lambda s, v: close(s("zero"), -s("a")) & ((s("a") > 0) == _flag(s("minimum_phase"))),
    "sliding_reachability": lambda s, v: close(s("eta"), s("k") - s("d_max")) & ((s("eta") > 0) == _flag(s("reachable"))),
    "small_gain": lambda s, v: close(s("product"), s("g1") * s("g2")) & ((s("product") < 1) == _flag(s("certified"))),
    "weighted_peak": lambda s, v: close(s("peak"), F.array_max(F.zip_with(v("w"), v("r"), lambda a, b: a * b))) & ((s("peak") < s("bound")) == _flag(s("satisfied"))),
    "hinf_first_order": lambda s, v: close(s("norm"), F.abs(s("gain"))),
    "pe_sincos": lambda s, v: close(s("period"), 2 * F.pi() / s("omega")) & close(s("level"), F.pi() / s("omega")),
    "gradient_identifier": lambda s, v: all_close(v("next"), F.zip_with(v("theta"), v("phi"), lambda t, p: t + s("dt") * s("gamma") * p * s("e"))),
    "normalized_identifier": lambda s, v: all_close(v("next"), F.zip_with(v("theta"), v("phi"), lambda t, p: t + s("gamma") * p * s("e") / (1 + F.aggregate(v("phi"), F.lit(0.0), lambda a, y: a + y * y)))),
    "fopdt_step": lambda s, v: close(s("gain"), s("delta_y") / s("delta_u")) & close(s("tau"), s("t63") - s("delay")),
    "residual_autocorrelation": _autocorrelation,
}


def verified(kind: Column, s: Column, v: Column) -> Column:
    """Whether a record's values are right; null if one is missing or the kind is unknown."""
    out = None
    for name, check in CHECKS.items():
        read: list[Column] = []

        def look(values: Column):
            def get(key: str) -> Column:
                read.append(F.try_element_at(values, F.lit(key)))
                return read[-1]

            return get

        test = check(look(s), look(v))
        whole = F.lit(True)
        for value in read:
            whole = whole & value.isNotNull()
        test = F.when(whole, test)
        out = F.when(kind == name, test) if out is None else out.when(kind == name, test)
    return out
