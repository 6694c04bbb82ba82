"""Tools for linear systems over stacks: transfer functions, matrix arithmetic, frequency response and root counts.

Rows of a batch whose arguments have the same shapes are computed in one call.
A row that can't be computed gives status "error" and the reason; it never
spoils the others of its stack.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stacked as S

VECTOR, MATRIX = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))
KINDS = {"matrix": MATRIX, "vector": VECTOR, "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
ARROW = {"matrix": pa.list_(pa.list_(pa.float64())), "vector": pa.list_(pa.float64()), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
#: Rows of a stack whose response is held at once.
TOGETHER = 128
#: From here on a number counts as zero, a root as beyond the axis.
ZERO, AXIS = 1e-12, 1e-9


class Unfit(ValueError):
    """A row's arguments don't fit the operation."""


def _array(x):
    """A cell as an array of floats, or a text or missing value as it is."""
    if x is None or isinstance(x, str):
        return x
    if np.ndim(x) == 0 and not isinstance(x, (list, np.ndarray)):
        return float(x)
    rows = [np.asarray(r, np.float64) if np.ndim(r) else r for r in x]
    return np.array(rows, np.float64)


def _stack(column: pa.Array):
    """A column as one stack of floats, its one text, or None where it is missing throughout; Unfit if its rows differ in that or in shape."""
    if column.null_count == len(column):
        return None
    if column.null_count:
        raise Unfit("missing in some rows")
    if pa.types.is_string(column.type):
        texts = column.unique()
        if len(texts) > 1:
            raise Unfit("texts differ")
        return texts[0].as_py()
    shape = [len(column)]
    while pa.types.is_list(column.type):
        lengths = pc.list_value_length(column).to_numpy()
        if (lengths != lengths[0]).any():
            raise Unfit("shapes differ")
        column = column.flatten()
        shape.append(int(lengths[0]))
        if column.null_count or not len(column):
            raise Unfit("missing or no components")
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(shape)


def _distinct(arguments: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each set of equal arguments, place of each row among these); equal to the bit."""
    flat = [a.reshape(n, -1) for a in arguments if isinstance(a, np.ndarray)]
    if not flat:
        return np.zeros(1, np.int64), np.zeros(n, np.int64)
    rows = np.ascontiguousarray(np.concatenate(flat, axis=1))
    _, first, place = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, place


def stacked_tool(work: Callable, **fields: str):
    """An Arrow UDF of struct<status, error, fields>; work gets a stack of each argument (texts and missing ones once) and gives stacks by name.

    Equal arguments of a batch are computed once.  work may name the rows that
    can't be computed, each with its reason, under "error".
    """
    schema = T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *(T.StructField(n, KINDS[k]) for n, k in fields.items())])

    def solve(arguments: list, n: int) -> list[dict]:
        try:
            with np.errstate(all="ignore"):
                found = dict(work(*arguments))
            errors = found.pop("error", {})
            return [{"status": "error", "error": errors[i]} if i in errors else {"status": "success", "error": None} | {name: _cell(v[i]) for name, v in found.items()} for i in range(n)]
        except (ValueError, TypeError, IndexError, AttributeError, np.linalg.LinAlgError) as e:  # AttributeError: a missing argument
            if n > 1:
                return [r for i in range(n) for r in solve([a[i : i + 1] if isinstance(a, np.ndarray) else a for a in arguments], 1)]
            return [{"status": "error", "error": str(e) if isinstance(e, Unfit) else f"{type(e).__name__}: {e}"}]

    def unlike(columns: tuple[pa.Array, ...]) -> list[dict]:
        """Rows of several shapes, a stack each."""
        groups: dict = {}
        out: list = [None] * len(columns[0])
        for i, cells in enumerate(zip(*[c.to_pandas() for c in columns])):
            try:
                row = tuple(_array(x) for x in cells)
                groups.setdefault(tuple(x if x is None or isinstance(x, str) else np.shape(x) for x in row), []).append((i, row))
            except (ValueError, TypeError) as e:
                out[i] = {"status": "error", "error": f"{type(e).__name__}: {e}"}
        for held in groups.values():
            arguments = [a if a is None or isinstance(a, str) else np.array([r[k] for _, r in held]) for k, a in enumerate(held[0][1])]
            for (i, _), made in zip(held, solve(arguments, len(held))):
                out[i] = made
        return out

    @F.arrow_udf(schema)
    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        try:
            arguments = [_stack(c) for c in columns]
            first, place = _distinct(arguments, n)
            made = solve([a[first] if isinstance(a, np.ndarray) else a for a in arguments], len(first))
        except Unfit:
            made, place = unlike(columns), np.arange(n)
        kinds = [pa.string(), pa.string(), *(ARROW[k] for k in fields.values())]
        found = pa.StructArray.from_arrays([pa.array([r.get(f) for r in made], kind, from_pandas=True) for f, kind in zip(schema.names, kinds)], names=schema.names)
        return found.take(pa.array(place))

    return run


def _cell(x):
    if x is None or isinstance(x, str):
        return x
    x = np.asarray(x)
    return x.tolist() if x.ndim else x.item()


def in_order(z: np.ndarray) -> np.ndarray:
    """Complex numbers [n, k] as pairs, by real part, then imaginary part, to nine places."""
    order = np.lexsort((np.round(z.imag, 9), np.round(z.real, 9)), axis=-1)
    z = np.take_along_axis(z, order, axis=-1)
    return np.stack((z.real, z.imag), axis=-1)


def _transfer(a, b, c, d):
    """Of the first output to a single input: num = c adj(sI - a) b + d den."""
    if a.ndim != 3 or a.shape[1] != a.shape[2] or b.shape[1:] != (a.shape[1], 1) or c.shape[2:] != a.shape[2:] or d.shape[1:] != (c.shape[1], 1):
        raise Unfit("A, B, C and D don't fit, or there are several inputs")
    den, adjugate = S.characteristic(a)
    num = d[:, 0, :1] * den
    num[:, 1:] += np.einsum("nj,nkjl,nl->nk", c[:, 0], adjugate, b[:, :, 0])
    zeros = [in_order(S.roots(np.trim_zeros(np.where(np.abs(row) < ZERO, 0, row), "f")[None]))[0] for row in num]
    return {"numerator": num, "denominator": den, "poles": in_order(S.roots(den)), "zeros": zeros}


def _shape(a: np.ndarray) -> str:
    return f"{a.shape[1]}x{a.shape[2]}"


def _arithmetic(operation, a, b):
    if operation in ("multiply", "add", "subtract", "elementwise_multiply"):
        if b is None:
            raise Unfit(f"operation '{operation}' requires matrix_b.")
        if operation == "multiply":
            if a.shape[2] != b.shape[1]:
                raise Unfit(f"Cannot multiply {_shape(a)} by {_shape(b)}: inner dimensions must match.")
            return {"result": a @ b}
        if a.shape != b.shape:
            raise Unfit(f"'{operation}' needs equal shapes, got {_shape(a)} and {_shape(b)}.")
        return {"result": {"add": np.add, "subtract": np.subtract, "elementwise_multiply": np.multiply}[operation](a, b)}
    if operation == "transpose":
        return {"result": S.t(a)}
    if operation == "rank":
        return {"value": np.linalg.matrix_rank(a).astype(float)}
    if operation not in ("inverse", "determinant", "trace", "eigenvalues"):
        raise Unfit(f"unknown operation '{operation}'")
    if a.shape[1] != a.shape[2]:
        raise Unfit(f"'{operation}' requires a square matrix, got {_shape(a)}.")
    if operation == "trace":
        return {"value": np.trace(a, axis1=1, axis2=2)}
    if operation == "eigenvalues":
        z = np.linalg.eigvals(a) + 0j
        return {"result": in_order(z), "value": np.abs(z).max(axis=1)}
    det = np.linalg.det(a)
    if operation == "determinant":
        return {"value": det}
    singular = np.abs(det) < ZERO
    errors = {i: f"Matrix is singular (determinant = {det[i]:g}); no inverse exists." for i in np.flatnonzero(singular).tolist()}
    return {"result": np.linalg.inv(np.where(singular[:, None, None], S.eye(a), a)), "value": det, "error": errors}


def response(num: np.ndarray, den: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(magnitude, phase in degrees without jumps) [n, points] at the frequencies w."""
    s = 1j * w
    value = lambda p: sum(p[:, i : i + 1] * s ** (p.shape[1] - 1 - i) for i in range(p.shape[1]))
    h = value(num) / value(den)
    return np.abs(h), np.degrees(np.unwrap(np.angle(h), axis=1))


def _in_runs(work: Callable, num: np.ndarray, den: np.ndarray) -> dict:
    parts = [work(num[i : i + TOGETHER], den[i : i + TOGETHER]) for i in range(0, len(num), TOGETHER)]
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _margins(num, den):
    """On 2000 points from 1e-3 to 1e4 rad/s: margins at the samples nearest to unit gain and to -180 degrees, and how often the gain passes one and the phase -180 degrees."""
    w = np.logspace(-3, 4, 2000)

    def of(num, den):
        size, phase = response(num, den, w)
        row = np.arange(len(size))
        gain, turn = np.argmin(np.abs(size - 1), axis=1), np.argmin(np.abs(phase + 180), axis=1)
        at = size[row, turn]
        ratio = np.where(at > ZERO, 1 / np.maximum(at, ZERO), np.inf)
        passes = lambda x: (np.signbit(x[:, 1:]) != np.signbit(x[:, :-1])).sum(axis=1)
        margin = 180 + phase[row, gain]
        decibels = np.where(np.isfinite(ratio), 20 * np.log10(ratio), np.nan)
        stable = (margin > 0) & (~np.isfinite(ratio) | (decibels > 0))
        return {
            "gain_margin": ratio, "gain_margin_db": decibels, "phase_margin": margin, "gain_crossover": w[gain], "phase_crossover": w[turn],
            "gain_crossings": passes(size - 1), "phase_crossings": passes(phase + 180), "stable": stable,
        }

    return _in_runs(of, num, den)


def _nyquist(num, den):
    """Closed-loop and open-loop poles beyond the axis are exact root counts, and encirclements are their difference."""
    if num.shape[1] > den.shape[1]:
        closed = np.zeros((len(num), 0), complex)
    else:
        closed = S.roots(den + np.concatenate((np.zeros((len(num), den.shape[1] - num.shape[1])), num), axis=1))
    opened = S.roots(den)
    count = lambda z: (np.real(z) > AXIS).sum(axis=1)
    z, p = count(closed), count(opened)
    return {"encirclements": z - p, "open_poles": p, "at_origin": (np.abs(opened) < AXIS).sum(axis=1), "closed_poles": z, "poles": in_order(closed), "stable": z == 0}


def _bode(num, den, low, high, points):
    """Response on log-spaced points: static gain, peak, and every tenth sample."""
    if len(set(points.tolist())) > 1 or len(set(low.tolist())) > 1 or len(set(high.tolist())) > 1:
        raise Unfit("rows of a stack share their grid")  # each row is then computed alone
    w = np.logspace(np.log10(low[0]), np.log10(high[0]), int(points[0]))

    def of(num, den):
        size, phase = response(num, den, w)
        level = 20 * np.log10(size)
        top = np.argmax(level, axis=1)
        steady = np.where(np.abs(den[:, -1]) > ZERO, num[:, -1] / np.where(np.abs(den[:, -1]) > ZERO, den[:, -1], 1), np.nan)
        return {"dc_gain": steady, "peak_db": level[np.arange(len(top)), top], "peak_frequency": w[top], "frequencies": np.broadcast_to(w[::10], (len(top), len(w[::10]))), "magnitudes_db": level[:, ::10], "phases": phase[:, ::10]}

    return _in_runs(of, num, den)


transfer_function = stacked_tool(_transfer, numerator="vector", denominator="vector", poles="matrix", zeros="matrix")
arithmetic = stacked_tool(_arithmetic, result="matrix", value="double")
stability_margins = stacked_tool(_margins, gain_margin="double", gain_margin_db="double", phase_margin="double", gain_crossover="double", phase_crossover="double", gain_crossings="int", phase_crossings="int", stable="boolean")
nyquist = stacked_tool(_nyquist, encirclements="int", open_poles="int", at_origin="int", closed_poles="int", poles="matrix", stable="boolean")
bode = stacked_tool(_bode, dc_gain="double", peak_db="double", peak_frequency="double", frequencies="vector", magnitudes_db="vector", phases="vector")
