"""Vector algebra on ``array<double>`` columns and on fitted parameters.

Parameters are short Python lists (at most classes x dimensions numbers). Expressions over them
are written as SQL text, which builds quickly; short dot products are unrolled so that whole-stage
code generation applies, long ones use higher-order functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 16


def number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("vector parameters must be finite")
    return f"{float(x)!r}D"


def vector(values: Sequence[float]) -> Column:
    """Constant vector."""
    return F.expr("array(" + ", ".join(number(v) for v in values) + ")")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def name_of(vec: str) -> str:
    return "`" + vec.replace("`", "``") + "`"


def dot_sql(vec: str, b: Sequence[float]) -> str:
    """Inner product of a named column with constants, as SQL text: unrolled when short."""
    v = name_of(vec)
    if len(b) <= UNROLL:
        return " + ".join(f"{v}[{i}] * {number(x)}" for i, x in enumerate(b))
    consts = ", ".join(number(x) for x in b)
    return f"aggregate(zip_with({v}, array({consts}), (x, y) -> x * y), 0D, (s, x) -> s + x)"


def distance_sql(kind: str, vec: str, b: Sequence[float], norm: str) -> str:
    """Distance of a named column to constants; ``norm`` names the column's own length."""
    if kind == "cosine":
        size = math.sqrt(sum(x * x for x in b))
        return (f"1D - ({dot_sql(vec, b)}) / "
                f"greatest({name_of(norm)} * {number(size)}, 1e-10D)")
    if kind != "euclidean":
        raise ValueError(f"distance must be 'cosine' or 'euclidean', not {kind!r}")
    v = name_of(vec)
    if len(b) <= UNROLL:
        diffs = [f"({v}[{i}] - {number(x)})" for i, x in enumerate(b)]
        return "sqrt(" + " + ".join(f"{d} * {d}" for d in diffs) + ")"
    consts = ", ".join(number(x) for x in b)
    return (f"sqrt(aggregate(zip_with({v}, array({consts}), (x, y) -> (x - y) * (x - y)), 0D, "
            "(s, x) -> s + x))")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vector columns."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - a.b / max(|a||b|, 1e-10)``."""
    return F.lit(1.0) - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-10))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def distance(kind: str, a: Column, b: Column) -> Column:
    if kind == "cosine":
        return cosine_distance(a, b)
    if kind == "euclidean":
        return euclidean_distance(a, b)
    raise ValueError(f"distance must be 'cosine' or 'euclidean', not {kind!r}")


def mse(a: Column, b: Column, size: int | None = None) -> Column:
    """Mean squared difference of two vectors; nested vectors are flattened by the caller.

    With a short ``size`` that both have, the sum is written out; a vector of another size gives null.
    """
    if size is not None and size <= UNROLL:
        squares = F.lit(0.0)
        for i in range(size):
            gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
            squares = squares + gap * gap
        return F.when((F.size(a) == size) & (F.size(b) == size), squares / size)
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def mse_grid(a: Column, b: Column) -> Column:
    """Mean squared difference of two equally shaped grids."""
    return mse(F.flatten(a), F.flatten(b))


def dense(vec: str, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Linear layer over a named column; ``weights`` has one row per output."""
    return F.expr("array(" + ", ".join(
        f"{dot_sql(vec, w)} + {number(b)}" for w, b in zip(weights, bias)) + ")")


def softmax(v: Column) -> Column:
    """Stable softmax."""
    exps = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(exps, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(v: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def weibull_cdf(d: Column, shape: Column, scale: Column) -> Column:
    """``1 - exp(-(d/s)^c)``; rounding can push a distance just below 0, which counts as 0."""
    floor = F.greatest(scale, F.lit(1e-10))
    return F.lit(1.0) - F.exp(-F.pow(F.greatest(d, F.lit(0.0)) / floor, shape))


def one_hot(y: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == y).cast("int"))


def with_unknown(probs: Column) -> Column:
    """Append ``clip(1 - max, 0, 1)`` and renormalise."""
    rest = F.least(F.greatest(F.lit(1.0) - F.array_max(probs), F.lit(0.0)), F.lit(1.0))
    return let(F.array_append(probs, rest),
               lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))


def pad_to(v: Column, n: int) -> Column:
    """Right zero-pad to ``n`` cells, or cut to ``n``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def to_grid(v: Column, rows: int, cols: int) -> Column:
    """Row-major grid."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda i: F.slice(v, i * cols + 1, cols))


def pick_by_name(values: Column, names: Column, wanted: Sequence[str]) -> Column:
    """Values of the wanted names out of parallel arrays, 0 where a name is absent.

    Of a repeated name the first value counts.
    """
    return F.transform(F.array(*[F.lit(w) for w in wanted]), lambda n: F.coalesce(
        F.get(values, F.array_position(names, n).cast("int") - 1), F.lit(0.0)))
