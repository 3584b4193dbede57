"""Column expressions on dense vectors (arrays of numbers).

All arithmetic is in double precision and every reduction is a fold from the first element to the last, so results don't depend on
partitions. A null vector, a null element and vectors of different lengths give null. For whole searches use ``operators.exact``, which
works on blocks; these expressions are for projections and for pairs that a join has already found.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def zipped(a, b, f) -> Column:
    return F.zip_with(vec(a), vec(b), f)


def dot(a, b) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def squared_l2(a, b) -> Column:
    return total(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a, b) -> Column:
    return total(zipped(a, b, lambda x, y: F.abs(x - y)))


def linf(a, b) -> Column:
    """The greatest difference; null as the others where a pair has no value."""
    gaps = zipped(a, b, lambda x, y: F.abs(x - y))
    return F.when(F.forall(gaps, lambda x: x.isNotNull()), F.array_max(gaps))


def squared_norm(a) -> Column:
    return dot(a, a)


def norm(a) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a, b) -> Column:
    """0 where one of the vectors is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def renormalised(a) -> Column:
    """Of unit length; an all-zero vector stays as it is."""
    return bound(F.struct(vec(a).alias("v"), norm(a).alias("n")), lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))


def l2_from_ip(squared_norm_a, squared_norm_b, product) -> Column:
    return squared_norm_a + squared_norm_b - 2 * product


def add(a, b) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def add_scalar(a, s) -> Column:
    return F.transform(vec(a), lambda x: x + s)


def multiply_add(a, factor, b) -> Column:
    """``a + factor * b``."""
    return zipped(a, b, lambda x, y: x + factor * y)


def arg_min(v) -> Column:
    """0-based position of the least element, the first on ties."""
    return (F.array_position(vec(v), F.array_min(vec(v))) - 1).cast("int")


def literal(numbers: list, of: str = "array<double>") -> Column:
    """Nested lists of numbers as a constant, folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(numbers)), of)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def linear(v, rows: list[list[float]] | Column, bias: list[float] | Column | None = None) -> Column:
    """``A v + b``: ``rows`` are the rows of A, as numbers or as a column."""
    a = rows if isinstance(rows, Column) else literal([[float(x) for x in r] for r in rows], "array<array<double>>")
    out = bound(vec(v), lambda y: F.transform(a, lambda r: total(F.zip_with(r, y, lambda p, q: p * q))))
    if bias is None:
        return out
    b = bias if isinstance(bias, Column) else literal([float(x) for x in bias])
    return F.zip_with(out, b, lambda x, y: x + y)


def chain(v, steps: list[tuple]) -> Column:
    """Several transforms one after the other, each ``(rows, bias)``."""
    for rows, bias in steps:
        v = linear(v, rows, bias)
    return v


def reverse_linear(v, rows: list[list[float]], bias: list[float] | None = None, eps: float = 4e-5) -> Column:
    """``A' (v - b)`` of a transform with orthonormal rows; raises where they aren't."""
    n = len(rows)
    for i in range(n):
        for j in range(i, n):
            if abs(sum(x * y for x, y in zip(rows[i], rows[j])) - (i == j)) > eps:
                raise ValueError("the rows of the transform are not orthonormal")
    moved = v if bias is None else subtract(v, literal([float(x) for x in bias]))
    return linear(moved, [list(c) for c in zip(*rows)])


def truncated(v, d: int) -> Column:
    """The first ``d`` dimensions."""
    return F.slice(vec(v), 1, d)


def sub_vectors(v, parts: int) -> Column:
    """``parts`` consecutive parts of equal length."""
    size = (F.size(vec(v)) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: F.slice(vec(v), m * size + 1, size))
