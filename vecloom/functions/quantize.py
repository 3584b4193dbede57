"""Column expressions of scalar and product quantisation.

A codebook is an array over sub-spaces of arrays over codes of sub-centroids (``array<array<array<double>>>``). It is small (2^bits times the
dimension), so it travels as one column of a broadcast row. Codes are arrays of int. Ties go to the smaller code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import squared_l2, sub_vectors, total, vec


def direct8(v) -> Column:
    """``floor(127 x + 128)`` limited to 0..255: for values in -1..1."""
    return F.transform(vec(v), lambda x: F.greatest(F.least(F.floor(x * 127 + 128), F.lit(255)), F.lit(0)).cast("int"))


def scalar_encode(v, low: Column, span: Column, bits: int) -> Column:
    """Codes of ``bits`` bits over a range per dimension (``low``, ``span`` as arrays): position in the range times the greatest code, cut off
    to a whole number and limited. A dimension without span has code 0."""
    top = (1 << bits) - 1
    scaled = F.zip_with(F.zip_with(vec(v), low, lambda x, l: x - l), span, lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s))
    return F.transform(scaled, lambda x: F.floor(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * top).cast("int"))


def scalar_decode(codes, low: Column, span: Column, bits: int) -> Column:
    """The middle of each code's cell."""
    top = (1 << bits) - 1
    return F.zip_with(F.transform(codes, lambda c: (c + F.lit(0.5)) / top), F.zip_with(low, span, lambda l, s: F.struct(l.alias("l"), s.alias("s"))), lambda x, r: r["l"] + x * r["s"])


def _first_least(values: Column) -> Column:
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def pq_encode(v, codebook: Column, parts: int) -> Column:
    """The nearest sub-centroid of every sub-space by squared distance, whatever the metric of the search."""
    return F.zip_with(sub_vectors(v, parts), codebook, lambda x, book: _first_least(F.transform(book, lambda c: squared_l2(x, c))))


def pq_decode(codes, codebook: Column) -> Column:
    return F.flatten(F.zip_with(codes, codebook, lambda c, book: F.element_at(book, c + 1)))


def adc_table(q, codebook: Column, parts: int, metric: str) -> Column:
    """For every sub-space the inner product or squared distance of a query's part with every sub-centroid."""
    score = (lambda x, c: total(F.zip_with(x, c, lambda a, b: a * b))) if metric == "ip" else squared_l2
    return F.zip_with(sub_vectors(q, parts), codebook, lambda x, book: F.transform(book, lambda c: score(x, c)))


def adc_score(table: Column, codes) -> Column:
    """The sum of the table entries of a vector's codes."""
    return total(F.zip_with(table, codes, lambda row, c: F.element_at(row, c + 1)))


def sdc_table(codebook: Column) -> Column:
    """Squared distances of all pairs of sub-centroids of each sub-space."""
    return F.transform(codebook, lambda book: F.transform(book, lambda a: F.transform(book, lambda b: squared_l2(a, b))))


def sdc_score(table: Column, a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return total(F.zip_with(table, pairs, lambda t, p: F.element_at(F.element_at(t, p["x"] + 1), p["y"] + 1)))


def lut_scale(table: Column) -> Column:
    """``struct(a, b)`` of the quantisation of a table to eight-bit entries whose sums fit sixteen: a is the lesser of 255 over the greatest span
    and 65535 over the sum of spans, b the sum of the least entries."""
    spans = F.transform(table, lambda r: F.array_max(r) - F.array_min(r))
    return F.struct(
        F.least(F.lit(255.0) / F.array_max(spans), F.lit(65535.0) / total(spans)).alias("a"), total(F.transform(table, lambda r: F.array_min(r))).alias("b")
    )


def lut_quantised(table: Column, a: Column) -> Column:
    return F.transform(table, lambda r: F.transform(r, lambda x: F.floor((x - F.array_min(r)) * a + F.lit(0.5)).cast("int")))


def lut_score(table: Column, codes, a: Column, b: Column) -> Column:
    """The approximate score of codes by a quantised table."""
    raw = F.aggregate(F.zip_with(table, codes, lambda row, c: F.element_at(row, c + 1)), F.lit(0), lambda s, x: s + x)
    return raw / a + b
