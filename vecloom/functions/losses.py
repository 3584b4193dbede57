"""Losses between score lists, as column expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound, squared_l2, total, vec


def softmax(v, temperature: float = 1.0) -> Column:
    """Shifted by the greatest element, so large scores don't overflow."""
    return F.transform(log_softmax(v, temperature), lambda x: F.exp(x))


def log_softmax(v, temperature: float = 1.0) -> Column:
    shifted = bound(vec(v), lambda y: bound(F.array_max(y), lambda top: F.transform(y, lambda x: (x - top) / temperature)))
    return bound(shifted, lambda s: bound(F.log(total(F.transform(s, lambda x: F.exp(x)))), lambda mass: F.transform(s, lambda x: x - mass)))


def kl(target, given) -> Column:
    """Divergence of the softmax of ``given`` from that of ``target``."""
    p, lp, lq = softmax(target), log_softmax(target), log_softmax(given)
    return total(F.zip_with(p, F.zip_with(lp, lq, lambda x, y: x - y), lambda x, y: x * y))


def mse(a, b) -> Column:
    return squared_l2(a, b) / F.size(vec(a))
