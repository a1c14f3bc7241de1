"""Probability vectors and option arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def argmax(p: Column) -> Column:
    """Index from 0; ties to the first."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def one_hot(index: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def nll(p: Column, t: Column) -> Column:
    return -total(F.zip_with(p, t, lambda a, b: b * F.log(F.greatest(a, F.lit(1e-12)))))


def brier(p: Column, t: Column) -> Column:
    return total(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)))


def interp(value: Column, points: Column) -> Column:
    """A value as weights of the two nearest of increasing points."""
    def weight(x: Column, i: Column) -> Column:
        before, after = F.try_element_at(points, i), F.try_element_at(points, i + 2)
        v = F.least(F.greatest(value, F.array_min(points)), F.array_max(points))
        rising = (v - before) / (x - before)
        falling = (after - v) / (after - x)
        return F.greatest(F.lit(0.0), F.when(v == x, 1.0).when(v < x, F.coalesce(rising, F.lit(0.0))).otherwise(F.coalesce(falling, F.lit(0.0))))

    return F.transform(points, weight)


def soft(value: Column, threshold: Column, span: Column) -> Column:
    """Smooth step up at the threshold."""
    return 0.5 * (1 + F.tanh(2.5 * (value - threshold) / (0.03 * span)))


def permute(x: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(x, i + 1))


def posterior(prior: Column, likelihoods: Column) -> Column:
    """Prior times the product of likelihood rows, normalised; null if all mass is lost."""
    mass = F.aggregate(likelihoods, prior, lambda a, l: F.zip_with(a, l, lambda x, y: x * y))
    whole = total(mass)
    return F.when(whole > 0, F.transform(mass, lambda v: v / whole))
