"""Arithmetic of vectors held as arrays of doubles. A null vector gives null."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, also where ``f`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column, tiny: float = TINY) -> Column:
    """With ``tiny`` added to each norm, so that zero vectors give zero."""
    return dot(a, b) / ((norm(a) + F.lit(tiny)) * (norm(b) + F.lit(tiny)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(v, lambda x: x * by)


def weighted_sum(vectors: list[Column], weights: list[Column | float]) -> Column:
    return reduce(add, [scale(v, w) for v, w in zip(vectors, weights, strict=True)])


def pad(v: Column, size: int) -> Column:
    """With zeros up to a size."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(v))))


def softmax(v: Column) -> Column:
    raised = let(v, lambda own: let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))))
    return let(raised, lambda own: let(total(own), lambda s: F.transform(own, lambda x: x / s)))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def layer_norm(v: Column, tiny: float = 1e-12) -> Column:
    """To mean zero and population deviation one."""
    centred = let(v, lambda own: let(mean(own), lambda m: F.transform(own, lambda x: x - m)))
    return let(centred, lambda own: let(F.sqrt(mean(F.transform(own, lambda x: x * x)) + F.lit(tiny)), lambda s: F.transform(own, lambda x: x / s)))


def gelu(x: Column) -> Column:
    """By its tangens hyperbolicus form."""
    return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + F.lit(0.044715) * x * x * x)))


def argmax(v: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(value: Column, classes: list) -> Column:
    return F.array(*[F.when(value == F.lit(c), 1.0).otherwise(0.0) for c in classes])


def each(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(v, f)
