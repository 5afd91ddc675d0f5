"""Similarities and distances of vectors (array<double> columns), and a registry to add more under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITIES: dict[str, Callable[..., Column]] = {}


def register_similarity(name: str):
    """Decorator: (a, b, **options) -> Column becomes available as ``name``."""

    def add(f):
        SIMILARITIES[name] = f
        return f

    return add


def similarity(kind: str | Callable[..., Column], **options) -> Callable[[Column, Column], Column]:
    f = SIMILARITIES[kind] if isinstance(kind, str) else kind
    return lambda a, b: f(a, b, **options)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def centred(v: Column) -> Column:
    mean = total(v) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def normalized(v: Column, eps: float = 1e-8) -> Column:
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / n)


@register_similarity("cosine")
def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot_product(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


@register_similarity("correlation")
def correlation(a: Column, b: Column) -> Column:
    return cosine(centred(a), centred(b))


@register_similarity("dot")
def dot(a: Column, b: Column) -> Column:
    return dot_product(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


@register_similarity("neg_sq_euclidean")
def neg_sq_euclidean(a: Column, b: Column) -> Column:
    return -squared_distance(a, b)


@register_similarity("neg_euclidean")
def neg_euclidean(a: Column, b: Column) -> Column:
    return -F.sqrt(squared_distance(a, b))


@register_similarity("neg_normalized_euclidean")
def neg_normalized_euclidean(a: Column, b: Column) -> Column:
    return -F.sqrt(squared_distance(normalized(a), normalized(b)))


@register_similarity("neg_manhattan")
def neg_manhattan(a: Column, b: Column) -> Column:
    return -total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


@register_similarity("rbf")
def rbf(a: Column, b: Column, gamma: float | None = None) -> Column:
    g = F.lit(gamma) if gamma is not None else 1.0 / F.size(a)
    return F.exp(-g * squared_distance(a, b))


def cosine_distance(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """1 less the cosine, with ``eps`` added to the product of the norms."""
    return 1 - dot_product(a, b) / (norm(a) * norm(b) + eps)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))
