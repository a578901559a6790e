"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ngrams

BUCKETS = 384


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two, in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0))), F.lit(0.0))


def hashed_terms(text: Column, buckets: int = BUCKETS) -> Column:
    """A binary bag of the text's n-grams: the sorted distinct buckets crc32(gram) mod `buckets`. White space is left out."""
    grams = ngrams(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.crc32(g.cast("binary")) % buckets)))


def dense(terms: Column, buckets: int = BUCKETS) -> Column:
    """The vector of a binary bag."""
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.when(F.array_contains(terms, k.cast("long")), 1.0).otherwise(0.0))


def terms_cosine(a: Column, b: Column) -> Column:
    """Cosine of two binary bags."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.sqrt(F.size(a) * F.size(b))), F.lit(0.0))
