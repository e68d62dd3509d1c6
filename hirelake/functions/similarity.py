"""Set-of-trigrams similarity, as pg_trgm defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each lower-case word, padded with two blanks before and one after."""
    terms = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(
        terms,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over union of two gram sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))
