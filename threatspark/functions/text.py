"""Column functions on domain names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def clean_domain(domain: Column) -> Column:
    return F.lower(F.trim(F.coalesce(domain, F.lit(""))))


def labels(domain: Column) -> Column:
    return F.split(domain, "\\.", -1)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the lambdas inside ``body`` use it."""
    return F.get(F.transform(F.array(value), body), 0)


def first_label(domain: Column) -> Column:
    return F.substring_index(F.coalesce(domain, F.lit("")), ".", 1)


def shannon_entropy(domain: Column) -> Column:
    """Bits per character of the domain without its dots; 0 for nothing left."""

    def bits(text: Column) -> Column:
        counts = F.transform(
            F.array_distinct(F.split(text, "")),
            lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"),
        )
        total = F.length(text).cast("double")
        return F.log2(total) - F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * F.log2(k)) / total

    text = F.replace(F.coalesce(domain, F.lit("")), F.lit("."), F.lit(""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(bound(text, bits))


def ngrams(label: Column, n: int) -> Column:
    """All n-character pieces of a label, in order; empty if the label is shorter than n."""

    def pieces(text: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, n))

    return F.when(F.length(label) >= n, bound(label, pieces)).otherwise(F.array().cast("array<string>"))


def suffixes(domain: Column) -> Column:
    """The domain and its parents, without the bare top-level label."""

    def parents(parts: Column) -> Column:
        n = F.size(parts)
        cuts = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
        return F.transform(cuts, lambda i: F.array_join(F.slice(parts, i + 1, F.greatest(n - i, F.lit(1))), "."))

    several = F.size(labels(domain)) > 2
    return F.when(several, F.concat(F.array(domain), bound(labels(domain), parents))).otherwise(F.array(domain))


def longest_subdomain_label(domain: Column) -> Column:
    """Length of the longest label before the last two; 0 if there is none."""
    parts = labels(F.coalesce(domain, F.lit("")))
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda x: F.length(x)))
    return F.coalesce(longest, F.lit(0))
