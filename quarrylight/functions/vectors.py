"""Vectors, distances and sampled positions as Column expressions; sums are in double, in order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def l2_normalize(a: Column) -> Column:
    """Null for null and for (almost) zero vectors."""
    return F.when(norm(a) > 1e-12, F.transform(a, lambda x: x.cast("double") / norm(a)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def area(width: Column, height: Column) -> Column:
    """width times height, never under 0."""
    return F.greatest(width * height, F.lit(0))


def half_cosine_distance(a: Column, b: Column, missing: float, both: float | None = None) -> Column:
    """(1 - clip(dot)) / 2 of unit vectors; `missing` if either is, `both`, if it is given, where both are."""
    gone = F.when(a.isNull() & b.isNull(), F.lit(missing if both is None else both))
    return gone.when(a.isNull() | b.isNull(), F.lit(missing)).otherwise((1 - clip(dot(a, b), -1.0, 1.0)) / 2)


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)² / (a + b + 1e-10), within 0 and 1."""
    return clip(0.5 * total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + F.lit(1e-10)))))


def chi_square_distance(a: Column, b: Column, missing: float, both: float | None = None) -> Column:
    gone = F.when(a.isNull() & b.isNull(), F.lit(missing if both is None else both))
    return gone.when(a.isNull() | b.isNull(), F.lit(missing)).otherwise(chi_square(a, b))


def time_distance(hours: Column, tau_hours: float) -> Column:
    """1 - exp(-|hours| / tau): tau is an e-folding time, not a half-life."""
    return 1 - F.exp(-F.abs(hours) / F.lit(max(tau_hours, 1e-6)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mean_hamming(a: Column, b: Column) -> Column:
    """Mean Hamming distance by position, over the shorter list; null if that is empty."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double"))
    return F.when(n > 0, total(pairs) / n)


def sample_indices(n: Column, most: int = 8) -> Column:
    """Up to `most` different positions spread over 0..n-1, halves rounded to even; [0] for n of 1 or less."""
    k = F.least(F.lit(most), n)
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / (k - 1), 0).cast("int"))
    return F.when(k <= 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(spread)))


def sample_times(duration: Column, n: int = 8) -> Column:
    """The middles of n equal parts, none within 0.05 s of the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(duration * (i + 0.5) / n, F.greatest(duration - 0.05, F.lit(0.0))))


def sign_hash(vector: Column) -> Column:
    """The signs of up to 64 components as bits, the first highest."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
