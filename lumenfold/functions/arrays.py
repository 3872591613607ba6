"""Curve values as columns: parsing, robust scaling, padding, augmentation and model scores over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_magnitude(text: Column) -> Column:
    """A number without the mark of an upper limit; null where it is none."""
    return F.trim(F.replace(text, F.lit(">"), F.lit(""))).try_cast("double")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def robust(x: Column, median: Column, iqr: Column, limit: float = 1000.0) -> Column:
    """Distance from the median in interquartile ranges (plain where the range is 0), clipped."""
    return clip(F.when(iqr > 0, (x - median) / iqr).otherwise(x - median), -limit, limit)


def pad(values: Column, length: int) -> Column:
    """The first length values, zeros after a shorter curve's end."""
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(values))))


def mask(values: Column, length: int) -> Column:
    """1 where pad() has a value of the curve, else 0."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= F.size(values), 1.0).otherwise(0.0))


def density(mask_: Column) -> Column:
    return F.aggregate(mask_, F.lit(0.0), lambda s, x: s + x) / F.size(mask_)


def roll(values: Column, by: Column) -> Column:
    """Circular shift to the right."""
    n = F.size(values)
    k = F.pmod(by, n).cast("int")
    return F.when(k == 0, values).otherwise(F.concat(F.slice(values, n - k + 1, k), F.slice(values, F.lit(1), n - k)))


def flip(values: Column) -> Column:
    return F.reverse(values)


def zero_block(values: Column, start: Column, width: int) -> Column:
    """Zeros at the 0-based places start to start + width - 1."""
    return F.transform(values, lambda x, i: F.when((i >= start) & (i < start + width), F.lit(0.0)).otherwise(x))


def drop_windows(values: Column, starts: Column, width: int) -> Column:
    """Zeros in a window of width places from each start."""
    return F.transform(values, lambda x, i: F.when(F.exists(starts, lambda s: (i >= s) & (i < s + width)), F.lit(0.0)).otherwise(x))


def scale(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda x: x * factor)


def offset(values: Column, by: Column) -> Column:
    return F.transform(values, lambda x: x + by)


def sanitize(values: Column, limit: float = 5.0, infinite: float = 10.0) -> Column:
    """NaN and null become 0, infinities +-infinite, then all is clipped."""
    inf = float("inf")
    return F.transform(values, lambda x: clip(F.when(x.isNull() | F.isnan(x), 0.0).when(x == inf, infinite).when(x == -inf, -infinite).otherwise(x), -limit, limit))


def gaussian(values: Column, key: Column, sigma: float = 0.01) -> Column:
    """Normal noise that key and place decide (Box-Muller over hashes), so that a task that runs again adds the same."""
    unit = lambda i, salt: (F.pmod(F.xxhash64(key, i, F.lit(salt)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    return F.transform(values, lambda x, i: x + F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * 3.141592653589793 * unit(i, 2)) * sigma)


def uniform(key: Column, low: float, high: float, salt: int = 0) -> Column:
    """A number in [low, high) that the key decides."""
    return F.lit(low) + F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.lit(high - low)


def argmax(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy(logits: Column, target: Column, weight: Column | None = None) -> Column:
    """log-sum-exp minus the target's logit, times the class's weight."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    out = top + F.log(total) - F.element_at(logits, target + 1)
    return out if weight is None else out * weight


def smoothed_cross_entropy(logits: Column, target: Column, smoothing: float) -> Column:
    """Cross-entropy against the target mixed with the uniform distribution."""
    top, n = F.array_max(logits), F.size(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    mean = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x) / n
    return (1 - smoothing) * (lse - F.element_at(logits, target + 1)) + smoothing * (lse - mean)


def focal_loss(entropy: Column, gamma: float = 2.0, alpha: float = 1.0) -> Column:
    return F.lit(alpha) * F.pow(1 - F.exp(-entropy), F.lit(gamma)) * entropy
