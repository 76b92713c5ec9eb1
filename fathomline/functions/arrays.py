"""Column functions on one ping's samples: everything stays on the ping's own row, so nothing is shuffled."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row even where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamped(samples: Column, i: Column) -> Column:
    """samples[i] with i held inside the array (edge replication)."""
    return F.element_at(samples, (F.greatest(F.lit(0), F.least(F.size(samples) - 1, i)) + 1).cast("int"))


def reflected(samples: Column, i: Column) -> Column:
    """samples[i] with indices mirrored at both edges, the edge sample repeated."""
    n = F.size(samples)
    m = F.pmod(i, 2 * n)
    return F.element_at(samples, (F.when(m >= n, 2 * n - 1 - m).otherwise(m) + 1).cast("int"))


def filtered(samples: Column, weights: list[float], edge=clamped) -> Column:
    """Weighted sum of neighbours (weights centred), with an edge rule."""
    half = len(weights) // 2

    def at(x: Column, i: Column) -> Column:
        return sum((edge(x, i + (k - half)) * F.lit(w) for k, w in enumerate(weights)), F.lit(0.0))

    return let(samples, lambda x: F.transform(x, lambda _, i: at(x, i)))


def box_mean(samples: Column, width: int) -> Column:
    """Mean of ``width`` neighbours."""
    half = width // 2

    def at(x: Column, i: Column) -> Column:
        return sum((clamped(x, i + k) for k in range(-half, half + 1)), F.lit(0.0)) / F.lit(float(width))

    return let(samples, lambda x: F.transform(x, lambda _, i: at(x, i)))


def gaussian(samples: Column, sigma: float, truncate: float = 4.0) -> Column:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return filtered(samples, [w / sum(raw) for w in raw], reflected)


def gradient(samples: Column) -> Column:
    """Central differences, one-sided at the ends."""

    def at(x: Column, i: Column) -> Column:
        apart = F.when((i == 0) | (i == F.size(x) - 1), 1.0).otherwise(2.0)
        return (clamped(x, i + 1) - clamped(x, i - 1)) / apart

    return let(samples, lambda x: F.transform(x, lambda _, i: F.when(F.size(x) > 1, at(x, i)).otherwise(0.0)))


def first_return(half: Column, smooth: int = 5, rise: float = 0.35, slope: float = 0.05, least: int = 3) -> Column:
    """Offset of the first strong return outward from nadir; null without one."""

    def of(sm: Column) -> Column:
        low, span = F.array_min(sm), F.array_max(sm) - F.array_min(sm)
        rising = F.transform(F.arrays_zip(sm.alias("v"), gradient(sm).alias("g")), lambda x, i: (i >= least) & (x["v"] >= low + rise * span) & (x["g"] >= slope * span))
        place = F.array_position(rising, F.lit(True))
        return F.when((F.size(sm) >= 2) & (span > 0) & (place > 0), (place - 1).cast("double"))

    return let(box_mean(half, smooth), of)


def bottom_offset(samples: Column, **rule) -> Column:
    """Altitude in samples: the mean of the port and starboard first returns that exist (nadir at the middle)."""

    def of(x: Column) -> Column:
        centre = F.floor(F.size(x) / 2).cast("int")
        port = first_return(F.reverse(F.slice(x, F.lit(1), centre)), **rule)
        starboard = first_return(F.slice(x, centre + 1, F.size(x) - centre), **rule)
        found = F.filter(F.array(port, starboard), lambda y: y.isNotNull())
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, y: a + y) / F.size(found))

    return let(samples, of)


def slant_to_ground(samples: Column, altitude: Column, fill: float = 0.0) -> tuple[Column, Column]:
    """Ground-range samples and their validity, by linear interpolation at sqrt(ground^2 + altitude^2)."""

    def place(n: Column, i: Column) -> Column:
        centre = F.floor(n / 2)
        ground = i - centre
        return centre + F.signum(ground) * F.sqrt(ground * ground + altitude * altitude)

    def ok(n: Column, i: Column) -> Column:
        return (place(n, i) >= 0) & (place(n, i) <= n - 1)

    def value(x: Column, i: Column) -> Column:
        at = place(F.size(x), i)
        low = F.floor(at)
        part = at - low
        return F.when(ok(F.size(x), i), clamped(x, low) * (1 - part) + clamped(x, low + 1) * part).otherwise(F.lit(fill))

    return let(samples, lambda x: F.transform(x, lambda _, i: value(x, i))), let(samples, lambda x: F.transform(x, lambda _, i: ok(F.size(x), i)))


def nadir_mask(valid: Column, altitude: Column, pad: int = 2) -> Column:
    """valid without the samples nearer to the middle than altitude + pad."""
    return let(valid, lambda v: F.transform(v, lambda ok, i: ok & (F.abs(i - F.floor(F.size(v) / 2)) >= altitude + pad)))


def masked(samples: Column, valid: Column) -> Column:
    return F.zip_with(samples, valid, lambda x, ok: F.when(ok, x).otherwise(0.0))


def padded(samples: Column, width: Column) -> Column:
    """samples with zeros up to a width."""
    return F.concat(samples, F.array_repeat(F.lit(0).cast("double"), width - F.size(samples)))


def side_by_side(port: Column, starboard: Column, width: Column) -> Column:
    """Port reversed, then starboard: padding ends at the outer edges and nadir is in the middle."""
    return F.concat(F.reverse(padded(port, width)), padded(starboard, width))


def tile_offsets(length: Column, size: int, stride: int) -> Column:
    """Starts of tiles: steps of ``stride`` and a last one flush with the end."""
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), (length - size).cast("int"), F.lit(stride)), F.array((length - size).cast("int")))))
