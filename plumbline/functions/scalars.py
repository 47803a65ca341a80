"""Labels, rounding rules, scores, ids and array arithmetic as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import half_up


def derived_class(value: Column, threshold: float, positive: str, negative: str) -> Column:
    """The positive class from the threshold on."""
    return F.when(value >= threshold, positive).otherwise(negative)


def dead_zone_label(value: Column, low: float, high: float, positive: str, negative: str) -> Column:
    """Negative up to `low`, positive from `high` on, null between."""
    return F.when(value <= low, negative).when(value >= high, positive)


def standardized(x: Column, mean: Column | float, deviation: Column | float) -> Column:
    return (x - mean) / deviation


def linear_score(weights: Sequence[float], features: Column, bias: float) -> Column:
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(w, features, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)


def sigmoid(z: Column) -> Column:
    """The logistic function of z cut to [-60, 60]."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


#: The largest finite double; infinities are cleaned to it as numeric libraries do.
LARGEST = 1.7976931348623157e308


def cleaned(x: Column) -> Column:
    """NaN as 0 and infinities as the largest finite numbers."""
    return F.when(F.isnan(x), 0.0).when(x > LARGEST, LARGEST).when(x < -LARGEST, -LARGEST).otherwise(x)


def strict_number(text: Column) -> Column:
    """The number that a text says, null unless it says a finite one."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) <= LARGEST), number)


def band_edges(edges: Sequence[float]) -> list[tuple[float | None, float | None, str]]:
    """(lower, upper, label) of half-open bands; the outer ones are open."""
    if list(edges) != sorted(set(edges)) or not edges:
        raise ValueError("band edges must increase")
    g = "{:g}".format
    inner = [(a, b, f"[{g(a)},{g(b)})") for a, b in zip(edges, edges[1:])]
    return [(None, edges[0], f"<{g(edges[0])}"), *inner, (edges[-1], None, f">={g(edges[-1])}")]


def band_label(value: Column, edges: Sequence[float]) -> Column:
    """The label of the half-open band that holds the value: comparisons only, no join. A null is in no band."""
    out = None
    for _, upper, label in band_edges(edges):
        if upper is None:
            return out.when(value.isNotNull(), label) if out is not None else F.when(value.isNotNull(), label)
        out = F.when(value < upper, label) if out is None else out.when(value < upper, label)
    raise AssertionError


def published(median: Column, offsets: Sequence[tuple[float | None, int]]) -> Column:
    """The median rounded half up, plus the offset of the first band whose upper bound is above it."""
    value = half_up(median)
    added = F.lit(None)
    for upper, offset in reversed(list(offsets)):
        added = F.lit(offset) if upper is None else F.when(value < upper, offset).otherwise(added)
    return value + F.coalesce(added, F.lit(0))


def published_by_band(median: Column, edges: Sequence[float], levels: dict[str, Column]) -> Column:
    """The value of the level that the band of the rounded median asks for, rounded half up.

    `levels` maps a band's label to the column of its level."""
    band, out = band_label(half_up(median), edges), None
    for label, column in levels.items():
        out = F.when(band == label, column) if out is None else out.when(band == label, column)
    return half_up(out)


def calibrated(lower: Column, median: Column, upper: Column, correction: Column | float) -> tuple[Column, Column]:
    """The interval widened on both sides by the correction, but never past the median."""
    return F.least(lower - correction, median), F.greatest(upper + correction, median)


def wide_interval(lower: Column, upper: Column, mean_width: float) -> Column:
    return upper - lower > 2 * mean_width


def nominal_class(score: Column, positive: str, negative: str) -> Column:
    return derived_class(score, 0.5, positive, negative)


def content_id(text: Column, prefix: str = "") -> Column:
    """A prefix and the first 16 hexadecimal digits of the text's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def safe_name(name: Column) -> Column:
    """Names of one file in one folder."""
    return ~(name.contains("/") | name.isin(".", "..", ""))


RELEASE = r"^([a-z0-9_-]+)\.([a-z0-9_-]+)\.([a-z0-9_-]+)\.([a-z0-9_-]+)\.(v[0-9]+)$"


def release_part(name: Column, part: int) -> Column:
    """One of the five dotted parts of a release name, null if it isn't one."""
    found = F.regexp_extract(name, RELEASE, part)
    return F.when(name.rlike(RELEASE), found)


def runtime_of(name: str) -> str:
    """The runtime that a release name claims: its first three parts."""
    return ".".join(name.split(".")[:3])


def release_module(part: Column) -> Column:
    return F.lower(F.replace(part, F.lit("-"), F.lit("_")))


def grid(start: float, step: float, count: int) -> Column:
    """start, start + step, ... as an array, each from its own number and so without drift."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.lit(start) + F.lit(step) * k)


def radial_basis(distance: Column, low: float, high: float, step: float, gamma: float) -> Column:
    """exp(-gamma (distance - c)^2) for centres from low to high."""
    count = int(math.floor((high - low) / step + 1e-9)) + 1
    return F.transform(grid(low, step, count), lambda c: F.exp(-F.lit(gamma) * (distance - c) * (distance - c)))


def lattice(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> dict[str, Column]:
    """Lengths, angles in degrees, and volume of a cell from its three vectors."""

    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    def cross(u, v):
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])

    def angle(u, v):
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))))))

    return {
        "a": F.sqrt(dot(a, a)), "b": F.sqrt(dot(b, b)), "c": F.sqrt(dot(c, c)),
        "alpha": angle(b, c), "beta": angle(a, c), "gamma": angle(a, b), "volume": F.abs(dot(a, cross(b, c))),
    }


def reciprocal(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> list[list[Column]]:
    """The three reciprocal vectors, with the factor 2 pi."""

    def cross(u, v):
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    volume = sum(x * y for x, y in zip(a, cross(b, c)))
    return [[2 * math.pi * x / volume for x in cross(u, v)] for u, v in ((b, c), (c, a), (a, b))]


def symmetric_eigenvalues(m: Sequence[Sequence[Column]]) -> Column:
    """The three eigenvalues of a symmetric 3x3 matrix as an ascending array, in closed form."""

    def named(value: Column, then) -> Column:
        """`then` of a value that is worked out once: the only element of an array."""
        return F.get(F.transform(F.array(value), then), 0)

    off = m[0][1] * m[0][1] + m[0][2] * m[0][2] + m[1][2] * m[1][2]

    def centred(mean: Column) -> Column:
        d = [m[i][i] - mean for i in range(3)]
        square = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6
        determinant = (
            d[0] * (d[1] * d[2] - m[1][2] * m[1][2]) - m[0][1] * (m[0][1] * d[2] - m[1][2] * m[0][2]) + m[0][2] * (m[0][1] * m[1][2] - d[1] * m[0][2])
        )

        def scaled(p: Column) -> Column:
            r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p == 0, 0.0).otherwise(determinant / (2 * p * p * p))))
            return named(F.acos(r) / 3, lambda phi: F.array_sort(F.array(*(mean + 2 * p * F.cos(phi + 2 * math.pi * k / 3) for k in range(3)))))

        return named(F.sqrt(square), scaled)

    return named((m[0][0] + m[1][1] + m[2][2]) / 3, centred)


def mesh_points(length: Column, spacing: Column | float) -> Column:
    """Points along a reciprocal vector of this length at this spacing: at least one."""
    spacing = F.lit(spacing) if isinstance(spacing, (int, float)) else spacing
    return F.greatest(F.lit(1), F.ceil(F.round(length / spacing, 5)).cast("int"))
