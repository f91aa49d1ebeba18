"""Scalar geometry, affine and classification expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle_difference(a: Column, b: Column) -> Column:
    """Difference of two axial bearings in degrees, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def axial_bearing(dx: Column, dy: Column) -> Column:
    """Bearing of a direction in degrees, 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(180.0))


def pca_bearing(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Bearing of the main axis of a 2 by 2 covariance."""
    return F.pmod(F.degrees(0.5 * F.atan2(2 * sxy, sxx - syy)) + 180.0, F.lit(180.0))


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment, which may be a point itself."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / size))).otherwise(F.lit(0.0))
    return F.hypot(px - x0 - t * dx, py - y0 - t * dy)


def project_on_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance along a segment of the point nearest to (px, py)."""
    dx, dy = x1 - x0, y1 - y0
    size = F.hypot(dx, dy)
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(size, ((px - x0) * dx + (py - y0) * dy) / size))).otherwise(F.lit(0.0))


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Unsigned angle between two directions; null if either has no length."""
    sizes = F.hypot(ax, ay) * F.hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / sizes))
    return F.when(sizes > 0, F.degrees(F.acos(cosine)))


def signed_turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle from one direction to the next, in radians."""
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a position: 326zz north, 327zz south of the equator."""
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def pixel_to_world(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """World position of a pixel's centre."""
    u, v = col + 0.5, row + 0.5
    return a * u + b * v + c, d * u + e * v + f


def world_to_pixel(x: Column, y: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a world position."""
    det = a * e - b * d
    u, v = (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det
    return F.floor(v).cast("int"), F.floor(u).cast("int")


def ground_sample_distance(a: float, b: float, d: float, e: float) -> float:
    """Side of a square of a pixel's area."""
    return abs(a * e - b * d) ** 0.5


def quality_flag(p: Column) -> Column:
    """Class of a mean probability."""
    return F.when(p.isNull() | F.isnan(p), "unknown").when(p >= 0.7, "high").when(p >= 0.5, "medium").otherwise("low")


def is_true(c: Column) -> Column:
    """Only an explicit true or 1; a null or NaN is not."""
    return F.coalesce(c.cast("double") == 1.0, F.lit(False))


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (3.0 - 2.0 * u)


def contract_id(prefix: str, place: Column) -> Column:
    """prefix_000000, by a place counted from 0."""
    return F.format_string(f"{prefix}_%06d", place)


def normalise_name(name: Column) -> Column:
    """A base name of letters, digits, hyphens and underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_"), r"^_+|_+$", "")


def refinement_source(*flags: tuple[str, Column]) -> Column:
    """original with no flag set, the flag's name with one, mixed with more."""
    set_ = F.filter(F.array(*[F.when(is_true(c), F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())
    return F.when(F.size(set_) == 0, "original").when(F.size(set_) == 1, set_[0]).otherwise("mixed")
