"""Geodesy and kinematics as Column expressions; angles in degrees and distances in metres unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the batch pipeline, equatorial radius of the live client, and two gravities.
RADIUS_MEAN, RADIUS_EQUATOR = 6371000.0, 6378137.0
GRAVITY_STANDARD, GRAVITY_LIVE = 9.80665, 9.81
#: Degrees of a road cell, and of a snap bucket.
CELL_DEGREES, BUCKET_DEGREES = 0.025, 0.001


def number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS_EQUATOR) -> Column:
    """Great-circle distance."""
    half_lat, half_lng = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def east(lng: Column, lat0: Column, lng0: Column, radius: float = RADIUS_MEAN) -> Column:
    """Metres east of a reference point (equirectangular, cosine of the reference latitude)."""
    return radius * F.radians(lng - lng0) * F.cos(F.radians(lat0))


def north(lat: Column, lat0: Column, radius: float = RADIUS_MEAN) -> Column:
    return radius * F.radians(lat - lat0)


def latitude_at(north_m: Column, lat0: Column, radius: float = RADIUS_MEAN) -> Column:
    return lat0 + F.degrees(north_m / radius)


def longitude_at(east_m: Column, lat0: Column, lng0: Column, radius: float = RADIUS_MEAN) -> Column:
    return lng0 + F.degrees(east_m / (radius * F.cos(F.radians(lat0))))


def bearing_radians(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, in (-pi, pi]."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounding with halves toward plus infinity."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5).cast("double") / scale


def bearing_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Bearing in [0, 360] with one decimal; 0 where both differences are below 1e-7 degrees."""
    still = (F.abs(lat2 - lat1) < 1e-7) & (F.abs(lng2 - lng1) < 1e-7)
    return F.when(still, F.lit(0.0)).otherwise(half_up(normalised_degrees(F.degrees(bearing_radians(lat1, lng1, lat2, lng2))), 1))


def destination(lat: Column, lng: Column, distance: Column, bearing: Column, radius: float = RADIUS_EQUATOR) -> tuple[Column, Column]:
    """(lat, lng) after `distance` in direction `bearing` (radians)."""
    d, a = distance / radius, F.radians(lat)
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(bearing))
    return F.degrees(to), lng + F.degrees(F.atan2(F.sin(bearing) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to)))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, degenerate: float = 0.0) -> Column:
    """Share of the segment a-b at which p's projection lies, in [0, 1]; 0 for a segment whose squared length is at most `degenerate`."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    return F.when(length <= degenerate, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, length))))


def project(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column, scaled: bool = True) -> tuple[Column, Column, Column]:
    """(share, lat, lng) of the point of a segment nearest to a point.

    In degrees; `scaled` weighs longitude by the cosine of the point's latitude, else both count alike.
    """
    c = F.cos(F.radians(lat)) if scaled else F.lit(1.0)
    share = along_segment(lng * c, lat, lng1 * c, lat1, lng2 * c, lat2)
    return share, lat1 + share * (lat2 - lat1), lng1 + share * (lng2 - lng1)


def project_metres(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS_MEAN) -> tuple[Column, Column, Column]:
    """(share, distance, length) with both in metres on the plane that touches at the point."""
    ax, ay, bx, by = east(lng1, lat, lng, radius), north(lat1, lat, radius), east(lng2, lat, lng, radius), north(lat2, lat, radius)
    zero = F.lit(0.0)
    share = along_segment(zero, zero, ax, ay, bx, by, 1e-12)
    return share, F.hypot(ax + share * (bx - ax), ay + share * (by - ay)), F.hypot(bx - ax, by - ay)


def velocity_east(speed: Column, heading: Column) -> Column:
    return speed * F.sin(F.radians(heading))


def velocity_north(speed: Column, heading: Column) -> Column:
    return speed * F.cos(F.radians(heading))


def body_to_east(ax: Column, ay: Column, yaw: Column) -> Column:
    return ay * F.sin(F.radians(yaw)) + ax * F.cos(F.radians(yaw))


def body_to_north(ax: Column, ay: Column, yaw: Column) -> Column:
    return ay * F.cos(F.radians(yaw)) - ax * F.sin(F.radians(yaw))


def rotation_matrix(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Body to navigation frame, row by row as one array of nine; angles in radians, order yaw-pitch-roll."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """A normalised quaternion; the identity for one of no length."""
    size = F.sqrt(w * w + x * x + y * y + z * z)
    parts = (("w", w, 1.0), ("x", x, 0.0), ("y", y, 0.0), ("z", z, 0.0))
    return F.struct(*(F.when(size < 1e-12, F.lit(none)).otherwise(F.try_divide(part, size)).alias(name) for name, part, none in parts))


def quaternion_product(a: Column, b: Column) -> Column:
    aw, ax, ay, az = (a[n] for n in "wxyz")
    bw, bx, by, bz = (b[n] for n in "wxyz")
    return F.struct(
        (aw * bw - ax * bx - ay * by - az * bz).alias("w"),
        (aw * bx + ax * bw + ay * bz - az * by).alias("x"),
        (aw * by - ax * bz + ay * bw + az * bx).alias("y"),
        (aw * bz + ax * by - ay * bx + az * bw).alias("z"),
    )


def quaternion_of_rates(gx: Column, gy: Column, gz: Column, dt: Column | float) -> Column:
    """The turn by angular rates (rad/s) over `dt` seconds, to first order in the half angle, normalised."""
    half = number(dt) / 2
    return quaternion(F.lit(1.0), gx * half, gy * half, gz * half)


def quaternion_matrix(q: Column) -> Column:
    """Rotation matrix of a unit quaternion, as an array of nine."""
    w, x, y, z = (q[n] for n in "wxyz")
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def normalised_degrees(angle: Column) -> Column:
    """In [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def wrapped_radians(angle: Column) -> Column:
    """In [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def smoothed_heading(old: Column, new: Column, alpha: float) -> Column:
    """A step of size `alpha` from one heading to another along the shorter arc."""
    turn = normalised_degrees(new - old)
    return normalised_degrees(old + alpha * F.when(turn > 180, turn - 360).otherwise(turn))


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def finite_or_zero(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def z_scores(values: Column, means: Column, deviations: Column) -> Column:
    """Arrays: (value - mean) / deviation, element by element."""
    return F.zip_with(F.zip_with(values, means, lambda v, m: v - m), deviations, lambda v, d: v / d)


def from_z_scores(scores: Column, means: Column, deviations: Column) -> Column:
    return F.zip_with(F.zip_with(scores, deviations, lambda s, d: s * d), means, lambda s, m: s + m)


def correction_size(scores: Column) -> Column:
    """A third of the length of a normalised correction, at most 1; it grows with the correction and is no probability."""
    return F.least(F.lit(1.0), F.sqrt(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s * s)) / 3)


def cell_index(degrees: Column, size: float = CELL_DEGREES) -> Column:
    return F.floor(degrees.cast("double") / F.lit(size))


def cell_key(lat: Column, lng: Column) -> Column:
    return F.concat_ws("_", cell_index(lat).cast("string"), cell_index(lng).cast("string"))


def neighbourhood(lat: Column, lng: Column, size: float = CELL_DEGREES) -> Column:
    """The nine cells around a point, as an array of (row, column)."""
    near = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return F.transform(near, lambda n: F.struct((cell_index(lat, size) + n["a"]).alias("row"), (cell_index(lng, size) + n["b"]).alias("column")))


def valid_position(lat: Column, lng: Column) -> Column:
    """Finite and in range; false for null."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def valid_route_point(lat: Column, lng: Column) -> Column:
    """Valid and not the origin."""
    return valid_position(lat, lng) & ~((lat == 0) & (lng == 0))


def usable_fix(lat: Column, accuracy: Column) -> Column:
    """Accuracy, clipped to [1, 100], below 50 m and a latitude away from 0."""
    return F.coalesce((F.least(F.lit(100.0), F.greatest(F.lit(1.0), accuracy)) < 50) & (F.abs(lat) > 0.1), F.lit(False))


def text_seed(name: Column, modulus: int = 1_000_000) -> Column:
    """md5 of a text as a number, modulo `modulus`; taken in chunks since 128 bits do not fit a long."""
    digest = F.md5(name.cast("binary"))
    seed = F.lit(0).cast("long")
    for at in range(1, 33, 8):
        seed = (seed * ((1 << 32) % modulus) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % modulus
    return seed
