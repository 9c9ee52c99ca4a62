"""Column expressions for coordinates, boxes, grids and small vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXTENT_EPS = 1e-5


def struct3(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def bind_axes(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Scanner axes to model axes: (x, -z, y)."""
    return x, -z, y


def to_unit(p: Column, bmin: Column, blen: Column, scale: float = 1.0, shift: float = 0.0) -> Column:
    """World to [-1, 1] with one isotropic scale."""
    return ((p - bmin) * F.lit(scale) / (blen + F.lit(EXTENT_EPS))) * 2 - 1 + F.lit(shift)


def from_unit(p: Column, bmin: Column, blen: Column) -> Column:
    """[-1, 1] to world.  Carries no epsilon, so it is not the exact inverse of :func:`to_unit`."""
    return (p + 1) * 0.5 * blen + bmin


def marching_to_world(v: Column, res: int, bmin: Column, blen: Column) -> Column:
    """Iso-surface vertex in cell units to world."""
    return v / F.lit(res - 1) * blen + bmin


def voxel_index(p: Column, grid: int) -> Column:
    """Cell of a [-1, 1] coordinate, truncated toward zero."""
    return ((p + 1) / F.lit(2.0 / grid + EXTENT_EPS)).cast("int")


def voxel_center(i: Column, grid: int) -> Column:
    return i / F.lit((grid - 1) / 2) - 1


def grid_line(g: Column, grid: int) -> Column:
    """Value ``g`` of ``grid`` evenly spaced coordinates from -1 to 1."""
    return F.lit(-1.0) + g * F.lit(2.0 / (grid - 1))


def dist2(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return dx * dx + dy * dy + dz * dz


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def unit3(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Direction with a 1e-10 guard on the length."""
    n = norm3(x, y, z) + F.lit(1e-10)
    return x / n, y / n, z / n


def cross3(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot3(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return (F.lit(1.0) - t) * a + t * b


def apply_affine(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Row-major 3x4 affine (array of 12, or the first 12 of 16) applied to (x, y, z, 1)."""
    row = lambda r: m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3]
    return row(0), row(1), row(2)


def auto_bone_count(n: Column) -> Column:
    """Two bones at least, ten at most, one per fifty vertices."""
    return F.least(F.greatest(F.lit(2).cast("long"), F.floor(n / 50)), F.lit(10).cast("long"))


def binarize(p: Column) -> Column:
    return F.when(p >= 0.5, 1).otherwise(0)


def softplus(x: Column) -> Column:
    """log(1 + e^x), written so a large x does not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def gauss(d2: Column, sigma: float) -> Column:
    return F.exp(-d2 / F.lit(2.0 * sigma * sigma))


def cosine3(a, b, eps: float = 1e-6) -> Column:
    """Cosine of two vectors; the product of the lengths is kept at or above ``eps``."""
    lengths = norm3(*a) * norm3(*b)
    return dot3(a, b) / F.greatest(lengths, F.lit(eps))


def normal_kl(m1: Column, raw1: Column, m2: Column, raw2: Column) -> Column:
    """KL(N1 || N2) of two normals whose deviations are softplus(raw) + 1e-4."""
    s1, s2 = softplus(raw1) + F.lit(1e-4), softplus(raw2) + F.lit(1e-4)
    return F.log(s2 / s1) + (s1 * s1 + (m1 - m2) * (m1 - m2)) / (2 * s2 * s2) - 0.5


def hash_unit(*cols: Column) -> Column:
    """Repeatable uniform number in [0, 1) from a row's ids."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


# Display colour of bone k is entry k mod 10.
PALETTE = [
    (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0),
    (0.0, 1.0, 1.0), (1.0, 0.5, 0.0), (0.5, 0.0, 1.0), (0.5, 1.0, 0.0), (0.0, 0.5, 1.0),
]


def palette_channel(k: Column, channel: int) -> Column:
    values = F.array(*[F.lit(c[channel]) for c in PALETTE])
    return F.get(values, F.pmod(k, F.lit(len(PALETTE))).cast("int"))
