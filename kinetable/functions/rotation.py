"""Rotations as array columns: 9 = row-major 3x3 matrix, 6 = two raw axes, 4 = quaternion (x, y, z, w).

``add_*`` functions stage their shared parts as columns, so each part is computed once per row instead of being
repeated inside one deep expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .space import cross3, unit3

IDENTITY_Q = (0.0, 0.0, 0.0, 1.0)


def add_rot6d_matrix(df: DataFrame, p: str, out: str) -> DataFrame:
    """First axis from p[0:3], third normal to both inputs, second completes the frame; axes are columns."""
    c = F.col
    x = unit3(c(p)[0], c(p)[1], c(p)[2])
    df = df.withColumns({f"_x{i}": x[i] for i in range(3)})
    n = cross3([c(f"_x{i}") for i in range(3)], [c(p)[3], c(p)[4], c(p)[5]])
    df = df.withColumns({f"_n{i}": n[i] for i in range(3)})
    z = unit3(c("_n0"), c("_n1"), c("_n2"))
    df = df.withColumns({f"_z{i}": z[i] for i in range(3)})
    y = cross3([c(f"_z{i}") for i in range(3)], [c(f"_x{i}") for i in range(3)])
    df = df.withColumns({f"_y{i}": y[i] for i in range(3)})
    m = F.array(*[c(f"_{axis}{r}") for r in range(3) for axis in "xyz"])
    return df.withColumn(out, m).drop(*[f"_{a}{i}" for a in "xyzn" for i in range(3)])


def matmul3(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c]
                     for r in range(3) for c in range(3)])


def matvec3(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    row = lambda r: m[3 * r] * x + m[3 * r + 1] * y + m[3 * r + 2] * z
    return row(0), row(1), row(2)


def det3(m: Column, stride: int = 3) -> Column:
    e = lambda r, c: m[stride * r + c]
    return (e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1))
            - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0))
            + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0)))


def add_quat(df: DataFrame, m: str, out: str, stride: int = 3) -> DataFrame:
    """Unit quaternion of the rotation in ``m`` with w >= 0; a matrix without positive determinant is no
    rotation and gives the identity.  ``stride`` is 3 for 3x3 and 4 for 3x4 or 4x4 arrays."""
    e = lambda r, c: F.col(m)[stride * r + c]
    # 1 + signed diagonal sums are four times the square of each component; the largest one is divided by
    df = df.withColumns({
        "_fx": 1 + e(0, 0) - e(1, 1) - e(2, 2), "_fy": 1 - e(0, 0) + e(1, 1) - e(2, 2),
        "_fz": 1 - e(0, 0) - e(1, 1) + e(2, 2), "_fw": 1 + e(0, 0) + e(1, 1) + e(2, 2),
    })
    df = df.withColumn("_big", F.greatest("_fx", "_fy", "_fz", "_fw"))
    df = df.withColumn("_s", F.sqrt(F.greatest(F.col("_big"), F.lit(1e-300))) * 2)
    s, big = F.col("_s"), F.col("_big")
    df = df.withColumn("_raw", (
        F.when(F.col("_fw") == big,
               F.array((e(2, 1) - e(1, 2)) / s, (e(0, 2) - e(2, 0)) / s, (e(1, 0) - e(0, 1)) / s, s / 4))
        .when(F.col("_fx") == big,
              F.array(s / 4, (e(0, 1) + e(1, 0)) / s, (e(0, 2) + e(2, 0)) / s, (e(2, 1) - e(1, 2)) / s))
        .when(F.col("_fy") == big,
              F.array((e(0, 1) + e(1, 0)) / s, s / 4, (e(1, 2) + e(2, 1)) / s, (e(0, 2) - e(2, 0)) / s))
        .otherwise(F.array((e(0, 2) + e(2, 0)) / s, (e(1, 2) + e(2, 1)) / s, s / 4, (e(1, 0) - e(0, 1)) / s))
    ))
    raw = F.col("_raw")
    length = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2] + raw[3] * raw[3])
    df = df.withColumn("_n", F.when(raw[3] < 0, -length).otherwise(length))
    quat = F.array(*[raw[i] / F.col("_n") for i in range(4)])
    identity = F.array(*[F.lit(v) for v in IDENTITY_Q])
    return df.withColumn(out, F.when(det3(F.col(m), stride) > 0, quat).otherwise(identity)).drop(
        "_fx", "_fy", "_fz", "_fw", "_big", "_s", "_raw", "_n")


def quat_to_matrix(q: Column) -> Column:
    x, y, z, w = (q[i] for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def quat_dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]


def _add_unit(df: DataFrame, raw: str, out: str) -> DataFrame:
    q = F.col(raw)
    df = df.withColumn("_len", F.sqrt(quat_dot(q, q)))
    return df.withColumn(out, F.array(*[q[i] / F.col("_len") for i in range(4)])).drop("_len")


def add_nlerp(df: DataFrame, a: str, b: str, t: str, out: str) -> DataFrame:
    """Blend and renormalise, without turning ``b`` into the hemisphere of ``a``."""
    qa, qb, s = F.col(a), F.col(b), F.col(t)
    df = df.withColumn("_mix", F.array(*[(F.lit(1.0) - s) * qa[i] + s * qb[i] for i in range(4)]))
    return _add_unit(df, "_mix", out).drop("_mix")


def add_slerp(df: DataFrame, a: str, b: str, t: str, out: str) -> DataFrame:
    """Great-arc interpolation on the shorter side; inputs with a dot product above 0.9995 are blended."""
    qa, qb, s = F.col(a), F.col(b), F.col(t)
    df = df.withColumn("_d0", quat_dot(qa, qb))
    df = df.withColumn("_flip", F.when(F.col("_d0") < 0, -1.0).otherwise(1.0))
    df = df.withColumn("_d", F.least(F.abs("_d0"), F.lit(1.0)))
    near = F.col("_d") > 0.9995
    df = df.withColumn("_om", F.when(near, F.lit(None)).otherwise(F.acos("_d")))
    so = F.sin("_om")
    df = df.withColumn("_ca", F.when(near, F.lit(1.0) - s).otherwise(F.sin((F.lit(1.0) - s) * F.col("_om")) / so))
    df = df.withColumn("_cb", F.when(near, s).otherwise(F.sin(s * F.col("_om")) / so))
    df = df.withColumn("_mix", F.array(
        *[F.col("_ca") * qa[i] + F.col("_cb") * (qb[i] * F.col("_flip")) for i in range(4)]))
    df = df.withColumn("_len", F.when(near, F.sqrt(quat_dot(F.col("_mix"), F.col("_mix")))).otherwise(1.0))
    return df.withColumn(out, F.array(*[F.col("_mix")[i] / F.col("_len") for i in range(4)])).drop(
        "_d0", "_flip", "_d", "_om", "_ca", "_cb", "_mix", "_len")


def compose(r: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """3x3 rotation and translation to a row-major 3x4 affine."""
    t = (tx, ty, tz)
    return F.array(*[r[3 * i + j] if j < 3 else t[i] for i in range(3) for j in range(4)])


def rotation_of(m: Column) -> Column:
    """3x3 part of a row-major 3x4 affine."""
    return F.array(*[m[4 * i + j] for i in range(3) for j in range(3)])


def rotvec_to_matrix(x: Column, y: Column, z: Column) -> Column:
    """Rodrigues' formula; a zero vector is the identity."""
    a2 = x * x + y * y + z * z
    a = F.sqrt(a2)
    small = a < 1e-12
    s = F.when(small, 1.0).otherwise(F.sin(a) / a)
    c = F.when(small, 0.5).otherwise((1 - F.cos(a)) / a2)
    return F.array(
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    )


def add_yaw_matrix(df: DataFrame, x: str, y: str, z: str, out: str) -> DataFrame:
    """Inverse of the y rotation found when a rotation vector is read as fixed-axis x, y, z angles."""
    df = df.withColumn("_m", rotvec_to_matrix(F.col(x), F.col(y), F.col(z)))
    df = df.withColumn("_yaw", F.asin(F.least(F.greatest(-F.col("_m")[6], F.lit(-1.0)), F.lit(1.0))))
    df = df.withColumns({"_c": F.cos("_yaw"), "_s": F.sin("_yaw")})
    c, s, zero, one = F.col("_c"), F.col("_s"), F.lit(0.0), F.lit(1.0)
    return df.withColumn(out, F.array(c, zero, -s, zero, one, zero, s, zero, c)).drop("_m", "_yaw", "_c", "_s")
