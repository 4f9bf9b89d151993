"""SE(3) arithmetic. Poses are six scalar columns, so everything is code-generated by Spark;
only the generic representation change is an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GIMBAL_EPS = 1e-6
Matrix = list[list[Column]]


def rpy_to_matrix(roll: Column, pitch: Column, yaw: Column) -> Matrix:
    """Rz(yaw) Ry(pitch) Rx(roll) as nine scalar columns."""
    return matrix_from_trig(*[f(x) for x in (roll, pitch, yaw) for f in (F.sin, F.cos)])


def matrix_from_trig(sr, cr, sp, cp, sy, cy) -> Matrix:
    """The same from sine and cosine of each angle."""
    rz = [[cy, -sy, F.lit(0.0)], [sy, cy, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    # Ry @ Rx written out once: its rows are short, the product with Rz is generic
    ryx = [[cp, sp * sr, sp * cr], [F.lit(0.0), cr, -sr], [-sp, cp * sr, cp * cr]]
    return matmul(rz, ryx)


def matrix_to_rpy(m: Matrix) -> list[Column]:
    """Roll, pitch, yaw; yaw is 0 when the pitch is at +-90 degrees."""
    sin_pitch = F.greatest(F.least(-m[2][0], F.lit(1.0)), F.lit(-1.0))
    pitch = F.asin(sin_pitch)
    locked = F.abs(F.cos(pitch)) < GIMBAL_EPS
    roll = F.when(locked, F.atan2(-m[0][1], m[1][1])).otherwise(F.atan2(m[2][1], m[2][2]))
    yaw = F.when(locked, F.lit(0.0)).otherwise(F.atan2(m[1][0], m[0][0]))
    return [roll, pitch, yaw]


def transpose(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m)]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [
        [a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)]
        for i in range(3)
    ]


def matvec(a: Matrix, v: Sequence[Column]) -> list[Column]:
    return [a[i][0] * v[0] + a[i][1] * v[1] + a[i][2] * v[2] for i in range(3)]


def invert_pose(rot: Matrix, pos: Sequence[Column]) -> tuple[Matrix, list[Column]]:
    """Inverse of a rigid transform: transposed rotation, back-rotated translation."""
    rt = transpose(rot)
    return rt, [-x for x in matvec(rt, pos)]


def relative_pose(prev: Sequence[Column], cur: Sequence[Column]) -> list[Column]:
    """``prev^-1 * cur`` of two xyz+rpy poses, again as xyz+rpy.

    A common left factor (alignment to the first frame) cancels in this product.
    """
    rot_p, rot_c = rpy_to_matrix(*prev[3:6]), rpy_to_matrix(*cur[3:6])
    inv = transpose(rot_p)
    shift = matvec(inv, [c - p for c, p in zip(cur[:3], prev[:3])])
    return [*shift, *matrix_to_rpy(matmul(inv, rot_c))]


# ---- Arrow-batched helpers for representation changes -------------------------------------


def _axis_matrix(axis: str, a: np.ndarray) -> np.ndarray:
    s, c = np.sin(a), np.cos(a)
    out = np.zeros((len(a), 3, 3))
    i = "XYZ".index(axis)
    j, k = (i + 1) % 3, (i + 2) % 3
    out[:, i, i] = 1.0
    out[:, j, j], out[:, k, k] = c, c
    out[:, k, j], out[:, j, k] = s, -s
    return out


def _euler_to(x: np.ndarray, order: str) -> np.ndarray:
    m = _axis_matrix(order[0], x[:, 0])
    for pos in (1, 2):
        m = m @ _axis_matrix(order[pos], x[:, pos])
    return m


def _to_euler(m: np.ndarray, order: str) -> np.ndarray:
    """Tait-Bryan angles of an intrinsic order with three different axes."""
    i, j, k = ("XYZ".index(a) for a in order)
    sign = 1.0 if (j - i) % 3 == 1 else -1.0
    mid = np.arcsin(np.clip(sign * m[:, i, k], -1.0, 1.0))
    first = np.arctan2(-sign * m[:, j, k], m[:, k, k])
    last = np.arctan2(-sign * m[:, i, j], m[:, i, i])
    return np.stack([first, mid, last], axis=1)


def _axis_angle_to(x: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        # sin(a)/a and (1-cos(a))/a^2 with their limits at zero
        f = np.where(angle < 1e-8, 1.0, np.sin(angle) / angle)
        g = np.where(angle < 1e-8, 0.5, (1 - np.cos(angle)) / angle**2)
    k = np.zeros((len(x), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -x[:, 2], x[:, 1], -x[:, 0]
    k = k - np.transpose(k, (0, 2, 1))
    return np.eye(3) + f[:, None, None] * k + g[:, None, None] * (k @ k)


def _quaternion_to(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    w, v = q[:, 0], q[:, 1:]
    k = np.zeros((len(q), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k = k - np.transpose(k, (0, 2, 1))
    return np.eye(3) + 2 * w[:, None, None] * k + 2 * (k @ k)


def _to_quaternion(m: np.ndarray) -> np.ndarray:
    """Real-first unit quaternion from the largest eigenvector of the symmetric 4x4 form."""
    n = len(m)
    k = np.zeros((n, 4, 4))
    k[:, 0, 0] = m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2]
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        k[:, 0, a + 1] = k[:, a + 1, 0] = m[:, c, b] - m[:, b, c]
        k[:, a + 1, a + 1] = m[:, a, a] - m[:, b, b] - m[:, c, c]
        k[:, a + 1, b + 1] = k[:, b + 1, a + 1] = m[:, a, b] + m[:, b, a]
    _, vectors = np.linalg.eigh(k)
    q = vectors[:, :, -1]
    return q * np.where(q[:, :1] < 0, -1.0, 1.0)


def _to_axis_angle(m: np.ndarray) -> np.ndarray:
    q = _to_quaternion(m)
    s = np.linalg.norm(q[:, 1:], axis=1)
    angle = 2 * np.arctan2(s, q[:, 0])
    ratio = np.where(s < 1e-12, 2.0, angle / np.where(s < 1e-12, 1.0, s))
    return q[:, 1:] * ratio[:, None]


def _six_to(x: np.ndarray) -> np.ndarray:
    a = x[:, :3] / np.linalg.norm(x[:, :3], axis=1, keepdims=True)
    b = x[:, 3:] - np.sum(a * x[:, 3:], axis=1, keepdims=True) * a
    b = b / np.linalg.norm(b, axis=1, keepdims=True)
    return np.stack([a, b, np.cross(a, b)], axis=1)


REPRESENTATIONS = ("axis_angle", "euler_angles", "quaternion", "rotation_6d", "matrix")


def _parse(rep: str) -> tuple[str, str]:
    if rep.startswith("euler_angles"):
        tail = rep.rsplit("_", 1)[-1]
        return "euler_angles", tail.replace("r", "X").replace("p", "Y").replace("y", "Z")
    if rep not in REPRESENTATIONS:
        raise ValueError(f"unknown rotation representation: {rep}")
    return rep, ""


def convert_rotation(v: Column, source: str, target: str) -> Column:
    """Change of representation via the matrix form, e.g. ``euler_angles_rpy`` to ``quaternion``."""
    (src, src_order), (dst, dst_order) = _parse(source), _parse(target)
    if src == dst:
        raise ValueError("source and target representation are the same")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def convert(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(col.to_numpy()).astype(float)
        m = {
            "axis_angle": _axis_angle_to,
            "euler_angles": lambda a: _euler_to(a, src_order),
            "quaternion": _quaternion_to,
            "rotation_6d": _six_to,
            "matrix": lambda a: a.reshape(-1, 3, 3),
        }[src](x)
        out = {
            "axis_angle": _to_axis_angle,
            "euler_angles": lambda a: _to_euler(a, dst_order),
            "quaternion": _to_quaternion,
            "rotation_6d": lambda a: a[:, :2, :].reshape(-1, 6),
            "matrix": lambda a: a.reshape(-1, 9),
        }[dst](m)
        return pd.Series(list(out))

    return convert(v)


def project_point(fx, fy, cx, cy, x: Column, y: Column, z: Column, eps: float = 1e-6):
    """3-D point to pixel; a depth close to zero is replaced by ``eps`` with the sign of z."""
    depth = F.when(F.abs(z) < eps, F.when(z >= 0, F.lit(eps)).otherwise(F.lit(-eps))).otherwise(z)
    return fx * x / depth + cx, fy * y / depth + cy


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes given as x1, y1, x2, y2."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
