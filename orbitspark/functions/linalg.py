"""3-vectors and 3x3 matrices as tuples of columns (row-major)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = tuple[Vec, Vec, Vec]


def step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds (or replaces) columns that later ones may use any number of times.

    Plain columns are folded into those that use them, so a chain of formulas that each use the last one
    twice doubles with every link. A row generator of one row stands between: what is before it is computed once.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def named(names: str, values) -> dict[str, Column]:
    """Columns of a vector or a flat list under names that are separated by spaces."""
    return dict(zip(names.split(), values, strict=True))


def lit3(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def mat(names: list[str]) -> Mat:
    c = [F.col(n) for n in names]
    return (c[0], c[1], c[2]), (c[3], c[4], c[5]), (c[6], c[7], c[8])


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """The vector over its length; null for a zero vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return a[0] / n, a[1] / n, a[2] / n


def matvec(m: Mat, v: Vec) -> Vec:
    return tuple(dot(row, v) for row in m)


def transpose(m: Mat) -> Mat:
    return tuple(zip(*m))


def matmul(a: Mat, b: Mat) -> Mat:
    cols = transpose(b)
    return tuple(tuple(dot(row, c) for c in cols) for row in a)


def det(m: Mat) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def solve(m: Mat, b: Vec) -> Vec:
    """Cramer's rule; null for a singular matrix."""
    d = F.nullif(det(m), F.lit(0.0))
    cols = transpose(m)
    return det(transpose((b, cols[1], cols[2]))) / d, det(transpose((cols[0], b, cols[2]))) / d, det(transpose((cols[0], cols[1], b))) / d


def across(u: Vec) -> Vec:
    """The axis on which a vector has its smallest component, so that the two are far from parallel."""
    a, b, c = (F.abs(x) for x in u)
    first, second = (a <= b) & (a <= c), (b < a) & (b <= c)
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    return one(first), one(second), one(~first & ~second)


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Mat:
    """Rotation of a quaternion, normalised first; null for a zero or non-finite one."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    n = F.when((n > 0) & (n < float("inf")), n)
    w, x, y, z = w / n, x / n, y / n, z / n
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def matrix_to_quaternion(m: Mat) -> tuple[Column, Column, Column, Column]:
    """Quaternion (w, x, y, z) with w >= 0, divided by the largest of its parts for stability."""
    (a, b, c), (d, e, f), (g, h, i) = m
    trace = a + e + i
    s0, s1 = 2 * F.sqrt(F.greatest(trace + 1, F.lit(0.0))), 2 * F.sqrt(F.greatest(1 + a - e - i, F.lit(0.0)))
    s2, s3 = 2 * F.sqrt(F.greatest(1 + e - a - i, F.lit(0.0))), 2 * F.sqrt(F.greatest(1 + i - a - e, F.lit(0.0)))
    n0, n1, n2, n3 = (F.nullif(s, F.lit(0.0)) for s in (s0, s1, s2, s3))
    cases = (
        (trace > 0, (s0 / 4, (h - f) / n0, (c - g) / n0, (d - b) / n0)),
        ((a > e) & (a > i), ((h - f) / n1, s1 / 4, (b + d) / n1, (c + g) / n1)),
        (e > i, ((c - g) / n2, (b + d) / n2, s2 / 4, (f + h) / n2)),
    )
    rest = ((d - b) / n3, (c + g) / n3, (f + h) / n3, s3 / 4)
    q = []
    for k in range(4):
        x = F.lit(None)
        for test, parts in cases:
            x = F.when(test, parts[k]) if k >= 0 and test is cases[0][0] else x.when(test, parts[k])
        q.append(x.otherwise(rest[k]))
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return tuple(x * sign for x in q)


def with_eigenvalues(df: DataFrame, entries: list[str], out: list[str]) -> DataFrame:
    """Adds the eigenvalues of the symmetric matrix of six columns (11, 12, 13, 22, 23, 33), largest first, by the trigonometric roots of its cubic."""
    a11, a12, a13, a22, a23, a33 = (F.col(c) for c in entries)
    q, p = F.col("_q"), F.col("_p")
    df = step(df, {"_q": (a11 + a22 + a33) / 3})
    df = step(df, {"_p": F.sqrt(((a11 - q) * (a11 - q) + (a22 - q) * (a22 - q) + (a33 - q) * (a33 - q) + 2 * (a12 * a12 + a13 * a13 + a23 * a23)) / 6)})
    d = F.nullif(p, F.lit(0.0))
    df = step(df, named("_b0 _b1 _b2 _b3 _b4 _b5", ((a11 - q) / d, a12 / d, a13 / d, (a22 - q) / d, a23 / d, (a33 - q) / d)))
    b = [F.col(f"_b{i}") for i in range(6)]
    half = F.coalesce(det(((b[0], b[1], b[2]), (b[1], b[3], b[4]), (b[2], b[4], b[5]))) / 2, F.lit(1.0))
    df = step(df, {"_phi": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3})
    df = step(df, {out[0]: q + 2 * p * F.cos("_phi"), out[2]: q + 2 * p * F.cos(F.col("_phi") + F.lit(2.0943951023931953))})
    df = df.withColumn(out[1], 3 * q - F.col(out[0]) - F.col(out[2]))
    return df.drop("_q", "_p", "_phi", *(f"_b{i}" for i in range(6)))


def with_null_vector(df: DataFrame, entries: list[str], low: str, out: list[str]) -> DataFrame:
    """Adds the unit eigenvector of the eigenvalue ``low``: the longest cross product of two rows of the matrix less that value."""
    a11, a12, a13, a22, a23, a33 = (F.col(c) for c in entries)
    e = F.col(low)
    rows = (a11 - e, a12, a13), (a12, a22 - e, a23), (a13, a23, a33 - e)
    pairs = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    df = step(df, {f"_v{i}{j}": x for i, v in enumerate(pairs) for j, x in enumerate(v)})
    sides = [vec(*(f"_v{i}{j}" for j in range(3))) for i in range(3)]
    df = step(df, {f"_w{i}": dot(v, v) for i, v in enumerate(sides)})
    w = [F.col(f"_w{i}") for i in range(3)]
    longest = [F.when((w[0] >= w[1]) & (w[0] >= w[2]), sides[0][j]).when(w[1] >= w[2], sides[1][j]).otherwise(sides[2][j]) for j in range(3)]
    df = step(df, named("_l0 _l1 _l2", longest))
    df = step(df, dict(zip(out, unit(vec("_l0", "_l1", "_l2")))))
    return df.drop(*(f"_v{i}{j}" for i in range(3) for j in range(3)), *(f"_{c}{i}" for c in "wl" for i in range(3)))


def with_rotation(df: DataFrame, u: list[str], v: Vec, out: list[str]) -> DataFrame:
    """Adds the nine entries of the smallest rotation of the unit vector ``u`` (columns) onto ``v``; half a turn for opposite ones."""
    here = vec(*u)
    df = step(df, {"_c": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(here, v)))} | named("_k0 _k1 _k2", cross(here, v)) | named("_h0 _h1 _h2", across(here)))
    df = step(df, named("_x0 _x1 _x2", unit(cross(here, vec("_h0", "_h1", "_h2")))))
    c, k, axis = F.col("_c"), vec("_k0", "_k1", "_k2"), vec("_x0", "_x1", "_x2")
    turn, entries = rodrigues(k, 1 / (1 + c)), {}
    for i in range(3):
        for j in range(3):
            one = F.lit(1.0 if i == j else 0.0)
            entries[out[3 * i + j]] = F.when(c > 1 - 1e-12, one).when(c < -1 + 1e-12, 2 * axis[i] * axis[j] - one).otherwise(turn[i][j])
    return step(df, entries).drop("_c", *(f"_{n}{i}" for n in "khx" for i in range(3)))


def rodrigues(k: Vec, factor: Column) -> Mat:
    """I + K + factor K K for the cross-product matrix K of k."""
    zero = F.lit(0.0)
    m = (zero, -k[2], k[1]), (k[2], zero, -k[0]), (-k[1], k[0], zero)
    square = matmul(m, m)
    return tuple(tuple(F.lit(1.0 if i == j else 0.0) + m[i][j] + square[i][j] * factor for j in range(3)) for i in range(3))
