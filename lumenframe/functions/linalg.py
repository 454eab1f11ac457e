"""Vector and small-matrix algebra as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = Sequence[Column]


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def dist(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def scale(a: Vec, k: Column) -> list[Column]:
    return [p * k for p in a]


def unit(a: Vec, eps: float = 1e-8) -> list[Column]:
    """Unit vector; a vector shorter than ``eps`` is returned unchanged."""
    n = norm(a)
    return [F.when(n > eps, p / n).otherwise(p) for p in a]


def unit_or(a: Vec, fallback: Sequence[float], eps: float = 1e-8) -> list[Column]:
    n = norm(a)
    return [F.when(n >= eps, p / n).otherwise(F.lit(float(f))) for p, f in zip(a, fallback)]


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def cosine(a: Vec, b: Vec) -> Column:
    return clip(dot(unit(a), unit(b)), -1.0, 1.0)


def moments(names: Sequence[str], prefix: str = "m") -> list[Column]:
    """Mergeable population second moments of three columns, for use in ``agg``."""
    a, b, c = names
    return [
        F.covar_pop(a, a).alias(f"{prefix}_aa"),
        F.covar_pop(b, b).alias(f"{prefix}_bb"),
        F.covar_pop(c, c).alias(f"{prefix}_cc"),
        F.covar_pop(a, b).alias(f"{prefix}_ab"),
        F.covar_pop(a, c).alias(f"{prefix}_ac"),
        F.covar_pop(b, c).alias(f"{prefix}_bc"),
    ]


def with_eigenvalues(df: DataFrame, prefix: str = "m", out: str = "ev") -> DataFrame:
    """Closed-form eigenvalues (descending ``{out}1..3``) of the symmetric matrix ``{prefix}_*``."""
    aa, bb, cc, ab, ac, bc = (F.col(f"{prefix}_{s}") for s in ("aa", "bb", "cc", "ab", "ac", "bc"))
    t = f"__{out}"
    df = df.withColumns({f"{t}_q": (aa + bb + cc) / 3.0, f"{t}_off": ab * ab + ac * ac + bc * bc})
    q = F.col(f"{t}_q")
    df = df.withColumn(
        f"{t}_p",
        F.sqrt(((aa - q) * (aa - q) + (bb - q) * (bb - q) + (cc - q) * (cc - q) + 2.0 * F.col(f"{t}_off")) / 6.0),
    )
    p = F.col(f"{t}_p")
    da, db, dc = aa - q, bb - q, cc - q
    det = da * (db * dc - bc * bc) - ab * (ab * dc - bc * ac) + ac * (ab * bc - db * ac)
    df = df.withColumn(
        f"{t}_r", F.when(p > 1e-300, clip(det / (2.0 * p * p * p), -1.0, 1.0)).otherwise(F.lit(1.0))
    )
    df = df.withColumn(f"{t}_phi", F.acos(F.col(f"{t}_r")) / 3.0)
    phi = F.col(f"{t}_phi")
    df = df.withColumns(
        {
            f"{out}1": q + 2.0 * p * F.cos(phi),
            f"{out}3": q + 2.0 * p * F.cos(phi + F.lit(2.0 * math.pi / 3.0)),
        }
    )
    df = df.withColumn(f"{out}2", 3.0 * q - F.col(f"{out}1") - F.col(f"{out}3"))
    return df.drop(f"{t}_q", f"{t}_off", f"{t}_p", f"{t}_r", f"{t}_phi")


def with_main_axis(df: DataFrame, prefix: str = "m", ev: str = "ev1", out: str = "axis") -> DataFrame:
    """Unit eigenvector ``{out}_a/b/c`` of eigenvalue column ``ev``.

    The null space of (M - ev*I) is spanned by the longest cross product of its rows; the sign
    makes the first non-zero component positive, so that it does not depend on row order.
    """
    aa, bb, cc, ab, ac, bc = (F.col(f"{prefix}_{s}") for s in ("aa", "bb", "cc", "ab", "ac", "bc"))
    e = F.col(ev)
    rows = [[aa - e, ab, ac], [ab, bb - e, bc], [ac, bc, cc - e]]
    picks = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        v = cross(rows[i], rows[j])
        picks.append(F.struct(dot(v, v).alias("n2"), v[0].alias("a"), v[1].alias("b"), v[2].alias("c")))
    t = f"__{out}"
    df = df.withColumn(t, F.greatest(*picks))
    n = F.sqrt(F.col(f"{t}.n2"))
    s = (
        F.when(F.abs(F.col(f"{t}.a")) > 1e-12 * n, F.signum(F.col(f"{t}.a")))
        .when(F.abs(F.col(f"{t}.b")) > 1e-12 * n, F.signum(F.col(f"{t}.b")))
        .otherwise(F.signum(F.col(f"{t}.c")))
    )
    # an isotropic cloud has no main axis: fall back to the axis of the largest variance
    flat = F.col(f"{t}.n2") < 1e-24
    first = (aa >= bb) & (aa >= cc)
    second = (~first) & (bb >= cc)
    df = df.withColumns(
        {
            f"{out}_a": F.when(flat, first.cast("double")).otherwise(F.col(f"{t}.a") / n * s),
            f"{out}_b": F.when(flat, second.cast("double")).otherwise(F.col(f"{t}.b") / n * s),
            f"{out}_c": F.when(flat, (~first & ~second).cast("double")).otherwise(F.col(f"{t}.c") / n * s),
        }
    )
    return df.drop(t)
