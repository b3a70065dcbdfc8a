"""Vector functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, as SQL rounds: a negative value that rounds to nothing is -0.0, where Spark's round loses the sign."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0).cast("float")).otherwise(r)  # a float stays one


def truncate(vector, k: int) -> Column:
    """The first k values scaled to length 1; a zero head stays as it is."""
    head = F.slice(_c(vector), 1, k)
    n = norm(head)
    return F.when(n == 0, F.transform(head, lambda x: x.cast("double"))).otherwise(F.transform(head, lambda x: x.cast("double") / n))


def fit(vector, width: int, target: int) -> Column:
    """A query vector for a space: as it is, or cut; too narrow is an error."""
    if width < target:
        raise ValueError(f"a vector of {width} cannot fill {target} dimensions")
    return _c(vector) if width == target else truncate(vector, target)


def int8(vector) -> Column:
    """Each value times 127, rounded half to even, within a signed byte."""
    return F.transform(_c(vector), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x.cast("double") * 127).cast("int"))))


def float32(vector) -> Column:
    return F.transform(_c(vector), lambda x: x.cast("float"))
