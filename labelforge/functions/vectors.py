"""Vector functions over array<double> columns (F10-F13), all JVM-side higher-order functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    """Cast a float vector to double before any arithmetic (float sums differ by engine)."""
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """dot product."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector is left as is. The norm stands outside of the function of
    an element, where it would be computed again for every element."""
    n = l2_norm(v)
    return F.when(n > 0, F.zip_with(_c(v), F.array_repeat(n, F.size(_c(v))), lambda x, y: x / y)).otherwise(_c(v))


def cosine(a, b) -> Column:
    """cosine similarity, 0.0 when either vector has zero norm."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def scale(v, w) -> Column:
    """multiply every element by a weight."""
    return F.transform(_c(v), lambda x: x * _c(w))


def sigmoid(z) -> Column:
    """logistic function of a logit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def sigmoid_two_logits(l0, l1) -> Column:
    """F13, two-logit form: softmax([l0, l1])[1] = sigmoid(l1 - l0)."""
    return sigmoid(_c(l1) - _c(l0))


def argmax(v) -> Column:
    """P7 n-class argmax; a tie goes to the lowest index."""
    return F.array_position(_c(v), F.array_max(_c(v))) - 1


def argmax2(l0, l1) -> Column:
    """P7 two logits: 1 only when strictly greater (tie → 0 = Chat)."""
    return F.when(_c(l1) > _c(l0), F.lit(1)).otherwise(F.lit(0))


def round4(x) -> Column:
    """Round to 4 places and never emit -0.0 (used for engine-independent comparison)."""
    r = F.round(_c(x), 4)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
