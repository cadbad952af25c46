"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def xlnx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood ratio of a 2x2 table, floored at 0."""
    a, b, c, d = (double(x) for x in (a, b, c, d))
    inner = xlnx(a) + xlnx(b) + xlnx(c) + xlnx(d) + xlnx(a + b + c + d)
    return F.greatest(F.lit(0.0), 2 * (inner - xlnx(a + b) - xlnx(c + d) - xlnx(a + c) - xlnx(b + d)))


def log_odds(f1: Column, n1: Column, f2: Column, n2: Column) -> Column:
    """Natural log of the ratio of smoothed rates."""
    return F.ln((double(f1) + 0.5) / (double(n1) + 1)) - F.ln((double(f2) + 0.5) / (double(n2) + 1))


def chi2_sf(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, erfc(sqrt(x / 2)), by a rational approximation good to 1.5e-7."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z)


def entropy_of(counts: Column, base: float = 2.0) -> Column:
    """Entropy of an aggregated column of counts: log n - sum(f log f) / n."""
    n = F.sum(double(counts))
    return (F.ln(n) - F.sum(xlnx(double(counts))) / n) / F.ln(F.lit(base))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two arrays of probabilities."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: 0.5 * term(x, (x + y) / 2) + 0.5 * term(y, (x + y) / 2))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dating_entropy(pre: Column, post: Column) -> Column:
    """Bits of two probabilities; those not above 0 or null add nothing."""
    own = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return own(pre) + own(post)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens over the longer one's length, 0 for two empty ones; arrays are short."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j)

    def row(before: Column, x: Column) -> Column:
        start = F.array(F.element_at(before, 1) + 1)
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, lambda out, j: F.array_append(out, F.least(F.element_at(out, -1) + 1, F.element_at(before, j + 1) + 1, F.element_at(before, j) + F.when(F.element_at(b, j) == x, 0).otherwise(1))))

    last = F.when(F.size(b) == 0, F.array(F.size(a))).otherwise(F.aggregate(a, first, row))
    return double(F.element_at(last, -1)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rounded(df, digits: int = 6):  # noqa: ANN001, ANN201
    """All double columns rounded, for results that are compared."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
