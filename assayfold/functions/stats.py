"""Column expressions of selective prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayfold.errors import AssayError

#: z of the one-sided confidences that are offered (fixed values).
QUANTILES = {0.5: 0.0, 0.8: 0.84, 0.9: 1.28, 0.95: 1.645, 0.99: 2.33}


def z_for(confidence: float | None) -> float:
    """z of a confidence; 0 or none asks for the plain estimate, other values are refused."""
    if not confidence:
        return 0.0
    if confidence not in QUANTILES:
        raise AssayError(f"confidence must be one of {sorted(QUANTILES)}")
    return QUANTILES[confidence]


def certainty(kind: Column, p: Column, error: Column) -> Column:
    """0 for a failure, max(p, 1 - p) for yes/no, p otherwise."""
    return F.when(error.isNotNull(), F.lit(0.0)).when(kind == "noul", F.greatest(p, F.lit(1.0) - p)).otherwise(p)


def wilson_lower(share: Column, n: Column, z: float) -> Column:
    """Lower bound of a share of n, at least 0; 0 where n is not positive; the share itself at z = 0."""
    n, zz = n.cast("double"), z * z
    bound = (share + zz / (2 * n) - z * F.sqrt(F.greatest(share * (1 - share) / n + zz / (4 * n * n), F.lit(0.0)))) / (1 + zz / n)
    return F.when(n > 0, F.greatest(bound, F.lit(0.0))).otherwise(0.0)


def auroc_bounds(a: Column, right: Column, wrong: Column) -> tuple[Column, Column]:
    """95 % interval of an AUROC in closed form, clamped to [0, 1]; null without both classes."""
    r, w = right.cast("double"), wrong.cast("double")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    spread = 1.96 * F.sqrt(F.greatest((a * (1 - a) + (r - 1) * (q1 - a * a) + (w - 1) * (q2 - a * a)) / (r * w), F.lit(0.0)))
    both = (r > 0) & (w > 0)
    return F.when(both, F.greatest(a - spread, F.lit(0.0))), F.when(both, F.least(a + spread, F.lit(1.0)))
