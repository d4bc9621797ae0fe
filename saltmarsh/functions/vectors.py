"""Distances and scores between vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: width of the Gaussian that turns a distance into a score.
GAUSSIAN_WIDTH = 0.25


def squared_l2(left: Column, right: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    gaps = F.zip_with(
        left,
        right,
        lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)


def gaussian_score(distance: Column, width: float = GAUSSIAN_WIDTH) -> Column:
    """Bell curve over the distance. The distance is squared again on purpose."""
    return F.exp(-(distance * distance) / F.lit(2.0 * width * width))


def inverse_score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def keyword_share(hits: Column, wanted: Column) -> Column:
    return F.least(F.lit(1.0), hits / F.greatest(wanted, F.lit(1)))


def hybrid_score(distance: Column, hits: Column, wanted: Column) -> Column:
    return F.lit(0.7) * gaussian_score(distance) + F.lit(0.3) * keyword_share(hits, wanted)


def evidence_confidence(count: Column) -> Column:
    return F.least(F.lit(0.98), F.lit(0.45) + F.lit(0.1) * count)


def run_confidence(succeeded: Column, failed: Column) -> Column:
    return F.greatest(F.lit(35), F.least(F.lit(98), F.lit(45) + 16 * succeeded - 10 * failed))
