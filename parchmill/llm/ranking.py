"""Problem 3: one ranking from several scores of different scale and spread."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import written

#: Median absolute deviation of a normal distribution with unit spread.
MAD_TO_SPREAD = 1.4826
#: Rank accuracy of the quantile sketch: medians are exact up to this many rows a group.
MEDIAN_ACCURACY = 100_000


def median(column: str | Column) -> Column:
    """Lower median as a mergeable sketch, so that a group of any size is aggregated map-side."""
    return F.percentile_approx(column, 0.5, MEDIAN_ACCURACY)


def combined_scores(df: DataFrame, group: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Add ``combined`` in (0, 1): weighted geometric mean of squashed robust z-values.

    Each score is centred on its group's median and divided by the scaled median absolute deviation, then bounded by
    the logistic function, so neither unit, spread nor an outlier decides. Rows lacking a score, or whose score is NaN,
    are left out, before medians are taken. Where more than half of a group's values are equal the deviation is zero;
    the mean absolute deviation stands in, and if that is zero too, the score is the same 0.5 for all. A null group is
    a group of its own. An empty table gives an empty result; columns of other names pass through.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = float(sum(weights.values()))
    keep = df
    for c in weights:
        keep = keep.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    keyed = keep.withColumn("__group", F.struct(*[F.col(c) for c in group]))
    centre = keyed.groupBy("__group").agg(*[median(c).alias(f"__m_{i}") for i, c in enumerate(weights)])
    near = keyed.join(centre, keyed["__group"].eqNullSafe(centre["__group"])).drop(centre["__group"])
    gaps = [F.abs(F.col(c) - F.col(f"__m_{i}")) for i, c in enumerate(weights)]
    spread = near.groupBy("__group").agg(
        *[median(g).alias(f"__d_{i}") for i, g in enumerate(gaps)], *[F.avg(g).alias(f"__a_{i}") for i, g in enumerate(gaps)]
    )
    both = near.join(spread, near["__group"].eqNullSafe(spread["__group"])).drop(spread["__group"])
    log_sum = F.lit(0.0)
    for i, (c, w) in enumerate(weights.items()):
        scale = F.when(F.col(f"__d_{i}") > 0, F.col(f"__d_{i}") * MAD_TO_SPREAD).when(F.col(f"__a_{i}") > 0, F.col(f"__a_{i}"))
        z = F.coalesce((F.col(c) - F.col(f"__m_{i}")) / scale, F.lit(0.0))
        # ln(1 / (1 + e^-z)), kept finite for any z
        log_sum = log_sum - (F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))) * F.lit(w / total)
    return both.withColumn("combined", F.exp(log_sum)).select(*df.columns, "combined")


def first_of_group(df: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """The best item of each group; scores equal to ten places are decided by the smaller item.

    One map-side aggregate, no sort, and no join with a second reckoning of the same scores, whose last bits may differ.
    """
    best = F.min(F.struct((-F.round("combined", 10)).alias("worse"), F.col(item).alias("item"))).alias("__best")
    return df.groupBy(*group).agg(best).select(*group, F.col("__best.item").alias(item))


def ranked(df: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """Add ``place`` within the group, 1 the best; equal scores are ordered by item."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.round("combined", 10)), F.asc(item))))


def run_scores(rubric: DataFrame, judge: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run of a grid with its mean aggregate and the judge's overall and groundedness.

    A row delivered again counts once; null values enter no mean.
    """
    means = (
        rubric.groupBy("run_id", "id")
        .agg(F.max("aggregate").alias("aggregate"))
        .groupBy("run_id")
        .agg(F.avg("aggregate").alias("aggregate"))
    )
    judged = judge.groupBy("run_id").agg(F.max("overall").alias("overall"), F.max("groundedness").alias("groundedness"))
    grids = runs.groupBy("run_id").agg(F.max("grid_id").alias("grid_id"))
    scores = grids.join(means, "run_id").join(judged, "run_id").select("grid_id", "run_id", "aggregate", "overall", "groundedness")
    # one row a run, read three times: written, so that all readers see the same numbers and nothing is summed again
    return written(scores, "scores")
