"""Seeded samples on the hash path: per-group caps, id samples, first rows, and review samples in strata with their sheets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions import text as tx
from parchmill.session import written

# The columns of the two review sheets; the last two of each are left blank for the reviewer.
REVIEW_SHEET = (
    "id", "sample_reason", "category", "contract", "clause_text", "target", "rubric_aggregate", "rubric_structure_ok",
    "rubric_groundedness", "rubric_length_ok", "rubric_no_contradiction", "reviewer_verdict", "reviewer_notes",
)
JUDGE_SHEET = (
    "run_id", "id", "sample_reason", "category", "clause_text", "raw_response", "rubric_aggregate", "judge_groundedness",
    "judge_reasoning_quality", "judge_overall", "judge_rationale", "disagreement", "human_verdict", "human_notes",
)
# End of fixed values.


def capped(df: DataFrame, group: str, cap: int, key: str = "id", seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each group, by hash order.

    The rank filter is pushed below the shuffle, so a hot group sends at most ``cap`` rows a task.
    """
    order = Window.partitionBy(group).orderBy(tx.hash_order(seed, F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap).drop("__r")


def subset(df: DataFrame, sizes: Mapping[str, int], split: str = "split", key: str = "id", seed: int = 42) -> DataFrame:
    """Of each split named in ``sizes`` so many rows, by hash order: a small copy of the data for a trial run."""
    parts = [sampled(df.where(F.col(split) == name), n, key, seed=seed) for name, n in sizes.items()]
    return reduce(DataFrame.unionByName, parts)


def first_rows(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in a stated order; ``None`` and 0 mean all rows."""
    return df.orderBy(*order).limit(n) if n else df


def sampled(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """``n`` rows by hash order of the keys: a distributed top-n, no sort of the whole."""
    joined = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.orderBy(tx.hash_order(seed, joined), *keys).limit(n)


def lowest(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def waterfall(df: DataFrame, keys: list[str], strata: list[tuple[str, int, list[Column | str]]], n_random: int, seed: int = 42) -> DataFrame:
    """Rows tagged ``sample_reason``: of each stratum the first n in its order that no earlier stratum took, then a
    seeded sample of the rest. Every stratum is a bounded top-n; the anti-joins run against those few rows.

    ``df`` should be narrow: it is written once, so that what its columns come from is not worked out for each stratum.
    """
    taken: list[DataFrame] = []
    rest = written(df, "strata")
    for reason, n, order in strata:
        part = written(lowest(rest, n, *order).withColumn("sample_reason", F.lit(reason)), "stratum")
        taken.append(part)
        rest = rest.join(part.select(*keys), keys, "left_anti")
    taken.append(sampled(rest, n_random, *keys, seed=seed).withColumn("sample_reason", F.lit("random")))
    return reduce(DataFrame.unionByName, taken)


def review_sample(scored: DataFrame, n_low: int = 25, n_random: int = 35, seed: int = 42, key: str = "id") -> DataFrame:
    """The lowest-scoring rows, and a random sample of the others; scores rounded to three places, half to even."""
    names = ("structure_ok", "groundedness", "length_ok", "no_contradiction", "aggregate")
    rounded = scored.select(*[c for c in scored.columns if c not in names], *[F.bround(c, 3).alias(f"rubric_{c}") for c in names])
    return waterfall(rounded, [key], [("low_rubric_score", n_low, ["rubric_aggregate", key])], n_random, seed)


def sheet(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The sheet's fixed columns as text, missing values and missing columns empty; others are left out."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(*[cell(c).alias(c) for c in columns])


def validation_sample(joined: DataFrame, n_low: int = 15, n_far: int = 10, n_random: int = 10, seed: int = 42) -> DataFrame:
    """The lowest judgements, then the largest disagreements, then a sample of the rest; no row twice."""
    strata = [
        ("low_judge_score", n_low, ["judge_overall", "run_id", "id"]),
        ("rubric_judge_disagreement", n_far, [F.desc("disagreement"), F.asc("run_id"), F.asc("id")]),
    ]
    return waterfall(joined, ["run_id", "id"], strata, n_random, seed)


def reason_counts(sampled_rows: DataFrame) -> DataFrame:
    return sampled_rows.groupBy("sample_reason").agg(F.count(F.lit(1)).alias("n"))
