"""Cleaning: source filter, prompts, known-bad and fragment removal with a report, duplicate audit, corpus profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions import text as tx
from parchmill.session import written

#: What counts as one in :func:`length_budget`.
PIECE = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \n\r\t]"


def clauses_from_source(source: DataFrame, excluded: tuple[str, ...] = tx.EXCLUDED_CATEGORIES) -> DataFrame:
    """(id, contract, category, clause_text) of the answerable rows with a substantive answer and a category not excluded.

    Expects id, title, question and answers.text; an empty or null answer list drops the row.
    """
    answer = F.get(F.col("answers.text"), F.lit(0))
    clause = source.select(
        "id", F.col("title").alias("contract"), tx.category_of(F.col("question")).alias("category"), tx.strip(answer).alias("clause_text")
    )
    return clause.where(F.col("category").isNotNull() & ~F.col("category").isin(*excluded) & tx.is_substantive(F.col("clause_text")))


def with_prompts(df: DataFrame) -> DataFrame:
    """Add the canonical ``prompt`` and the ``teacher_prompt``."""
    fields = {"category": F.col("category"), "clause_text": F.col("clause_text")}
    return df.withColumns({"prompt": tx.filled(tx.PROMPT, **fields), "teacher_prompt": tx.filled(tx.TEACHER_PROMPT, **fields)})


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``, null included; rows delivered again are equal, so any of them will do.

    Only the keys are shuffled: those that stand twice are written, so that their size is known and the planner joins
    them as suits it. All other rows, and their texts, stay where they are.
    """
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*[F.col(k).alias(f"__{k}") for k in keys])
    again = written(twice, "again")
    if again.isEmpty():
        return df
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates([*keys]))


def length_budget(df: DataFrame, *texts: str, by: str = "split", budget: int = 1024) -> DataFrame:
    """Sizes of the joined ``texts`` of a row against a budget, by ``by``: n, the largest, the 99th percentile, and how many are over.

    Sizes are in words, numbers and other marks, each one; quantiles come from a mergeable sketch, exact to one in 100,000.
    """
    size = sum((F.size(tx.found(F.coalesce(F.col(t), F.lit("")), PIECE)) for t in texts), F.lit(0)).cast("bigint")
    return df.withColumn("__n", size).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max("__n").alias("max_size"), F.percentile_approx("__n", 0.99, 100_000).alias("p99_size"),
        F.count_if(F.col("__n") > budget).alias("n_over"),
    )


def training_steps(rows: DataFrame, epochs: int, per_device: int, accumulated: int) -> DataFrame:
    """Optimizer steps of a training over ``rows``: whole batches of an epoch, the last one perhaps not full, times epochs."""
    batch = per_device * accumulated
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), F.lit(batch).alias("effective_batch"), (F.ceil(n / F.lit(batch)) * epochs).cast("bigint").alias("steps"))


def known_bad_ids(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("verdict") == "bad").select("id").distinct()


def cleaned(df: DataFrame, bad: DataFrame, text: str = "clause_text") -> DataFrame:
    """Rows that are neither known bad nor fragments."""
    return df.join(bad.select("id"), "id", "left_anti").where(tx.is_substantive(F.col(text)))


def clean_report(df: DataFrame, bad: DataFrame, text: str = "clause_text") -> DataFrame:
    """start, removed_known_bad, removed_fragments, final in one pass; a bad fragment counts as known bad."""
    marked = df.join(bad.select("id").distinct().withColumn("__bad", F.lit(True)), "id", "left")
    is_bad = F.coalesce(F.col("__bad"), F.lit(False))
    fragment = ~is_bad & ~tx.is_substantive(F.col(text))
    return marked.agg(
        F.count(F.lit(1)).alias("start"),
        F.count_if(is_bad).alias("removed_known_bad"),
        F.count_if(fragment).alias("removed_fragments"),
        F.count_if(~is_bad & ~fragment).alias("final"),
    )


def duplicate_audit(df: DataFrame, text: str = "clause_text") -> DataFrame:
    """Texts that stand in more than one row, with the number of rows, contracts and categories."""
    groups = df.where(F.col(text).isNotNull()).groupBy(text).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("contract").alias("n_contracts"), F.countDistinct("category").alias("n_categories")
    )
    return groups.where("n_rows > 1")


def corpus_profile(df: DataFrame, text: str = "clause_text") -> DataFrame:
    """One row: sizes, empties and word-count quantiles. Quantiles come from a mergeable sketch, exact to one in 100,000."""
    n = tx.word_count(F.coalesce(F.col(text), F.lit("")))
    counted = df.withColumn("__n", n)
    q = F.percentile_approx("__n", [0.5, 0.9, 0.99], 100_000)
    out = counted.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("contract").alias("n_contracts"),
        F.countDistinct("category").alias("n_categories"),
        F.count_if(tx.strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("n_empty"),
        F.round(F.avg("__n"), 10).alias("mean_words"),
        q.alias("__q"),
        F.max("__n").alias("max_words"),
    )
    return out.select("*", *[F.get("__q", F.lit(i)).alias(c) for i, c in enumerate(("median_words", "p90_words", "p99_words"))]).drop("__q")
