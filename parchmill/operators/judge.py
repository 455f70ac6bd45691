"""Model judgements: parse, join with rubric scores, summaries, validation findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions import text as tx

SCORES = ("groundedness", "reasoning_quality", "overall")


def judge_prompts(df: DataFrame) -> DataFrame:
    fields = {"category": F.col("category"), "clause_text": F.col("clause_text"), "response": F.col("raw_response")}
    return df.withColumn("judge_prompt", tx.filled(tx.JUDGE_PROMPT, **fields))


def with_judgement(df: DataFrame, raw: str = "judge_reply") -> DataFrame:
    """Add judge_parse_ok, the three scores, the rationale, and judge_raw where the reply does not parse."""
    step = df.withColumn("__j", tx.parse_judge(F.col(raw)))
    ok = F.col("__j").isNotNull()
    return step.withColumns(
        {
            "judge_parse_ok": ok,
            **{c: F.col(f"__j.{c}") for c in (*SCORES, "rationale")},
            "judge_raw": F.when(~ok, F.col(raw)),
        }
    ).drop("__j")


def judged_with_rubric(scored: DataFrame, judged: DataFrame) -> DataFrame:
    """Parsed judgements with their rubric score, and how far apart the two are on one scale.

    Both have ``groundedness``; the judge's is renamed. Keys must be unique on either side.
    """
    j = judged.where(F.coalesce("judge_parse_ok", F.lit(False))).select(
        "run_id", "id", *[F.col(c).alias(f"judge_{c}") for c in (*SCORES, "rationale")]
    )
    s = scored.select("run_id", "id", "category", "clause_text", "raw_response", F.col("aggregate").alias("rubric_aggregate"))
    apart = F.bround(F.abs(F.col("rubric_aggregate") - (F.col("judge_overall") - 1) / 4.0), 3)
    return s.join(j, ["run_id", "id"]).withColumn("disagreement", apart)


def judge_summary(judged: DataFrame) -> DataFrame:
    """Means over the parsed judgements of a run; n and the parse rate over all."""
    ok = F.coalesce("judge_parse_ok", F.lit(False))
    return judged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.when(ok, F.col(c))), 10).alias(c) for c in SCORES],
        F.round(F.avg(ok.cast("int")), 10).alias("parse_ok_rate"),
    )


def consolidated(rubric: DataFrame, judge: DataFrame) -> DataFrame:
    """One row a run: both summaries, their columns prefixed."""
    r = rubric.select("run_id", *[F.col(c).alias(f"rubric_{c}") for c in rubric.columns if c != "run_id"])
    j = judge.select("run_id", *[F.col(c).alias(f"judge_{c}") for c in judge.columns if c != "run_id"])
    return r.join(j, "run_id")


#: A reviewer's verdicts, and those that uphold the judge.
VERDICTS = ("both_right", "both_wrong", "judge_wrong", "judge_right")
UPHELD = ("both_right", "judge_right")


def validation_findings(reviewed: DataFrame, *dims: str) -> DataFrame:
    """Counts of each verdict and the share that upholds the judge, by every subset of ``dims``."""
    upheld = F.col("human_verdict").isin(*UPHELD)
    return reviewed.cube(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("human_verdict") == v).alias(f"n_{v}") for v in VERDICTS],
        F.count_if(upheld).alias("n_upheld"),
        F.round(F.avg(upheld.cast("int")), 10).alias("upheld_share"),
    )
