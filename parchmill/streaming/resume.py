"""Resumable runs: an injected model function over rows that have no result yet, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmill.functions import text as tx
from parchmill.operators import judge, sample
from parchmill.sources import io

Model = Callable[[list[str]], list[str]]


def done_ids(spark: SparkSession, path: str, key: str = "id", retry_failed: bool = False, ok: str = "parse_ok") -> DataFrame:
    """Keys that have a result; a missing path gives none. With ``retry_failed`` a failed row counts as not done."""
    if not io.exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    df = spark.read.parquet(path)
    return (df.where(F.coalesce(ok, F.lit(False))) if retry_failed else df).select(key).distinct()


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def restricted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def asked(df: DataFrame, model: Model, prompt: str, out: str = "reply", batch: int = 8) -> DataFrame:
    """Add the model's reply and ``error``: a failed batch marks its rows and does not end the run.

    The function runs in Arrow batches, ``batch`` prompts a call. A null prompt is not asked.
    """

    @F.pandas_udf("reply string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows: list[tuple[str | None, str | None]] = [(None, None)] * len(prompts)
            todo = [i for i, p in enumerate(prompts) if p is not None]
            for k in range(0, len(todo), batch):
                part = todo[k : k + batch]
                try:
                    replies = model([prompts.iloc[i] for i in part])
                    for i, r in zip(part, replies, strict=True):
                        rows[i] = (r, None)
                except Exception as x:  # noqa: BLE001 - any failure of the model is data here
                    for i in part:
                        rows[i] = (None, f"{type(x).__name__}: {x}")
            yield pd.DataFrame(rows, columns=["reply", "error"])

    step = df.withColumn("__r", call(F.col(prompt)))
    return step.withColumns({out: F.col("__r.reply"), "error": F.col("__r.error")}).drop("__r")


def targets(queue: DataFrame, model: Model, retry: bool = True, batch: int = 8) -> DataFrame:
    """Replies to ``teacher_prompt`` with ``target`` in canonical form, ``parse_ok`` and ``retried``; a reply that does not
    parse is asked for once more with a stricter prompt, in the same pass."""
    first = asked(queue, model, "teacher_prompt", "raw_teacher_response", batch)
    parsed = tx.with_sections(first, "raw_teacher_response").withColumn("retried", F.lit(False))
    if retry:
        again = F.when(F.col("__s").isNull() & F.col("error").isNull(), F.concat("teacher_prompt", F.lit(tx.RETRY_SUFFIX)))
        second = asked(parsed.withColumn("__p", again).withColumnRenamed("error", "__e"), model, "__p", "__again", batch)
        merged = second.withColumns(
            {"error": F.coalesce("__e", "error"), "raw_teacher_response": F.coalesce("__again", "raw_teacher_response"), "retried": F.col("__p").isNotNull()}
        )
        parsed = tx.with_sections(merged.drop("__p", "__e", "__again", "__s"), "raw_teacher_response")
    return parsed.withColumns({"target": tx.format_sections(F.col("__s")), "parse_ok": F.col("__s").isNotNull()}).drop("__s")


def run_report(results: DataFrame) -> DataFrame:
    """One row: rows, parse failures, and replies that only parsed when asked for again."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("parse_ok")).alias("n_parse_failures"), F.count_if(F.col("retried") & F.col("parse_ok")).alias("n_recovered")
    )


def judged(rows: DataFrame, model: Model, batch: int = 8) -> DataFrame:
    """The rows with a judge's scores: prompt from category, clause and response, model call, parsed reply."""
    replies = asked(judge.judge_prompts(rows), model, "judge_prompt", "judge_reply", batch)
    return judge.with_judgement(replies).drop("judge_prompt", "judge_reply")


def analyzed(df: DataFrame, model: Model | None, model_id: str, adapter_name: str | None = None, batch: int = 8) -> DataFrame:
    """Each request to the end: why it is turned away, or the model's sections.

    ``reason`` is null where the model was asked: else ``model not loaded``, ``empty`` or ``not substantive``, in that order.
    A reply that does not parse gives null sections and ``parse_ok`` false. Other columns pass through.
    """
    clause = F.col("clause_text")
    reason = F.when(F.lit(model is None), "model not loaded").when(F.coalesce(clause, F.lit("")) == "", "empty").when(~tx.is_substantive(clause), "not substantive")
    guarded = df.withColumn("reason", reason)
    prompt = F.when(F.col("reason").isNull(), tx.filled(tx.PROMPT, category=F.col("category"), clause_text=clause))
    replies = asked(guarded.withColumn("__p", prompt), model or (lambda prompts: []), "__p", "raw_response", batch).drop("__p")
    parsed = tx.with_sections(replies, "raw_response")
    sections = {s.lower(): F.col("__s")[s] for s in tx.SECTIONS}
    more = {"parse_ok": F.col("__s").isNotNull(), "model_id": F.lit(model_id), "adapter_name": F.lit(adapter_name).cast("string")}
    return parsed.withColumns(sections | more).drop("__s")


def resume(rows: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, key: str = "id", retry_failed: bool = False) -> int:
    """Run ``step`` over the rows without a result and append; returns how many rows were pending.

    The model is called once a row: the result is written before anything else reads it.
    """
    spark = rows.sparkSession
    todo = pending(rows, done_ids(spark, path, key, retry_failed), key)
    n = todo.count()
    if n:
        step(todo).write.mode("append").parquet(path)
    return n


def judge_run(rows: DataFrame, model: Model, path: str, ids: DataFrame | None = None, key: str = "id", batch: int = 8) -> int:
    """Judge the rows, or those whose id is listed, that have no judgement at ``path`` yet; returns how many there were."""
    kept = rows if ids is None else restricted(rows, ids)
    return resume(kept, lambda todo: judged(todo, model, batch), path, key)


def generation_run(rows: DataFrame, model: Model, path: str, limit: int | None = None, key: str = "id", batch: int = 8) -> int:
    """Replies to ``prompt`` as ``raw_response`` for the first ``limit`` rows by key, 0 and None meaning all, that have none
    at ``path`` yet; returns how many there were."""
    kept = sample.first_rows(rows, limit, key)
    return resume(kept, lambda todo: asked(todo, model, "prompt", "raw_response", batch), path, key)


def dry_run_gate(responses: DataFrame, *by: str, text: str = "raw_response") -> DataFrame:
    """Whether every response of a trial begins with the first label: n, n_bad, passes. A null response does not."""
    good = F.coalesce(F.startswith(tx.strip(F.col(text)), F.lit(f"{tx.SECTIONS[0]}:")), F.lit(False))
    return responses.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("n_bad"), (F.count_if(~good) == 0).alias("passes"))


def resume_stream(
    rows: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "id"
) -> StreamingQuery:
    """The same over a streaming source: every micro-batch is cleaned of done keys, run and appended.

    The checkpoint makes a source row reach the step once; the anti-join covers a batch repeated after a failure.
    """

    def handle(batch: DataFrame, _: int) -> None:
        resume(batch.dropDuplicates([key]), step, path, key)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
