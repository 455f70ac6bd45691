"""The queries of the training-data operators: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import defects, encoding, overlap, packing, quality, ranking, repetition, sentences, truncation
from parchmill.session import table, written


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "analyze_requests").select("id", "clause_text")
    kinds = quality.with_kind(requests).select("id", "kind")
    return kinds.where(F.col("kind").isin("list", "table", "junk")).distinct()


def p1_statistics(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "analyze_requests").select("id", "clause_text")
    return quality.with_kind(requests).select("id", "stats.*", "reasons", "warnings", "kind").distinct()


def p1_by_category(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "analyze_requests").select("id", "category", "clause_text")
    return quality.by_category(quality.with_kind(requests).select("id", "category", "stats", "kind").distinct())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    responses = table(spark, sf, "analyze_responses").select("response_id", "raw_response")
    return repetition.repetitive_keys(responses, "raw_response", "response_id").distinct()


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    responses = table(spark, sf, "analyze_responses").select("response_id", "source", "raw_response")
    return repetition.with_outliers(repetition.repetitive(responses, "raw_response", "response_id")).distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    runs = ranking.run_scores(*(table(spark, sf, t) for t in ("rubric_scores", "llm_judge_summary", "runs")))
    scored = ranking.combined_scores(runs, ["grid_id"], {"aggregate": 1, "overall": 1, "groundedness": 1})
    return ranking.first_of_group(scored, ["grid_id"], "run_id").select("grid_id", "run_id")


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    runs = ranking.run_scores(*(table(spark, sf, t) for t in ("rubric_scores", "llm_judge_summary", "runs")))
    scored = ranking.combined_scores(runs, ["grid_id"], {"aggregate": 1, "overall": 1, "groundedness": 1})
    places = ranking.ranked(scored, ["grid_id"], "run_id")
    return places.withColumns({c: F.round(c, 10) for c in ("aggregate", "combined")})


def _values(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, truncation.TerminalModel]]:
    """(field, source, key, text) of both columns, and a terminal model for each."""
    requests = table(spark, sf, "analyze_requests").select(F.lit("clause_text").alias("field"), "source", F.col("id").alias("key"), F.col("clause_text").alias("text"))
    responses = table(spark, sf, "analyze_responses").select(
        F.lit("raw_response").alias("field"), "source", F.col("response_id").alias("key"), F.col("raw_response").alias("text")
    )
    models = {"clause_text": truncation.fit_model(requests, "text", "key"), "raw_response": truncation.fit_model(responses, "text", "key")}
    return requests.union(responses), models


def _defective(spark: SparkSession, sf: str) -> DataFrame:
    responses = table(spark, sf, "analyze_responses").select("response_id", "id", "source", "raw_response")
    values = responses.select(F.lit("raw_response").alias("field"), "source", F.col("response_id").alias("key"), F.col("raw_response").alias("text"))
    limits = written(truncation.limits(truncation.lengths(values)), "limits")
    pairs = defects.answered(responses, table(spark, sf, "analyze_requests"), limits)
    return defects.with_defects(pairs, truncation.fit_model(values, "text", "key"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _defective(spark, sf).select("response_id", F.explode("defects").alias("defect")).distinct()


def p4_by_source(spark: SparkSession, sf: str) -> DataFrame:
    found = _defective(spark, sf).select("response_id", "source", F.explode_outer("defects").alias("defect")).distinct()
    return found.groupBy("source", F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_texts(*_values(spark, sf)).select("field", F.col("key").alias("record_id")).distinct()


def p5_by_source(spark: SparkSession, sf: str) -> DataFrame:
    values, models = _values(spark, sf)
    cut = truncation.cut_texts(values, models).groupBy("field", "source").agg(F.countDistinct("key").alias("n_cut"))
    # a row delivered again is the same key: counted once
    total = values.select("field", "source", "key").distinct().groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))
    joined = total.alias("t").join(cut.alias("c"), (F.col("t.field") == F.col("c.field")) & F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    n_cut = F.coalesce("c.n_cut", F.lit(0))
    return joined.select("t.field", "t.source", "t.n", n_cut.alias("n_cut"), F.round(n_cut / F.col("t.n"), 6).alias("cut_share"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlapping(table(spark, sf, "analyze_requests").select("id", "clause_text", "split"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _overlaps(spark, sf)
    return pairs.select(F.least("left", "right").alias("id_a"), F.greatest("left", "right").alias("id_b")).distinct()


def p6_by_split_and_source(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "analyze_requests")
    hit = overlap.covered(requests.select("id", "clause_text", "split")).withColumnRenamed("key", "id")
    rows = requests.where("split <> 'train'").select("id", "split", "source").distinct()
    return rows.join(hit, "id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("coverage").alias("n_overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    documents = _documents(spark, sf)
    return encoding.with_ids(documents).select("doc_id", "ids")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    documents = _documents(spark, sf)
    # the id alone need not be unique, nor there
    record = F.struct("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").isNull().alias("no_text")).alias("record")
    counted = encoding.with_token_count(documents).select(record, "n_tokens")
    packed = packing.fill_containers(counted, "record", "n_tokens", 1024)
    return packed.select("record.doc_id", "piece", "start", "size", "container")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.one_per_id(table(spark, sf, "documents").select("doc_id", "text"))


def _sentence_model(spark: SparkSession, sf: str) -> sentences.SentenceModel:
    return sentences.fit_model(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    starts = sentences.with_unit_starts(_documents(spark, sf), _sentence_model(spark, sf))
    return starts.select("doc_id", F.explode("starts").alias("start_pos"))


def p9_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.units(_documents(spark, sf), _sentence_model(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit()}
