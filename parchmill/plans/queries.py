"""The queries of the core, one for each operator: name -> (spark, folder) -> DataFrame.

Requests stand in for clauses, responses for model answers, documents for a corpus. Rows delivered again are one record.
Where a table lacks a column that an operator reads (judge replies, reviews, questions), it is derived from the row's
digest by an expression that the SQL side repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions import corrupt, rubric
from parchmill.functions import text as tx
from parchmill.operators import clean, judge, sample, split
from parchmill.session import own_folder, table
from parchmill.sources import io
from parchmill.streaming import resume

Query = Callable[[SparkSession, str], DataFrame]


# ---- bases ----


def clauses(spark: SparkSession, sf: str) -> DataFrame:
    return clean.one_per_key(table(spark, sf, "analyze_requests").select("id", "contract", "category", "clause_text", "split"), "id")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "analyze_responses").select("response_id", "run_id", "id", "contract", "category", "raw_response")
    return clean.one_per_key(rows, "response_id")


def answered(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).join(clauses(spark, sf).select("id", "clause_text"), "id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return rubric.with_rubric(answered(spark, sf))


def rows_scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rubric_scores").select("run_id", "id", *rubric.COMPONENTS, "aggregate").distinct()


def judge_reply(key: Column) -> Column:
    """A reply in one of several shapes, by the key's digest: well-formed, with a preamble, out of range, or free text."""
    h = tx.row_seed(key)
    n = lambda d: (F.floor(h / d) % 5 + 1).cast("string")
    body = F.concat(
        F.lit("GROUNDEDNESS: "), n(10), F.lit("\nREASONING_QUALITY: "), n(50), F.lit("\nOVERALL: "), n(250),
        F.lit("\nRATIONALE: The score rests\non the clause. "),
    )
    return (
        F.when(h % 10 == 0, F.lit("The analysis is adequate."))
        .when(h % 10 == 1, F.regexp_replace(body, r"OVERALL: \d", "OVERALL: 7"))
        .when(h % 10 == 2, F.concat(F.lit("Here is my verdict.\n"), body))
        .otherwise(body)
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    r = responses(spark, sf).select("run_id", "id", F.col("response_id"), judge_reply(F.col("response_id")).alias("judge_reply"))
    return judge.with_judgement(r)


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    h = tx.row_seed(F.col("id"))
    return clauses(spark, sf).select("id", F.when(h % 50 == 0, "bad").when(h % 50 < 10, "minor").otherwise("good").alias("verdict"))


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the shape of an extraction dataset: a question that names the category, and a list of answers."""
    question = F.concat(F.lit('Highlight the parts (if any) related to "'), F.col("category"), F.lit('" that should be reviewed.'))
    answers = F.struct(F.when(F.col("clause_text").isNull(), F.array().cast("array<string>")).otherwise(F.array("clause_text")).alias("text"))
    return clauses(spark, sf).select("id", F.col("contract").alias("title"), question.alias("question"), answers.alias("answers"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    r = responses(spark, sf).select("response_id", "contract", "category", "raw_response")
    return tx.with_sections(r, "raw_response").select(F.col("response_id").alias("id"), "contract", "category", tx.format_sections(F.col("__s")).alias("target"))


def prompted_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets with the clause they analyse and the prompt that asks for them."""
    r = tx.with_sections(answered(spark, sf), "raw_response").select("response_id", "contract", "category", "clause_text", tx.format_sections(F.col("__s")).alias("target"))
    return clean.with_prompts(r.withColumnRenamed("response_id", "id")).drop("teacher_prompt")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def validated(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and scores of judged responses: narrow, so that samples do not carry texts."""
    s = rubric.with_rubric(answered(spark, sf)).select("run_id", "id", "category", "clause_text", "raw_response", "aggregate")
    joined = judge.judged_with_rubric(s, judged(spark, sf))
    return joined.select("run_id", "id", "rubric_aggregate", "judge_groundedness", "judge_reasoning_quality", "judge_overall", "judge_rationale", "disagreement")


# ---- parsing and scalar functions ----


def irac_parse(spark: SparkSession, sf: str) -> DataFrame:
    return tx.with_sections(responses(spark, sf), "raw_response").where("__s is not null").select("response_id", "__s.*")


def irac_format_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    once = targets(spark, sf).where("target is not null").select("id", "target")
    return tx.with_sections(once, "target").select("id", "target", (tx.format_sections(F.col("__s")) == F.col("target")).alias("stable"))


def irac_parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    ok = tx.parse_irac(F.col("raw_response")).isNotNull()
    return responses(spark, sf).groupBy("run_id").agg(F.count_if(~ok).alias("n_failed"), F.count(F.lit(1)).alias("n"))


def judge_parse(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("response_id", "judge_parse_ok", *judge.SCORES, "rationale", "judge_raw")


def category_extract(spark: SparkSession, sf: str) -> DataFrame:
    return source_rows(spark, sf).select("id", tx.category_of(F.col("question")).alias("category"))


def content_words(spark: SparkSession, sf: str) -> DataFrame:
    words = tx.content_words(F.col("clause_text"))
    return clauses(spark, sf).select("id", F.size(words).cast("bigint").alias("n_words"), F.array_join(F.array_sort(words), " ").alias("words"))


def quoted_spans(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("response_id", F.posexplode(tx.quoted_spans(F.col("raw_response"))).alias("at", "span"))


def score_length(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).where("raw_response is not null").select("response_id", F.round(rubric.length_score(F.col("raw_response")), 10).alias("length_ok"))


def row_seed(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(spark, sf).select("id", tx.row_seed(F.col("id")).alias("seed"))


def company_key(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(spark, sf).select("contract").distinct().select("contract", tx.company_key(F.col("contract")).alias("key"))


# ---- filters, cleaning, prompts ----


def substantive_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(spark, sf).where(tx.is_substantive(F.col("clause_text"))).select("id")


def excluded_category_filter(spark: SparkSession, sf: str) -> DataFrame:
    administrative = table(spark, sf, "categories").where("administrative").select("category")
    return clauses(spark, sf).where("category is not null").join(administrative, "category", "left_anti").select("id", "category")


def source_to_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clauses_from_source(source_rows(spark, sf))


def known_bad_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return clean.cleaned(clauses(spark, sf), clean.known_bad_ids(reviews(spark, sf))).select("id")


def clean_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_report(clauses(spark, sf), clean.known_bad_ids(reviews(spark, sf)))


def prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_prompts(clauses(spark, sf)).select("id", "prompt", "teacher_prompt")


def judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return judge.judge_prompts(answered(spark, sf)).select("response_id", "judge_prompt")


def duplicate_clause_audit(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_audit(clauses(spark, sf))


def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.corpus_profile(clauses(spark, sf))


# ---- rubric ----


def rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("response_id", *[F.round(c, 10).alias(c) for c in (*rubric.COMPONENTS, "aggregate")])


def score_groundedness(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("structure_ok = 1").select("response_id", F.round("groundedness", 10).alias("groundedness"))


def score_no_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("structure_ok = 1").select("response_id", "no_contradiction")


def rubric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rubric.summary(scored(spark, sf))


def rubric_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return rubric.summary(scored(spark, sf), "run_id")


def rubric_by_corruption(spark: SparkSession, sf: str) -> DataFrame:
    pairs = corrupt.preference_pairs(targets(spark, sf)).join(responses(spark, sf).select(F.col("response_id").alias("id"), F.col("id").alias("request")), "id")
    both = pairs.join(clauses(spark, sf).select(F.col("id").alias("request"), "clause_text"), "request")
    return rubric.with_rubric(both, "rejected").groupBy("corruption_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("aggregate"), 10).alias("aggregate"))


# ---- pairs ----


def _corrupted(kind: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return corrupt.corrupted(targets(spark, sf), kind).where("rejected is not null").select("id", "rejected")

    return query


corrupt_drop_section = _corrupted("drop_section")
corrupt_reorder = _corrupted("reorder_sections")
corrupt_wrong_citation = _corrupted("wrong_citation")
corrupt_unsupported_claim = _corrupted("unsupported_claim")
corrupt_contradict = _corrupted("contradict_conclusion")
corrupt_truncate = _corrupted("truncate")


def dpo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return corrupt.preference_pairs(prompted_targets(spark, sf)).select(
        "id", "contract", "category", "clause_text", "prompt", "chosen", "rejected", "corruption_type"
    )


def dpo_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corrupt.training_rows(dpo_pairs(spark, sf))


def dpo_pairs_exact(spark: SparkSession, sf: str) -> DataFrame:
    return corrupt.preference_pairs_exact(targets(spark, sf)).select("id", "chosen", "rejected", "corruption_type")


def corruption_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return corrupt.preference_pairs(targets(spark, sf)).groupBy("corruption_type").agg(F.count(F.lit(1)).alias("n"))


def sft_pairs(spark: SparkSession, sf: str) -> DataFrame:
    prompts = clean.with_prompts(clauses(spark, sf)).select(F.col("id").alias("request"), "prompt")
    t = tx.with_sections(responses(spark, sf), "raw_response").select(F.col("id").alias("request"), tx.format_sections(F.col("__s")).alias("completion"))
    return t.where("completion is not null").join(prompts, "request").select("prompt", "completion")


# ---- split ----


def spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Groups named by language and source: those of one language count as one company, and share texts."""
    name = F.concat(F.coalesce("lang", F.lit("und")), F.lit("_"), F.col("source")).alias("contract")
    return table(spark, sf, "analyze_requests").select("id", name, "clause_text").distinct()


def shared_clause_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return split.shared_text_pairs(spellings(spark, sf), min_shared=1)


def duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return split.duplicate_groups(spellings(spark, sf), min_shared=3)


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_records(clauses(spark, sf), min_shared=1)


def contract_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("contract", "split").distinct()


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_counts(_split(spark, sf))


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Of the split that the table brings with it."""
    return split.leakage(clauses(spark, sf))


def split_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """The targets' split, which the table brings with it, against that of the pairs, by contract: how many ids are where."""
    where = _split(spark, sf).select("id", "split")
    brought = clauses(spark, sf).select("id", "split")
    asked = responses(spark, sf).select("response_id", "id")
    a = targets(spark, sf).where("target is not null").select(F.col("id").alias("response_id")).join(asked, "response_id").join(brought, "id")
    b = corrupt.preference_pairs(targets(spark, sf)).select(F.col("id").alias("response_id")).join(asked, "response_id").join(where, "id")
    return split.agreement(a.select("response_id", "split"), b.select("response_id", "split"), "response_id")


def contract_split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_exact(clauses(spark, sf).select("contract")).withColumnRenamed("name", "contract")


# ---- samples ----


def category_cap(spark: SparkSession, sf: str) -> DataFrame:
    return sample.capped(clauses(spark, sf).where("category is not null"), "category", 20).select("id", "category")


def id_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.sampled(clauses(spark, sf).select("id").distinct(), 150, "id")


def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = rows_scored(spark, sf).where("aggregate is not null and structure_ok is not null and groundedness is not null and length_ok is not null and no_contradiction is not null")
    keyed = s.withColumn("key", F.concat_ws("|", "run_id", "id"))
    return sample.review_sample(keyed, key="key").select("key", "sample_reason", "rubric_aggregate")


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sample.first_rows(clauses(spark, sf).select("id", "split"), 100, "id")


def smoke_subset(spark: SparkSession, sf: str) -> DataFrame:
    return sample.subset(clauses(spark, sf).select("id", "split"), {"train": 60, "valid": 20})


def review_sheet(spark: SparkSession, sf: str) -> DataFrame:
    scores = rubric.with_rubric(answered(spark, sf)).where("structure_ok = 1").select(F.col("response_id").alias("id"), *rubric.COMPONENTS, "aggregate")
    rows = sample.review_sample(scores).join(prompted_targets(spark, sf).drop("prompt"), "id")
    return sample.sheet(rows, sample.REVIEW_SHEET)


def judge_validation_join(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf).select("run_id", "id", "judge_overall", F.round("rubric_aggregate", 10).alias("rubric_aggregate"), "disagreement")


def judge_validation_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.validation_sample(validated(spark, sf)).select("run_id", "id", "sample_reason", "judge_overall", "disagreement")


def judge_review_sheet(spark: SparkSession, sf: str) -> DataFrame:
    texts = answered(spark, sf).select("run_id", "id", "category", "clause_text", "raw_response")
    rows = sample.validation_sample(validated(spark, sf)).withColumn("rubric_aggregate", F.bround("rubric_aggregate", 3))
    return sample.sheet(rows.join(texts, ["run_id", "id"]), sample.JUDGE_SHEET)


def sample_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return sample.reason_counts(sample.validation_sample(validated(spark, sf)))


# ---- summaries ----


def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    return judge.judge_summary(judged(spark, sf))


def consolidated_summary(spark: SparkSession, sf: str) -> DataFrame:
    return judge.consolidated(rubric_by_run(spark, sf), judge_summary(spark, sf))


def validation_findings(spark: SparkSession, sf: str) -> DataFrame:
    h = tx.row_seed(F.concat_ws("|", "run_id", "id")) % 4
    verdict = F.element_at(F.array(*[F.lit(v) for v in judge.VERDICTS]), (h + 1).cast("int")).alias("human_verdict")
    reviewed = sample.validation_sample(validated(spark, sf)).select("run_id", "sample_reason", "judge_overall", verdict)
    return judge.validation_findings(reviewed, "run_id", "sample_reason", "judge_overall")


# ---- resumable runs ----


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that no response answers yet."""
    return resume.pending(clauses(spark, sf).select("id").distinct(), responses(spark, sf).select("id").distinct())


def id_list_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    return resume.restricted(responses(spark, sf), id_sample(spark, sf)).select("response_id", "id")


def echo(prompts: list[str]) -> list[str]:
    """A stand-in for a model, told by the prompts' lengths alone; it is not asked for quality."""
    return [f"Issue: {len(p)}\nRule: r\nApplication: a\nConclusion: c" if len(p) % 3 else "no sections" for p in prompts]


def verdict(prompts: list[str]) -> list[str]:
    """A stand-in for a judge."""
    line = "GROUNDEDNESS: {0}\nREASONING_QUALITY: {0}\nOVERALL: {0}\nRATIONALE: {1} characters"
    return [line.format(len(p) % 5 + 1, len(p)) if len(p) % 7 else "no scores" for p in prompts]


def model_run_stub(spark: SparkSession, sf: str) -> DataFrame:
    return resume.targets(clean.with_prompts(clauses(spark, sf)), echo).select("id", "target", "parse_ok", "retried")


def model_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return resume.run_report(resume.targets(clean.with_prompts(clauses(spark, sf)), echo))


def judge_run(spark: SparkSession, sf: str) -> DataFrame:
    """The responses to a sample of ids, in two runs over the same output: the second finds nothing to do."""
    path = fresh_path(spark, "judged")
    rows = answered(spark, sf)
    for _ in range(2):
        resume.judge_run(rows, verdict, path, id_sample(spark, sf), "response_id")
    return spark.read.parquet(path).select("response_id", "judge_parse_ok", *judge.SCORES, "rationale", "judge_raw")


def generation_run(spark: SparkSession, sf: str) -> DataFrame:
    """All prompts, the first 1,000 of them in a run of their own."""
    path = fresh_path(spark, "generated")
    rows = clean.with_prompts(clauses(spark, sf)).select("id", "prompt")
    for limit in (1_000, 0):
        resume.generation_run(rows, echo, path, limit)
    return spark.read.parquet(path).select("id", "raw_response")


def analyze_batch(spark: SparkSession, sf: str) -> DataFrame:
    done = resume.analyzed(clauses(spark, sf).select("id", "category", "clause_text"), echo, "stand-in", "none")
    return done.select("id", "reason", *[s.lower() for s in tx.SECTIONS], "parse_ok", "raw_response", "model_id", "adapter_name")


def analyze_not_ready(spark: SparkSession, sf: str) -> DataFrame:
    done = resume.analyzed(clauses(spark, sf).select("id", "category", "clause_text"), None, "stand-in")
    return done.groupBy("reason", "parse_ok").agg(F.count(F.lit(1)).alias("n"))


def dry_run_gate(spark: SparkSession, sf: str) -> DataFrame:
    return resume.dry_run_gate(responses(spark, sf), "run_id")


def length_budget(spark: SparkSession, sf: str) -> DataFrame:
    where = clauses(spark, sf).select(F.col("id").alias("request"), "split")
    asked = responses(spark, sf).select(F.col("response_id").alias("id"), F.col("id").alias("request")).join(where, "request")
    return clean.length_budget(prompted_targets(spark, sf).where("target is not null").join(asked, "id"), "prompt", "target")


def training_steps(spark: SparkSession, sf: str) -> DataFrame:
    return clean.training_steps(clauses(spark, sf).where("split = 'train'"), 3, 2, 8)


# ---- sources and sinks: what is written is what is read again ----


def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = clauses(spark, sf), fresh_path(spark, "jsonl")
    io.write_jsonl(rows, path)
    return io.read_jsonl(spark, path, rows.schema)


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = clauses(spark, sf).where("clause_text is not null").select("id", "clause_text"), fresh_path(spark, "csv")
    io.write_csv(rows, path)
    return io.read_csv(spark, path, rows.schema)


def splits_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, folder = clauses(spark, sf), fresh_path(spark, "splits")
    io.write_splits(rows, folder, "sft")
    parts = {p.rsplit("/", 2)[1] for p in io.discover(spark, folder, "*.json")}
    read = [io.read_jsonl(spark, f"{folder}/{p}", rows.drop("split").schema).withColumn("split", F.lit(p.split("_")[1])) for p in sorted(parts)]
    return reduce(DataFrame.unionByName, read).select("id", "split")


def partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = clauses(spark, sf), fresh_path(spark, "partitioned")
    io.write_partitioned(rows, path)
    return spark.read.schema("id string, split string").json(path)


def ids_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    io.write_ids(id_sample(spark, sf), path)
    return io.read_ids(spark, path)


def last_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Every row delivered, keyed by its id: the file is read back with one row an id."""
    rows, path = table(spark, sf, "analyze_requests").select("id", "split", "source"), fresh_path(spark, "keyed")
    io.write_jsonl(rows, path)
    return io.read_last_by_key(spark, path, rows.schema, "id")


def summary_append(spark: SparkSession, sf: str) -> DataFrame:
    """The judge's summary in two appends to one table."""
    runs, path = judge_summary(spark, sf), fresh_path(spark, "summary")
    for even in (0, 1):
        io.append_summary(runs.where(F.crc32("run_id") % 2 == even), path)
    return spark.read.parquet(path)


_BASES = {"clauses", "responses", "answered", "scored", "rows_scored", "judged", "reviews", "source_rows", "spellings", "targets", "prompted_targets", "validated", "fresh_path", "echo", "verdict"}


def queries() -> dict[str, Query]:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ or n.startswith("corrupt_")}
    return {n: f for n, f in own.items() if not n.startswith("_") and n not in _BASES | {"queries", "judge_reply"}}
