"""Splits, components, samples, judgements, cleaning, connectors and resumable runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parchmill import session
from parchmill.operators import clean, judge, sample, split
from parchmill.sources import io
from parchmill.streaming import resume


def groups(spark, n, per=2, text="t"):
    return spark.createDataFrame([(f"C{i:04d}", f"{text} {i} {k}") for i in range(n) for k in range(per)], "contract string, clause_text string")


@pytest.mark.parametrize(("n", "want"), [(1000, (800, 100, 100)), (7, (6, 1, 0)), (1, (1, 0, 0)), (100, (80, 10, 10))])
def test_split_is_exact_and_repeats(spark, n, want):
    names = groups(spark, n).select("contract")
    a = {r.name: r.split for r in split.assign_groups(names).collect()}
    assert len(a) == n and tuple(sum(v == s for v in a.values()) for s in split.RATIOS) == want
    assert a == {r.name: r.split for r in split.assign_groups(names.repartition(7)).collect()}
    if n == 1000:
        assert a != {r.name: r.split for r in split.assign_groups(names, seed=1).collect()}


def test_split_exact_is_the_seeded_shuffle():
    names = [f"n{i}" for i in range(50)]
    got = split.assign_groups_exact(names * 2)
    order = sorted(names)
    random.Random(42).shuffle(order)
    assert [got[n] for n in order] == ["train"] * 40 + ["valid"] * 5 + ["test"] * 5


def test_split_keeps_rows_and_leaks_nothing(spark):
    df = groups(spark, 60, 4).withColumn("split", F.lit("old")).withColumn("id", F.monotonically_increasing_id())
    out = split.split_records(df)
    assert out.count() == 240 and not any(r.leaks for r in split.leakage(out).collect()) and "old" not in {r.split for r in out.collect()}


def test_split_of_nothing_and_of_null_groups(spark):
    empty = spark.createDataFrame([], "contract string, clause_text string")
    assert split.split_records(empty).isEmpty() and split.duplicate_groups(empty).isEmpty()
    nulls = spark.createDataFrame([(None, "a"), ("x", None)], "contract string, clause_text string")
    assert {r.contract: r.split for r in split.split_records(nulls).collect()} == {None: None, "x": "train"}


def test_duplicate_spellings_merge_and_other_companies_do_not(spark):
    shared = [f"shared clause {k}" for k in range(5)]
    rows = [("Acme Inc. - Lease (1)", t) for t in shared[:4]] + [("ACME INC - Lease (2)", t) for t in shared[:4]] + [("Other Ltd. - Lease", t) for t in shared]
    df = spark.createDataFrame(rows + rows, "contract string, clause_text string")
    got = {r.contract: r.canonical for r in split.duplicate_groups(df).collect()}
    assert got == dict.fromkeys(("Acme Inc. - Lease (1)", "ACME INC - Lease (2)"), "ACME INC - Lease (2)")
    assert split.duplicate_groups(df, min_shared=5).isEmpty()


def test_components_of_a_v_a_chain_and_a_cycle(spark):
    edges = [("1", "3"), ("2", "3"), ("7", "8")] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {r.node: r.root for r in split.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert [got[k] for k in "12378"] == ["1", "1", "1", "7", "7"] and got["c060"] == "c000" and {got[k] for k in "xyz"} == {"x"}


def test_numbered_ranks_across_partitions(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("v")).repartition(9)
    assert all(r.v == r.rank for r in split.numbered(df, "v").collect())


def test_cap_takes_all_of_small_groups(spark):
    df = spark.createDataFrame([(str(i), "hot" if i % 3 else "small") for i in range(90)], "id string, category string")
    n = {r.category: r["count"] for r in sample.capped(df, "category", 40).groupBy("category").count().collect()}
    assert n == {"hot": 40, "small": 30}
    assert sample.capped(df.limit(0), "category", 5).isEmpty()


def judgements(spark, n=30):
    rows = [("r", f"i{k:02d}", "c", "t", "a", (k % 10) / 9.0) for k in range(n)]
    scored = spark.createDataFrame(rows, "run_id string, id string, category string, clause_text string, raw_response string, aggregate double")
    j = [("r", f"i{k:02d}", k != 5, 1, 2, k % 5 + 1, "why") for k in range(n)]
    judged = spark.createDataFrame(j, "run_id string, id string, judge_parse_ok boolean, groundedness int, reasoning_quality int, overall int, rationale string")
    return scored, judged


def test_join_drops_failed_and_measures_disagreement(spark):
    joined = judge.judged_with_rubric(*judgements(spark)).collect()
    assert len(joined) == 29 and all(r.disagreement == round(abs(r.rubric_aggregate - (r.judge_overall - 1) / 4), 3) for r in joined)


def test_three_strata_are_disjoint(spark):
    got = sample.validation_sample(judge.judged_with_rubric(*judgements(spark)), 5, 3, 2).collect()
    assert len(got) == 10 and len({(r.run_id, r.id) for r in got}) == 10
    assert sum(r.sample_reason == "low_judge_score" for r in got) == 5 and sum(r.sample_reason == "rubric_judge_disagreement" for r in got) == 3
    assert all(r.judge_overall == 1 for r in got if r.sample_reason == "low_judge_score")


def test_judge_summary_counts_all_and_means_the_parsed(spark):
    s = judge.judge_summary(judgements(spark)[1]).first()
    assert s.n == 30 and s.groundedness == 1 and abs(s.parse_ok_rate - 29 / 30) < 1e-9


def test_clean_report_counts_bad_before_fragments(spark):
    long = "one two three four five six seven eight"
    df = spark.createDataFrame([("a", long), ("b", "x"), ("c", "y"), ("d", None)], "id string, clause_text string").withColumn("__x", F.lit(1))
    bad = spark.createDataFrame([("b", "bad"), ("a", "good"), ("b", "bad")], "id string, verdict string")
    r = clean.clean_report(df, clean.known_bad_ids(bad)).first()
    assert (r.start, r.removed_known_bad, r.removed_fragments, r.final) == (4, 1, 2, 1)
    assert [x.id for x in clean.cleaned(df, clean.known_bad_ids(bad)).collect()] == ["a"]


def test_source_filter(spark):
    long = " one two three four five six seven eight "
    rows = [("1", "T", 'x related to "Cap" y', ([long],)), ("2", "T", 'related to "Parties"', ([long],)), ("3", "T", "none", ([long],)),
            ("4", "T", 'related to "Cap"', ([],)), ("5", "T", 'related to "Cap"', (None,)), ("6", "T", 'related to "Cap"', (["short"],))]
    df = spark.createDataFrame(rows, "id string, title string, question string, answers struct<text: array<string>>")
    got = clean.clauses_from_source(df).collect()
    assert [(r.id, r.category, r.clause_text) for r in got] == [("1", "Cap", long.strip())]


def test_jsonl_keeps_nulls_and_skips_blank_lines(spark, tmp_path):
    io.write_jsonl(spark.createDataFrame([("a", None)], "id string, target string").coalesce(1), f"{tmp_path}/o")
    text = next((tmp_path / "o").glob("part*")).read_text()
    assert json.loads(text) == {"id": "a", "target": None}
    (tmp_path / "in.jsonl").write_text('{"id": "1"}\n\n   \n{"id": "2"}\n{"id": "1", "v": 3}\n')
    assert io.read_jsonl(spark, f"{tmp_path}/in.jsonl", "id string, v int").count() == 3
    assert {r.id: r.v for r in io.read_last_by_key(spark, f"{tmp_path}/in.jsonl", "id string, v int", "id").collect()} == {"1": 3, "2": None}
    with pytest.raises(Exception):
        io.read_jsonl(spark, f"{tmp_path}/in.jsonl", "id string", strict=True).collect()


def test_csv_cells_with_line_breaks_and_missing_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q"\ny')], "id string, note string")
    io.export_csv(df, f"{tmp_path}/c")
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_path}/c", "id string, note string").collect()] == [("a", 'x "q"\ny')]
    assert io.read_csv(spark, f"{tmp_path}/none", "id string").isEmpty()


def test_ids_splits_summaries_and_discovery(spark, tmp_path):
    io.write_ids(spark.createDataFrame([("b",), ("a",)], "id string"), f"{tmp_path}/ids")
    assert {r.id for r in io.read_ids(spark, f"{tmp_path}/ids").collect()} == {"a", "b"}
    io.write_splits(spark.createDataFrame([("a", "train"), ("b", "test"), ("c", None)], "id string, split string"), str(tmp_path), "sft")
    assert [r.id for r in io.read_jsonl(spark, f"{tmp_path}/sft_train", "id string").collect()] == ["a"]
    for k in range(2):
        io.append_summary(spark.createDataFrame([(f"r{k}", 1)], "run_id string, n int"), f"{tmp_path}/sum")
    assert spark.read.parquet(f"{tmp_path}/sum").count() == 2
    for d in ("x/adapter.json", "dryrun/adapter.json"):
        (tmp_path / d).parent.mkdir()
        (tmp_path / d).write_text("{}")
    assert io.discover_one(spark, str(tmp_path), "adapter.json").endswith("/x")
    with pytest.raises(FileNotFoundError):
        io.discover_one(spark, str(tmp_path), "adapter.json", exclude=())


def model():
    """A stand-in for a model; made inside a function, so that it travels to the workers by value."""

    def echo(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("down")
        return ["Issue: a\nRule: b\nApplication: c\nConclusion: d" if "ONLY" in p or "easy" in p else "?" for p in prompts]

    return echo


def test_run_retries_and_marks_errors(spark):
    df = spark.createDataFrame([("1", "easy"), ("2", "hard"), ("3", "boom"), ("4", None)], "id string, teacher_prompt string")
    got = {r.id: r for r in resume.targets(df, model(), batch=1).collect()}
    assert got["1"].parse_ok and got["2"].parse_ok and not got["3"].parse_ok and "down" in got["3"].error and got["4"].target is None
    assert not {r.id: r.parse_ok for r in resume.targets(df, model(), retry=False, batch=1).collect()}["2"]


def test_resume_runs_what_is_pending(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "easy" if i else "hard") for i in range(4)], "id string, teacher_prompt string")
    step = lambda d: resume.targets(d, model(), retry=False, batch=1)
    out = f"{tmp_path}/out"
    assert [resume.resume(rows.limit(2), step, out), resume.resume(rows, step, out), resume.resume(rows, step, out)] == [2, 2, 0]
    assert resume.resume(rows, step, out, retry_failed=True) == 1


def test_stream_appends_once(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    for k in range(2):
        spark.createDataFrame([(str(i), "easy") for i in range(2 * k, 2 * k + 3)], "id string, teacher_prompt string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id string, teacher_prompt string").parquet(src)
        resume.resume_stream(stream, lambda d: resume.targets(d, model()), out, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["0", "1", "2", "3", "4"]


def test_one_per_key_keeps_null_keys_once_and_shuffles_no_text(spark):
    rows = [("a", "x"), ("a", "x"), (None, "n"), (None, "n"), ("b", "y"), ("c", None)]
    df = spark.createDataFrame(rows, "id string, t string")
    assert sorted(map(str, (tuple(r) for r in clean.one_per_key(df, "id").collect()))) == sorted(map(str, {*rows}))
    assert clean.one_per_key(df.limit(0), "id").isEmpty()
    plan = clean.one_per_key(df.where("id = 'b'"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_first_rows_subset_and_sheets(spark):
    df = spark.createDataFrame([(f"{i:02d}", "train" if i % 2 else "valid") for i in range(20)], "id string, split string")
    assert [sample.first_rows(df, n, "id").count() for n in (3, 0, None)] == [3, 20, 20]
    got = sample.subset(df, {"train": 4, "valid": 30, "none": 2}).collect()
    assert sum(r.split == "train" for r in got) == 4 and len(got) == 14
    row = sample.sheet(spark.createDataFrame([("1", None)], "id string, category string"), sample.REVIEW_SHEET).first()
    assert tuple(row.asDict()) == sample.REVIEW_SHEET and row.id == "1" and row.category == row.reviewer_verdict == row.target == ""


def test_analysis_to_the_end_and_why_it_is_turned_away(spark):
    clause = "The Buyer shall pay the agreed price within ten days after delivery."
    df = spark.createDataFrame([("1", "Cap", clause), ("2", "Cap", ""), ("3", "Cap", None), ("4", None, "Void."), ("5", "x", clause + " boom")], "id string, category string, clause_text string")

    def reply(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("down")
        return ["Issue: a Rule: b Application: c Conclusion: d"] * len(prompts)

    got = {r.id: r for r in resume.analyzed(df, reply, "m", batch=1).collect()}
    assert [got[k].reason for k in "12345"] == [None, "empty", "empty", "not substantive", None]
    assert (got["1"].issue, got["1"].conclusion, got["1"].parse_ok, got["1"].model_id, got["1"].adapter_name) == ("a", "d", True, "m", None)
    assert not got["5"].parse_ok and "down" in got["5"].error and got["5"].issue is None
    assert {r.reason for r in resume.analyzed(df, None, "m").collect()} == {"model not loaded"}


def test_judge_and_generation_runs_do_what_is_left(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "c", "t", "z" * i, "p") for i in range(6)], "id string, category string, clause_text string, raw_response string, prompt string")
    ids = spark.createDataFrame([("1",), ("2",), ("9",)], "id string")

    def scores(prompts):
        return ["GROUNDEDNESS: 4\nREASONING_QUALITY: 5\nOVERALL: 3\nRATIONALE: ok" if "zz" in p else "?" for p in prompts]

    def parrot(prompts):
        return prompts

    assert [resume.judge_run(rows, scores, f"{tmp_path}/j", ids), resume.judge_run(rows, scores, f"{tmp_path}/j", ids), resume.judge_run(rows, scores, f"{tmp_path}/j")] == [2, 0, 4]
    assert {r.id: r.overall for r in spark.read.parquet(f"{tmp_path}/j").collect()} == {"0": None, "1": None, **dict.fromkeys("2345", 3)}
    assert [resume.generation_run(rows.drop("raw_response"), parrot, f"{tmp_path}/g", n) for n in (2, 0, None)] == [2, 4, 0]
    gate = resume.dry_run_gate(spark.createDataFrame([("a", " Issue: x"), ("a", None), ("b", "Issue: y")], "run string, raw_response string"), "run")
    assert {r.run: (r.n, r.n_bad, r.passes) for r in gate.collect()} == {"a": (2, 1, False), "b": (1, 0, True)}


def test_agreement_steps_and_too_many_names(spark, monkeypatch):
    a = spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string")
    b = spark.createDataFrame([("1", "train"), ("3", "valid")], "id string, split string")
    assert {(r.split_a, r.split_b): r.n for r in split.agreement(a, b).collect()} == {("train", "train"): 1, ("test", None): 1, (None, "valid"): 1}
    assert tuple(clean.training_steps(spark.range(5987), 3, 2, 8).first()) == (5987, 16, 1125)
    assert dict(r for r in split.split_exact(a.select("id")).collect()).keys() == {"1", "2"}
    monkeypatch.setattr(split, "MAX_NAMES", 1)
    with pytest.raises(ValueError):
        split.split_exact(a.select("id"))


def test_settings_and_own_folder(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": 1}')
    assert io.read_settings(spark, f"{tmp_path}/s.json") == {"a": 1}
    kept = session.written(spark.range(3), "x")
    folder = session.own_folder(spark)
    assert kept.count() == 3 and folder.split(":")[-1].strip("/") in kept.inputFiles()[0]
