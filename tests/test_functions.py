"""Parsing, rubric and corruptions: cases, edge cases, and Spark against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parchmill.functions import corrupt, rubric
from parchmill.functions import text as tx

CLAUSE = (
    "Either party may terminate this agreement upon thirty days written notice to the other party if the other party "
    "materially breaches any obligation and fails to cure that breach within the notice period."
)
GOOD = (
    "Issue: Whether a party may terminate upon thirty days written notice.\n\n"
    "Rule: A party may end a contract as its terms provide, if it keeps to the form and period agreed there.\n\n"
    'Application: The text says "thirty days written notice", so a party that materially breaches any obligation and fails '
    "to cure within the notice period can lose the contract.\n\n"
    "Conclusion: The right to terminate is enforceable after the notice period has run without cure."
)


def column(spark, texts, expr, *more):
    rows = [(i, t, *m) for i, (t, *m) in enumerate([(t,) if not more else (t, *x) for t, *x in (zip(texts, *more) if more else ((t,) for t in texts))])]
    schema = "i int, t string" + "".join(f", m{k} string" for k in range(len(more)))
    return [r[0] for r in spark.createDataFrame(rows, schema).orderBy("i").select(expr).collect()]


def irac(text):
    m = re.search(r"Issue:\s*(.*?)\s*Rule:\s*(.*?)\s*Application:\s*(.*?)\s*Conclusion:\s*(.*?)\s*$", text.strip(), re.S)
    return tuple(g.strip() for g in m.groups()) if m and all(g.strip() for g in m.groups()) else None


@pytest.mark.parametrize(
    "text",
    [
        GOOD, "", "   ", "Issue: a Rule: b Application: c Conclusion: d", "intro\nIssue: a\nRule: b\nApplication: c\nConclusion: d\n\n",
        "Issue: a\nRule: b\nApplication: c", "Conclusion: d\nIssue: a\nRule: b\nApplication: c", "Issue: a\nRule:\nApplication: c\nConclusion: d",
        "Issue: a Issue: b Rule: c Rule: d Application: e Conclusion: f Conclusion: g", "Issue: x $1 \\1\nRule: y\nApplication: z\nConclusion: w",
    ],
)
def test_irac_parse_equals_the_pattern(spark, text):
    got = column(spark, [text], tx.parse_irac(F.col("t")))[0]
    assert (tuple(got) if got else None) == irac(text)


def test_random_label_soups_parse_as_the_pattern_does(spark):
    rng = random.Random(1)
    parts = ["Issue:", "Rule:", "Application:", "Conclusion:", "a", "\n", " b ", "issue:", "\u00a0", "Conclusion"]
    soup = lambda n: "".join(rng.choices(parts, k=rng.randint(0, n)))
    texts = [soup(14) for _ in range(700)] + ["".join(soup(2) + (x if rng.random() < 0.9 else "") for x in parts[:4]) + soup(3) for _ in range(700)]
    got = column(spark, texts, tx.parse_irac(F.col("t")))
    assert [tuple(g) if g else None for g in got] == [irac(t) for t in texts]
    assert sum(g is not None for g in got) > 20


def test_repeated_labels_without_an_end_take_no_longer(spark):
    text = "Issue: a Rule: b Application: c " * 3_200
    column(spark, [text], tx.parse_irac(F.col("t")))
    began = time.perf_counter()
    assert column(spark, [text, text + "Conclusion: d"], tx.parse_irac(F.col("t")).isNotNull()) == [False, True]
    assert time.perf_counter() - began < 10


def test_sentences_and_titles_break_at_any_white_space(spark):
    assert column(spark, ["One.\u00a0Two.\u0085Three"], tx.sentences(F.col("t"))) == [["One.", "Two.", "Three"]]
    assert column(spark, ["Acme\u00a0Co. 12"], tx.company_key(F.col("t"))) == ["ACMECO"]


def test_null_parses_to_null_and_format_round_trips(spark):
    assert column(spark, [None], tx.parse_irac(F.col("t"))) == [None]
    assert column(spark, [GOOD], tx.format_sections(tx.parse_irac(F.col("t")))) == [GOOD]


@pytest.mark.parametrize(
    ("raw", "overall"),
    [
        ("GROUNDEDNESS: 4\nREASONING_QUALITY: 5\nOVERALL: 4\nRATIONALE: Fine.\nTwo lines.", 4),
        ("Sure:\nGROUNDEDNESS: 1\nREASONING_QUALITY: 2\nOVERALL: 3\nRATIONALE: x", 3),
        ("It is good.", None),
        ("GROUNDEDNESS: 7\nREASONING_QUALITY: 5\nOVERALL: 4\nRATIONALE: x", None),
        ("GROUNDEDNESS: 4\nREASONING_QUALITY: 5\nOVERALL: 45\nRATIONALE: x", None),
        (None, None),
    ],
)
def test_judge_parse(spark, raw, overall):
    got = column(spark, [raw], tx.parse_judge(F.col("t")))[0]
    assert (got and got["overall"]) == overall
    if raw and raw.endswith("Two lines."):
        assert got["rationale"] == "Fine.\nTwo lines."


def test_substantive(spark):
    texts = ["This", "transferable or assignable.", "If the Minimum Level has been", "One two three four five six seven eight.", None, ""]
    assert column(spark, texts, tx.is_substantive(F.col("t"))) == [False, False, False, True, False, False]


def test_quotes_words_and_keys(spark):
    assert column(spark, ['a "ab" and "abcd"'], tx.quoted_spans(F.col("t")))[0] == [" and "]
    assert sorted(column(spark, ["This Notice and the notice; shall Payment"], tx.content_words(F.col("t")))[0]) == ["notice", "payment"]
    assert column(spark, ["Acme, Inc. - Lease (2)", "12 Acme", None], tx.company_key(F.col("t"))) == ["ACMEINC", "12ACME", None]
    assert column(spark, ["\u00a0\u2003 A\x1c\n b \x85"], tx.normalized(F.col("t"))) == ["a b"]


def test_seed_is_the_digest(spark):
    import hashlib

    want = [int(hashlib.sha256(k.encode()).hexdigest(), 16) % 2**32 for k in ("a", "b", "ü")]
    assert column(spark, ["a", "b", "ü"], tx.row_seed(F.col("t"))) == want


def test_templates_end_with_a_blank_line(spark):
    p = column(spark, ["X"], tx.filled(tx.PROMPT, category=F.col("t"), clause_text=F.lit("Y")))[0]
    assert p.endswith("\n\n") and "Clause category: X\nClause text: Y\n" in p


def score(spark, response, clause=CLAUSE):
    df = spark.createDataFrame([(response, clause, 1)], "raw_response string, clause_text string, groundedness int")
    return rubric.with_rubric(df).first()


def test_good_response(spark):
    s = score(spark, GOOD)
    assert (s.structure_ok, s.groundedness, s.length_ok, s.no_contradiction) == (1, 1, 1, 1) and s.aggregate == 1


@pytest.mark.parametrize("response", [None, "", GOOD.replace("Conclusion:", "End:")])
def test_unparsed_scores_zero(spark, response):
    assert score(spark, response).aggregate == 0


def body(application="A plain reading of it.", conclusion="It stands.", rule="A rule."):
    return f"Issue: i\nRule: {rule}\nApplication: {application}\nConclusion: {conclusion}"


@pytest.mark.parametrize(
    ("change", "field", "value"),
    [
        ({"application": 'It says "no such words here".'}, "groundedness", 0),
        ({"application": 'It says "THIRTY days   written notice".'}, "groundedness", 1),
        ({"application": "to be or it is"}, "groundedness", 0),
        ({"application": "terminate upon thirty days written notice", "rule": "There is binding precedent."}, "groundedness", 0),
        ({"application": "terminate upon thirty days written notice", "rule": "A condition precedent must be met."}, "groundedness", 1),
        ({"application": "The clause is enforceable.", "conclusion": "The clause is unenforceable."}, "no_contradiction", 0),
        ({"application": "The clause is enforceable.", "conclusion": "So it is enforceable."}, "no_contradiction", 1),
        ({"application": "It may be unenforceable.", "conclusion": "It is enforceable."}, "no_contradiction", 1),
        ({"application": "It is évalid here.", "conclusion": "It is invalid."}, "no_contradiction", 1),
        ({"conclusion": "Contrary to the above, it fails."}, "no_contradiction", 0),
        ({"conclusion": "It caps all, but it is unclear if that holds."}, "no_contradiction", 0),
        ({"conclusion": "It is unclear whether that holds."}, "no_contradiction", 1),
    ],
)
def test_rubric_cases(spark, change, field, value):
    assert score(spark, body(**change))[field] == value


def test_length_is_graded(spark):
    texts = ["w " * 4, "w " * 40, "w " * 400, "w " * 800]
    assert column(spark, texts, rubric.length_score(F.col("t"))) == [0.1, 1.0, 1.0, 0.5]


def test_empty_summary_and_clashing_names(spark):
    df = spark.createDataFrame([], "raw_response string, clause_text string, aggregate string")
    s = rubric.summary(rubric.with_rubric(df)).first()
    assert s.n == 0 and s.aggregate is None


@pytest.mark.parametrize("kind", corrupt.TYPES)
def test_each_corruption_changes_the_text(spark, kind):
    rows = spark.createDataFrame([(f"k{i}", GOOD) for i in range(40)], "id string, target string")
    out = [r.rejected for r in corrupt.corrupted(rows, kind).collect()]
    assert all(t and t != GOOD for t in out)
    if kind == "drop_section":
        assert all(sum(f"{n}:" in t for n in tx.SECTIONS) == 3 for t in out) and len(set(out)) == 4
    if kind == "reorder_sections":
        assert all(irac(t) is None and len(t) == len(GOOD) for t in out)
    if kind == "truncate":
        assert all(GOOD.startswith(t) and 0.49 <= len(t) / len(GOOD) <= 0.86 for t in out)


@pytest.mark.parametrize(("kind", "field"), [("unsupported_claim", "groundedness"), ("contradict_conclusion", "no_contradiction"), ("wrong_citation", "groundedness")])
def test_corruptions_lower_the_score(spark, kind, field):
    rows = spark.createDataFrame([(f"k{i}", GOOD, CLAUSE) for i in range(20)], "id string, target string, clause_text string")
    got = rubric.with_rubric(corrupt.corrupted(rows, kind), "rejected").collect()
    assert all(r[field] < 1 for r in got)


def test_pairs_cover_all_types_skip_unparsed_and_repeat(spark):
    rows = spark.createDataFrame([(f"k{i}", GOOD) for i in range(120)] + [("x", "no sections"), ("y", None)], "id string, target string")
    for make in (corrupt.preference_pairs, corrupt.preference_pairs_exact):
        a, b = make(rows).collect(), make(rows).collect()
        assert len(a) == 120 and {r.corruption_type for r in a} == set(corrupt.TYPES) and sorted(map(str, a)) == sorted(map(str, b))
