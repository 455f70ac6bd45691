"""The core's results as SQL over the same tables. Each text is put together from the fragments below."""

from __future__ import annotations

import re

from parchmill.functions import corrupt, rubric
from parchmill.functions import text as tx
from parchmill.operators import clean


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


NL2 = "(chr(10) || chr(10))"

# ---- bases ----
C = "c AS (SELECT DISTINCT id, contract, category, clause_text, split FROM analyze_requests)"
R = "r AS (SELECT DISTINCT response_id, run_id, id, contract, category, raw_response FROM analyze_responses)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(tx.EDGES)}, '', 'g')"


def normalized(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), {lit(tx.SPACE + '+')}, ' ', 'g')"


def seed(x: str) -> str:
    return f"CAST('0x' || right(sha256({x}), 8) AS BIGINT)"


def order(seed_number: int, x: str) -> str:
    return f"md5('{seed_number}:' || {x})"


def substantive(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '[a-zA-Z]{{2,}}')), 0) >= {tx.MIN_CLAUSE_WORDS}"


def parsed(name: str, source: str, text: str) -> str:
    """CTE: ``source`` with the section bodies s1 to s4, rows that parse only."""
    groups = ", ".join(f"regexp_extract(t__, {lit(tx.IRAC_PATTERN)}, {i}) AS s{i}" for i in range(1, 5))
    return (
        f"{name}__ AS (SELECT *, {strip(text)} AS t__ FROM {source}), "
        f"{name} AS (SELECT * EXCLUDE (t__) FROM (SELECT *, {groups} FROM {name}__) WHERE s1 <> '' AND s2 <> '' AND s3 <> '' AND s4 <> '')"
    )


def formatted(s: tuple[str, ...] = ("s1", "s2", "s3", "s4"), names: tuple[str, ...] = tx.SECTIONS) -> str:
    return f" || {NL2} || ".join(f"'{n}: ' || {c}" for n, c in zip(names, s))


def content(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-zA-Z]{{4,}}'), lambda w: NOT list_contains({items(tx.STOPWORDS)}, w)))"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, {lit('([.!?])' + tx.SPACE + '+')}, '\\1' || chr(1), 'g'), chr(1))"


def said(x: str) -> str:
    hedged = lit(rubric.any_of(rubric.HEDGES))
    return f"array_to_string(list_filter({sentences(f'lower({x})')}, lambda s: NOT regexp_matches(s, {hedged})), chr(10) || '|' || chr(10))"


def has(x: str, term: str) -> str:
    return "regexp_matches(" + x + ", " + lit(rf"(^|[^\p{{L}}\p{{N}}_]){term}([^\p{{L}}\p{{N}}_]|$)") + ")"


def scored(name: str, source: str, text: str, keys: str) -> str:
    """CTE: ``keys`` and the rubric of each row of ``source``, which has clause_text."""
    clash = " OR ".join(
        f"({has('fa', p)} AND NOT {has('fa', n)} AND {has('fc', n)} AND NOT {has('fc', p)}) OR "
        f"({has('fa', n)} AND NOT {has('fa', p)} AND {has('fc', p)} AND NOT {has('fc', n)})"
        for p, n in rubric.OPPOSITES
    )
    undermined = (
        f"len(list_filter({sentences('lower(s4)')}, lambda s: regexp_matches(s, {lit(rubric.any_of(rubric.UNCERTAIN))}) "
        f"AND regexp_matches(s, {lit(rubric.any_of(rubric.CONTRASTS))}))) > 0"
    )
    groups = ", ".join(f"regexp_extract({strip(text)}, {lit(tx.IRAC_PATTERN)}, {i}) AS s{i}" for i in range(1, 5))
    return f"""
{name}_a AS (SELECT {keys}, {text} AS raw__, coalesce(clause_text, '') AS clause__, {groups} FROM {source}),
{name}_b AS (SELECT *, coalesce(s1 <> '' AND s2 <> '' AND s3 <> '' AND s4 <> '', false) AS ok__,
    regexp_extract_all(s3, {lit(tx.QUOTE_PATTERN)}, 1) AS q__, {content('s3')} AS aw__, {content('clause__')} AS cw__,
    {normalized('clause__')} AS cn__, len(regexp_extract_all(raw__, '[a-zA-Z]+')) AS n__, {said('s3')} AS fa, {said('s4')} AS fc FROM {name}_a),
{name}_c AS (SELECT {keys}, ok__,
    CASE WHEN ok__ THEN 1.0 ELSE 0.0 END AS structure_ok,
    CASE WHEN NOT ok__ THEN 0.0 ELSE least(
        CASE WHEN len(q__) > 0 THEN len(list_filter(q__, lambda z: contains(cn__, {normalized('z')}))) / len(q__)::DOUBLE
             WHEN len(aw__) = 0 THEN 0.0
             ELSE least(1.0, len(list_intersect(aw__, cw__)) / greatest(round_even(len(aw__) * {rubric.OVERLAP_SHARE}::DOUBLE, 0), 1.0)) END,
        CASE WHEN regexp_matches(lower(s2), {lit(rubric.any_of(rubric.AUTHORITY_FLAGS))}) THEN 0.0 ELSE 1.0 END) END AS groundedness,
    CASE WHEN NOT ok__ THEN 0.0 WHEN n__ < {rubric.MIN_WORDS} THEN n__ / {rubric.MIN_WORDS}::DOUBLE
         WHEN n__ > {rubric.MAX_WORDS} THEN {rubric.MAX_WORDS}::DOUBLE / n__ ELSE 1.0 END AS length_ok,
    CASE WHEN NOT ok__ THEN 0.0 WHEN regexp_matches(lower(s4), {lit(rubric.any_of(rubric.REVERSAL_CUES))}) THEN 0.0
         WHEN {undermined} THEN 0.0 WHEN {clash} THEN 0.0 ELSE 1.0 END AS no_contradiction FROM {name}_b),
{name} AS (SELECT *, (structure_ok + groundedness + length_ok + no_contradiction) / 4 AS aggregate FROM {name}_c)"""


def summary(source: str, by: str = "") -> str:
    means = ", ".join(f"round(avg({c}), 10) AS {c}" for c in (*rubric.COMPONENTS, "aggregate"))
    head = f"{by}, " if by else ""
    return f"SELECT {head}count(*) AS n, {means}, round(avg(CASE WHEN structure_ok = 1 THEN 1 ELSE 0 END), 10) AS parse_ok_rate FROM {source}" + (
        f" GROUP BY {by}" if by else ""
    )


ANSWERED = f"{C}, {R}, a AS (SELECT r.*, c.clause_text FROM r JOIN (SELECT DISTINCT id, clause_text FROM c) c ON r.id = c.id)"
SCORED = f"{ANSWERED}, {scored('sc', 'a', 'raw_response', 'response_id, run_id, id, category, clause_text, raw_response')}"


def judge_reply(key: str) -> str:
    h = seed(key)
    n = lambda d: f"CAST(({h} // {d}) % 5 + 1 AS VARCHAR)"
    body = (
        f"'GROUNDEDNESS: ' || {n(10)} || chr(10) || 'REASONING_QUALITY: ' || {n(50)} || chr(10) || 'OVERALL: ' || {n(250)} || chr(10) "
        "|| 'RATIONALE: The score rests' || chr(10) || 'on the clause. '"
    )
    return (
        f"CASE WHEN {h} % 10 = 0 THEN 'The analysis is adequate.' WHEN {h} % 10 = 1 THEN regexp_replace({body}, 'OVERALL: \\d', 'OVERALL: 7', 'g') "
        f"WHEN {h} % 10 = 2 THEN 'Here is my verdict.' || chr(10) || {body} ELSE {body} END"
    )


_J = ", ".join(f"regexp_extract({strip('reply')}, {lit(tx.JUDGE_PATTERN)}, {i}) AS g{i}" for i in range(1, 5))
JUDGED = f"""
j_a AS (SELECT run_id, id, response_id, {judge_reply('response_id')} AS reply FROM r),
j_b AS (SELECT *, {_J} FROM j_a),
j AS (SELECT run_id, id, response_id, g1 <> '' AS judge_parse_ok,
    CASE WHEN g1 <> '' THEN CAST(g1 AS INTEGER) END AS groundedness, CASE WHEN g1 <> '' THEN CAST(g2 AS INTEGER) END AS reasoning_quality,
    CASE WHEN g1 <> '' THEN CAST(g3 AS INTEGER) END AS overall, CASE WHEN g1 <> '' THEN {strip('g4')} END AS rationale,
    CASE WHEN g1 = '' THEN reply END AS judge_raw FROM j_b)"""
JOINED = f"""
{SCORED}, {JUDGED},
v AS (SELECT *, round_even(abs(rubric_aggregate - (judge_overall - 1) / 4.0::DOUBLE), 3) AS disagreement
    FROM (SELECT sc.run_id, sc.id, j.groundedness AS judge_groundedness, j.reasoning_quality AS judge_reasoning_quality, j.overall AS judge_overall,
              j.rationale AS judge_rationale, sc.aggregate AS rubric_aggregate
          FROM sc JOIN j ON sc.run_id = j.run_id AND sc.id = j.id WHERE j.judge_parse_ok))"""

REVIEWS = f"w AS (SELECT id, CASE WHEN {seed('id')} % 50 = 0 THEN 'bad' WHEN {seed('id')} % 50 < 10 THEN 'minor' ELSE 'good' END AS verdict FROM c)"
QUESTION = "'Highlight the parts (if any) related to \"' || category || '\" that should be reviewed.'"

TARGETS = f"{R}, {parsed('p', 'r', 'raw_response')}, t AS (SELECT response_id AS id, contract, category, {formatted()} AS target FROM p), " + parsed("tp", "t", "target")


def bare_end(x: str) -> str:
    return f"regexp_replace({x}, '[. ]+$', '')"


def pick(values, at: str) -> str:
    return f"({items(values)})[CAST({at} % {len(values)} + 1 AS BIGINT)]"


def corruption(kind: str, h: str) -> str:
    s = ("s1", "s2", "s3", "s4")
    if kind == "drop_section":
        cases = " ".join(
            f"WHEN {k} THEN {formatted(tuple(c for i, c in enumerate(s) if i != k), tuple(n for i, n in enumerate(tx.SECTIONS) if i != k))}" for k in range(4)
        )
        return f"CASE {h} % 4 {cases} END"
    if kind == "reorder_sections":
        cases = " ".join(f"WHEN {k} THEN {formatted(tuple(s[tx.SECTIONS.index(n)] for n in o), o)}" for k, o in enumerate(corrupt.ORDERS))
        return f"CASE {h} % {len(corrupt.ORDERS)} {cases} END"
    if kind == "wrong_citation":
        return formatted(("s1", "s2", f"{bare_end('s3')} || {lit(corrupt.CITED)} || {pick(corrupt.FAKE_QUOTES, h)} || '.\"'", "s4"))
    if kind == "unsupported_claim":
        return formatted(("s1", f"{bare_end('s2')} || '.' || {pick(corrupt.CLAIMS, h)}", "s3", "s4"))
    if kind == "contradict_conclusion":
        return formatted(("s1", "s2", "s3", pick(corrupt.CONCLUSIONS, h)))
    full = f"({formatted()})"
    low, high = (f"CAST(floor(length({full}) * {f}::DOUBLE) AS BIGINT)" for f in (corrupt.CUT_FROM, corrupt.CUT_TO))
    return f"regexp_replace(substr({full}, 1, {low} + {h} % ({high} - {low} + 1)), {lit(tx.SPACE + '+$')}, '')"


def corrupted(kind: str) -> str:
    return f"WITH {TARGETS} SELECT id, {corruption(kind, f'({seed("id")} // 6)')} AS rejected FROM tp"


_CASES = " ".join(f"WHEN {k} THEN {corruption(t, '(h // 6)')}" for k, t in enumerate(corrupt.TYPES))
PAIRS = f"""{TARGETS}, th AS (SELECT *, {seed('id')} AS h FROM tp),
d AS (SELECT id, contract, category, target AS chosen, CASE h % 6 {_CASES} END AS rejected, {pick(corrupt.TYPES, 'h')} AS corruption_type FROM th)"""

_HEAD = f"regexp_extract(contract, {lit('^[A-Za-z][A-Za-z,.' + tx.SPACE[1:] + '*')})"
KEY = f"regexp_replace(upper(CASE WHEN {_HEAD} <> '' THEN {_HEAD} ELSE contract END), '[^A-Z0-9]', '', 'g')"
SHARED = f"""{C},
k AS (SELECT DISTINCT contract, clause_text, {KEY} AS k FROM c WHERE contract IS NOT NULL AND clause_text IS NOT NULL),
e AS (SELECT x.contract AS a, y.contract AS b, count(*) AS shared FROM k x JOIN k y ON x.k = y.k AND x.clause_text = y.clause_text AND x.contract < y.contract GROUP BY 1, 2)"""
COMPONENTS = f"""{SHARED},
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.seen = u.a),
g AS (SELECT node AS contract, min(seen) AS canonical FROM reach GROUP BY 1)"""
SPELLINGS = "c AS (SELECT DISTINCT id, coalesce(lang, 'und') || '_' || source AS contract, clause_text FROM analyze_requests)"
SPLIT = f"""{COMPONENTS},
m AS (SELECT c.* EXCLUDE (split), coalesce(g.canonical, c.contract) AS canonical FROM c LEFT JOIN g ON c.contract = g.contract),
o AS (SELECT canonical, row_number() OVER (ORDER BY {order(42, 'canonical')}, canonical) - 1 AS rank, count(*) OVER () AS total
    FROM (SELECT DISTINCT canonical FROM m WHERE canonical IS NOT NULL)),
f AS (SELECT canonical, CASE WHEN rank < round_even(total * 0.8::DOUBLE, 0) THEN 'train'
    WHEN rank < round_even(total * 0.8::DOUBLE, 0) + round_even(total * 0.1::DOUBLE, 0) THEN 'valid' ELSE 'test' END AS split FROM o),
s AS (SELECT m.*, f.split FROM m LEFT JOIN f ON m.canonical = f.canonical)"""


def template(text: str, columns: dict[str, str]) -> str:
    parts = [f"coalesce({columns[p[1:-1]]}, '')" if p[:1] == "{" and p[1:-1] in columns else lit(p) for p in re.split(r"(\{\w+\})", text) if p]
    return " || ".join(parts)


_FIELDS = {"category": "category", "clause_text": "clause_text"}
_DPO = f"""{PAIRS}, {C}, ans AS (SELECT r.response_id, c.clause_text FROM r JOIN c ON r.id = c.id),
dp AS (SELECT d.id, d.contract, d.category, ans.clause_text, {template(tx.PROMPT, {"category": "d.category", "clause_text": "ans.clause_text"})} AS prompt,
    chosen, rejected, corruption_type FROM d JOIN ans ON d.id = ans.response_id)"""
_VALIDATION = f"""{JOINED},
v1 AS (SELECT *, 'low_judge_score' AS sample_reason FROM v ORDER BY judge_overall, run_id, id LIMIT 15),
v2 AS (SELECT *, 'rubric_judge_disagreement' AS sample_reason FROM v WHERE (run_id, id) NOT IN (SELECT (run_id, id) FROM v1) ORDER BY disagreement DESC, run_id, id LIMIT 10),
v3 AS (SELECT *, 'random' AS sample_reason FROM v WHERE (run_id, id) NOT IN (SELECT (run_id, id) FROM v1) AND (run_id, id) NOT IN (SELECT (run_id, id) FROM v2)
       ORDER BY md5('42:' || run_id || '|' || id), run_id, id LIMIT 10),
vs AS (FROM v1 UNION ALL FROM v2 UNION ALL FROM v3)"""
_SHEET = f"""{SCORED}, {parsed("pa", "a", "raw_response")},
z AS (SELECT response_id AS id, round_even(structure_ok, 3) AS so, round_even(groundedness, 3) AS gr, round_even(length_ok, 3) AS lo,
    round_even(no_contradiction, 3) AS nc, round_even(aggregate, 3) AS ag FROM sc WHERE structure_ok = 1),
low AS (SELECT *, 'low_rubric_score' AS sample_reason FROM z ORDER BY ag, id LIMIT 25),
ran AS (SELECT *, 'random' AS sample_reason FROM z WHERE id NOT IN (SELECT id FROM low) ORDER BY md5('42:' || id), id LIMIT 35),
zs AS (FROM low UNION ALL FROM ran)"""


def text_of(*columns: str) -> str:
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c.split('.')[-1]}" for c in columns)


def echoed(n: str, gap: str = "chr(10)") -> str:
    """What the stand-in for a model answers to a prompt of ``n`` characters."""
    return f"'Issue: ' || {n} || {gap} || 'Rule: r' || {gap} || 'Application: a' || {gap} || 'Conclusion: c'"


_JUDGED_FIELDS = _FIELDS | {"response": "raw_response"}
_STUB = f"""{C}, n1 AS (SELECT id, length({template(tx.TEACHER_PROMPT, _FIELDS)}) AS n FROM c),
n2 AS (SELECT id, n % 3 = 0 AS retried, CASE WHEN n % 3 = 0 THEN n + {len(tx.RETRY_SUFFIX)} ELSE n END AS n FROM n1)"""
_SAMPLE_BASE = """z AS (SELECT DISTINCT run_id || '|' || id AS key, round_even(aggregate, 3) AS rubric_aggregate,
    run_id, id, structure_ok, groundedness, length_ok, no_contradiction, aggregate FROM rubric_scores
    WHERE aggregate IS NOT NULL AND structure_ok IS NOT NULL AND groundedness IS NOT NULL AND length_ok IS NOT NULL AND no_contradiction IS NOT NULL),
low AS (SELECT key, 'low_rubric_score' AS sample_reason, rubric_aggregate FROM z ORDER BY rubric_aggregate, key LIMIT 25),
ran AS (SELECT key, 'random' AS sample_reason, rubric_aggregate FROM z WHERE key NOT IN (SELECT key FROM low) ORDER BY md5('42:' || key), key LIMIT 35),
rs AS (SELECT * FROM low UNION ALL SELECT * FROM ran)"""


def sql() -> dict[str, str]:
    out = {
        "irac_parse": f"WITH {R}, {parsed('p', 'r', 'raw_response')} SELECT response_id, s1 AS Issue, s2 AS Rule, s3 AS Application, s4 AS Conclusion FROM p",
        "irac_format_roundtrip": f"WITH {TARGETS} SELECT t.id, t.target, ({formatted()}) = t.target AS stable FROM t LEFT JOIN tp ON t.id = tp.id",
        "irac_parse_failures": f"WITH {R}, {parsed('p', 'r', 'raw_response')} SELECT run_id, count(*) - count(p.response_id) AS n_failed, count(*) AS n "
        "FROM r LEFT JOIN (SELECT response_id FROM p) p USING (response_id) GROUP BY 1",
        "judge_parse": f"WITH {R}, {JUDGED} SELECT response_id, judge_parse_ok, groundedness, reasoning_quality, overall, rationale, judge_raw FROM j",
        "category_extract": f"WITH {C} SELECT id, nullif(regexp_extract({QUESTION}, {lit(tx.CATEGORY_PATTERN)}, 1), '') AS category FROM c",
        "content_words": f"WITH {C} SELECT id, coalesce(len(w), 0) AS n_words, coalesce(array_to_string(list_sort(w), ' '), '') AS words FROM (SELECT id, {content('clause_text')} AS w FROM c)",
        "quoted_spans": f"WITH {R}, q AS (SELECT response_id, regexp_extract_all(raw_response, {lit(tx.QUOTE_PATTERN)}, 1) AS l FROM r) "
        "SELECT response_id, CAST(i - 1 AS INTEGER) AS at, l[i] AS span FROM (SELECT response_id, l, unnest(range(1, len(l) + 1)) AS i FROM q)",
        "score_length": f"WITH {R}, n AS (SELECT response_id, len(regexp_extract_all(raw_response, '[a-zA-Z]+')) AS n FROM r WHERE raw_response IS NOT NULL) "
        "SELECT response_id, round(CASE WHEN n < 40 THEN n / 40.0::DOUBLE WHEN n > 400 THEN 400.0::DOUBLE / n ELSE 1.0 END, 10) AS length_ok FROM n",
        "row_seed": f"WITH {C} SELECT id, {seed('id')} AS seed FROM c",
        "company_key": f"WITH {C} SELECT DISTINCT contract, {KEY} AS key FROM c",
        "substantive_filter": f"WITH {C} SELECT id FROM c WHERE {substantive('clause_text')}",
        "excluded_category_filter": f"WITH {C} SELECT id, category FROM c WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM categories WHERE administrative)",
        "source_to_clauses": f"WITH {C}, n AS (SELECT id, contract, nullif(regexp_extract({QUESTION}, {lit(tx.CATEGORY_PATTERN)}, 1), '') AS category, {strip('clause_text')} AS clause_text FROM c) "
        f"SELECT * FROM n WHERE category IS NOT NULL AND NOT list_contains({items(tx.EXCLUDED_CATEGORIES)}, category) AND {substantive('clause_text')}",
        "known_bad_antijoin": f"WITH {C}, {REVIEWS} SELECT id FROM c WHERE id NOT IN (SELECT id FROM w WHERE verdict = 'bad') AND {substantive('clause_text')}",
        "clean_report": f"WITH {C}, {REVIEWS}, b AS (SELECT c.id IN (SELECT id FROM w WHERE verdict = 'bad') AS bad, NOT ({substantive('clause_text')}) AS frag FROM c) "
        "SELECT count(*) AS start, count(*) FILTER (bad) AS removed_known_bad, count(*) FILTER (NOT bad AND frag) AS removed_fragments, "
        "count(*) FILTER (NOT bad AND NOT frag) AS final FROM b",
        "prompt_template": f"WITH {C} SELECT id, {template(tx.PROMPT, _FIELDS)} AS prompt, {template(tx.TEACHER_PROMPT, _FIELDS)} AS teacher_prompt FROM c",
        "judge_prompt": f"WITH {ANSWERED} SELECT response_id, {template(tx.JUDGE_PROMPT, _FIELDS | {'response': 'raw_response'})} AS judge_prompt FROM a",
        "duplicate_clause_audit": f"WITH {C} SELECT clause_text, count(*) AS n_rows, count(DISTINCT contract) AS n_contracts, count(DISTINCT category) AS n_categories "
        "FROM c WHERE clause_text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "corpus_profile": f"WITH {C}, n AS (SELECT *, coalesce(len(regexp_extract_all(clause_text, '[a-zA-Z]+')), 0) AS n FROM c) "
        f"SELECT count(*) AS n_rows, count(DISTINCT contract) AS n_contracts, count(DISTINCT category) AS n_categories, "
        f"count(*) FILTER ({strip(chr(99) + 'oalesce(clause_text, ' + lit('') + ')')} = '') AS n_empty, round(avg(n), 10) AS mean_words, max(n) AS max_words, "
        "quantile_disc(n, 0.5) AS median_words, quantile_disc(n, 0.9) AS p90_words, quantile_disc(n, 0.99) AS p99_words FROM n",
        "rubric_scores": f"WITH {SCORED} SELECT response_id, " + ", ".join(f"round({c}, 10) AS {c}" for c in (*rubric.COMPONENTS, "aggregate")) + " FROM sc",
        "score_groundedness": f"WITH {SCORED} SELECT response_id, round(groundedness, 10) AS groundedness FROM sc WHERE structure_ok = 1",
        "score_no_contradiction": f"WITH {SCORED} SELECT response_id, no_contradiction FROM sc WHERE structure_ok = 1",
        "rubric_summary": f"WITH {SCORED} {summary('sc')}",
        "rubric_by_run": f"WITH {SCORED} {summary('sc', 'run_id')}",
        "rubric_by_corruption": f"WITH {PAIRS}, {C}, dd AS (SELECT d.*, c.clause_text FROM d JOIN (SELECT DISTINCT response_id, id AS request FROM r) r2 ON d.id = r2.response_id "
        f"JOIN c ON r2.request = c.id), {scored('sc', 'dd', 'rejected', 'corruption_type')} "
        "SELECT corruption_type, count(*) AS n, round(avg(aggregate), 10) AS aggregate FROM sc GROUP BY 1",
        "dpo_pairs": f"WITH {_DPO} SELECT * FROM dp",
        "dpo_training_rows": f"WITH {_DPO} SELECT prompt, chosen, rejected FROM dp",
        "corruption_distribution": f"WITH {PAIRS} SELECT corruption_type, count(*) AS n FROM d GROUP BY 1",
        "sft_pairs": f"WITH {C}, {R}, {parsed('p', 'r', 'raw_response')} SELECT {template(tx.PROMPT, {'category': 'c.category', 'clause_text': 'c.clause_text'})} AS prompt, {formatted()} AS completion FROM p JOIN c ON p.id = c.id",
        "shared_clause_pairs": f"WITH {SHARED.replace(C, SPELLINGS)} SELECT * FROM e",
        "duplicate_documents": f"WITH RECURSIVE {COMPONENTS.replace(C, SPELLINGS).replace('SELECT a, b FROM e UNION SELECT b, a FROM e', 'SELECT a, b FROM e WHERE shared >= 3 UNION SELECT b, a FROM e WHERE shared >= 3')} SELECT * FROM g",
        "contract_split": f"WITH RECURSIVE {SPLIT} SELECT DISTINCT contract, split FROM s",
        "split_counts": f"WITH RECURSIVE {SPLIT} SELECT split, count(*) AS n_rows, count(DISTINCT contract) AS n_groups FROM s GROUP BY 1",
        "split_leakage": f"WITH {C} SELECT contract, count(*) AS n_rows, count(DISTINCT split) AS n_splits, count(DISTINCT split) > 1 AS leaks FROM c GROUP BY 1",
        "split_agreement": f"WITH RECURSIVE {SPLIT}, {PAIRS}, x AS (SELECT t.id, c.split FROM t JOIN r ON t.id = r.response_id JOIN c ON r.id = c.id WHERE t.target IS NOT NULL), "
        "y AS (SELECT d.id, s.split FROM d JOIN r ON d.id = r.response_id JOIN s ON r.id = s.id) "
        "SELECT x.split AS split_a, y.split AS split_b, count(*) AS n FROM x FULL JOIN y ON x.id = y.id GROUP BY 1, 2",
        "first_rows": f"WITH {C} SELECT id, split FROM c ORDER BY id LIMIT 100",
        "smoke_subset": f"WITH {C}, u AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY {order(42, 'id')}, id) AS k FROM c) "
        "SELECT id, split FROM u WHERE (split = 'train' AND k <= 60) OR (split = 'valid' AND k <= 20)",
        "category_cap": f"WITH {C} SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {order(42, 'id')}, id) AS k FROM c WHERE category IS NOT NULL) WHERE k <= 20",
        "id_sample": f"WITH {C} SELECT DISTINCT id FROM c ORDER BY {order(42, 'id')}, id LIMIT 150".replace("SELECT DISTINCT id FROM c", "SELECT id FROM (SELECT DISTINCT id FROM c)"),
        "review_sample": f"WITH {_SAMPLE_BASE} SELECT * FROM rs",
        "review_sheet": f"WITH {_SHEET} SELECT zs.id, sample_reason, {text_of('pa.category', 'pa.contract', 'pa.clause_text')}, {formatted(('pa.s1', 'pa.s2', 'pa.s3', 'pa.s4'))} AS target, "
        "CAST(ag AS VARCHAR) AS rubric_aggregate, CAST(so AS VARCHAR) AS rubric_structure_ok, CAST(gr AS VARCHAR) AS rubric_groundedness, CAST(lo AS VARCHAR) AS rubric_length_ok, "
        "CAST(nc AS VARCHAR) AS rubric_no_contradiction, '' AS reviewer_verdict, '' AS reviewer_notes FROM zs JOIN pa ON zs.id = pa.response_id",
        "judge_validation_join": f"WITH {JOINED} SELECT run_id, id, judge_overall, round(rubric_aggregate, 10) AS rubric_aggregate, disagreement FROM v",
        "judge_validation_sample": f"WITH {_VALIDATION} SELECT run_id, id, sample_reason, judge_overall, disagreement FROM vs",
        "judge_review_sheet": f"WITH {_VALIDATION} SELECT vs.run_id, vs.id, sample_reason, {text_of('a.category', 'a.clause_text', 'a.raw_response')}, "
        "CAST(round_even(rubric_aggregate, 3) AS VARCHAR) AS rubric_aggregate, "
        f"{text_of('judge_groundedness', 'judge_reasoning_quality', 'judge_overall', 'judge_rationale', 'disagreement')}, '' AS human_verdict, '' AS human_notes "
        "FROM vs JOIN a ON vs.run_id = a.run_id AND vs.id = a.id",
        "sample_reasons": f"WITH {_VALIDATION} SELECT sample_reason, count(*) AS n FROM vs GROUP BY 1",
        "judge_summary": f"WITH {R}, {JUDGED} SELECT run_id, count(*) AS n, "
        + ", ".join(f"round(avg({c}), 10) AS {c}" for c in ("groundedness", "reasoning_quality", "overall"))
        + ", round(avg(CASE WHEN judge_parse_ok THEN 1 ELSE 0 END), 10) AS parse_ok_rate FROM j GROUP BY 1",
        "validation_findings": f"WITH {_VALIDATION}, vv AS (SELECT run_id, sample_reason, judge_overall, "
        f"(['both_right', 'both_wrong', 'judge_wrong', 'judge_right'])[{seed('run_id || ' + lit('|') + ' || id')} % 4 + 1] AS h FROM vs) "
        "SELECT run_id, sample_reason, judge_overall, count(*) AS n, count(*) FILTER (h = 'both_right') AS n_both_right, count(*) FILTER (h = 'both_wrong') AS n_both_wrong, "
        "count(*) FILTER (h = 'judge_wrong') AS n_judge_wrong, count(*) FILTER (h = 'judge_right') AS n_judge_right, count(*) FILTER (h IN ('both_right', 'judge_right')) AS n_upheld, "
        "round(avg(CASE WHEN h IN ('both_right', 'judge_right') THEN 1 ELSE 0 END), 10) AS upheld_share FROM vv GROUP BY CUBE (run_id, sample_reason, judge_overall)",
        "resume_pending": f"WITH {C}, {R} SELECT DISTINCT id FROM c WHERE id NOT IN (SELECT id FROM r)",
        "id_list_semijoin": f"WITH {C}, {R}, i AS (SELECT id FROM (SELECT DISTINCT id FROM c) ORDER BY {order(42, 'id')}, id LIMIT 150) SELECT response_id, id FROM r WHERE id IN (SELECT id FROM i)",
        "model_run_stub": f"WITH {_STUB} SELECT id, CASE WHEN n % 3 <> 0 THEN {echoed('n', NL2)} END AS target, n % 3 <> 0 AS parse_ok, retried FROM n2",
        "model_run_report": f"WITH {_STUB} SELECT count(*) AS n, count(*) FILTER (n % 3 = 0) AS n_parse_failures, count(*) FILTER (retried AND n % 3 <> 0) AS n_recovered FROM n2",
        "judge_run": f"WITH {ANSWERED}, i AS (SELECT id FROM (SELECT DISTINCT id FROM c) ORDER BY {order(42, 'id')}, id LIMIT 150), "
        f"n AS (SELECT response_id, length({template(tx.JUDGE_PROMPT, _JUDGED_FIELDS)}) AS n FROM a WHERE id IN (SELECT id FROM i)), "
        "k AS (SELECT *, n % 7 <> 0 AS ok, CAST(n % 5 + 1 AS INTEGER) AS k FROM n) SELECT response_id, ok AS judge_parse_ok, CASE WHEN ok THEN k END AS groundedness, "
        "CASE WHEN ok THEN k END AS reasoning_quality, CASE WHEN ok THEN k END AS overall, CASE WHEN ok THEN n || ' characters' END AS rationale, "
        "CASE WHEN NOT ok THEN 'no scores' END AS judge_raw FROM k",
        "generation_run": f"WITH {C}, n AS (SELECT id, length({template(tx.PROMPT, _FIELDS)}) AS n FROM c) SELECT id, CASE WHEN n % 3 <> 0 THEN {echoed('n')} ELSE 'no sections' END AS raw_response FROM n",
        "analyze_batch": f"WITH {C}, b AS (SELECT *, CASE WHEN coalesce(clause_text, '') = '' THEN 'empty' WHEN NOT ({substantive('clause_text')}) THEN 'not substantive' END AS reason FROM c), "
        f"n AS (SELECT id, reason, CASE WHEN reason IS NULL THEN length({template(tx.PROMPT, _FIELDS)}) END AS n FROM b), k AS (SELECT *, coalesce(n % 3 <> 0, false) AS ok FROM n) "
        "SELECT id, reason, CASE WHEN ok THEN CAST(n AS VARCHAR) END AS issue, CASE WHEN ok THEN 'r' END AS rule, CASE WHEN ok THEN 'a' END AS application, CASE WHEN ok THEN 'c' END AS conclusion, "
        f"ok AS parse_ok, CASE WHEN ok THEN {echoed('n')} WHEN n IS NOT NULL THEN 'no sections' END AS raw_response, 'stand-in' AS model_id, 'none' AS adapter_name FROM k",
        "analyze_not_ready": f"WITH {C} SELECT 'model not loaded' AS reason, false AS parse_ok, count(*) AS n FROM c",
        "dry_run_gate": f"WITH {R}, b AS (SELECT run_id, NOT coalesce(starts_with({strip('raw_response')}, 'Issue:'), false) AS bad FROM r) "
        "SELECT run_id, count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) = 0 AS passes FROM b GROUP BY 1",
        "length_budget": f"WITH {ANSWERED}, {parsed('pa', 'a', 'raw_response')}, n AS (SELECT c.split, len(regexp_extract_all({template(tx.PROMPT, {'category': 'pa.category', 'clause_text': 'pa.clause_text'})}, {lit(clean.PIECE)})) "
        f"+ len(regexp_extract_all({formatted(('pa.s1', 'pa.s2', 'pa.s3', 'pa.s4'))}, {lit(clean.PIECE)})) AS n FROM pa JOIN c ON pa.id = c.id) "
        "SELECT split, count(*) AS n, max(n) AS max_size, quantile_disc(n, 0.99) AS p99_size, count(*) FILTER (n > 1024) AS n_over FROM n GROUP BY 1",
        "training_steps": f"WITH {C} SELECT count(*) AS n, 16 AS effective_batch, CAST(ceil(count(*) / 16) * 3 AS BIGINT) AS steps FROM c WHERE split = 'train'",
        "jsonl_roundtrip": f"WITH {C} SELECT * FROM c",
        "csv_roundtrip": f"WITH {C} SELECT id, clause_text FROM c WHERE clause_text IS NOT NULL",
        "splits_roundtrip": f"WITH {C} SELECT id, split FROM c WHERE split IS NOT NULL",
        "partitioned_roundtrip": f"WITH {C} SELECT id, split FROM c",
        "ids_roundtrip": f"WITH {C} SELECT id FROM (SELECT DISTINCT id FROM c) ORDER BY {order(42, 'id')}, id LIMIT 150",
        "last_by_key": "SELECT DISTINCT id, split, source FROM analyze_requests",
    }
    rubric_run, judge_run = summary("sc", "run_id"), out["judge_summary"].rsplit("SELECT run_id", 1)[1]
    rub = ", ".join(f"x.{c} AS rubric_{c}" for c in ("n", *rubric.COMPONENTS, "aggregate", "parse_ok_rate"))
    jud = ", ".join(f"y.{c} AS judge_{c}" for c in ("n", "groundedness", "reasoning_quality", "overall", "parse_ok_rate"))
    out["consolidated_summary"] = f"WITH {SCORED}, {JUDGED}, x AS ({rubric_run}), y AS (SELECT run_id{judge_run}) SELECT x.run_id, {rub}, {jud} FROM x JOIN y ON x.run_id = y.run_id"
    out["summary_append"] = out["judge_summary"]
    names = {"corrupt_drop_section": "drop_section", "corrupt_reorder": "reorder_sections", "corrupt_wrong_citation": "wrong_citation",
             "corrupt_unsupported_claim": "unsupported_claim", "corrupt_contradict": "contradict_conclusion", "corrupt_truncate": "truncate"}
    return out | {name: corrupted(kind) for name, kind in names.items()}
