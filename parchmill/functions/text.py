"""Column builders for text: whitespace, words, quotes, sectioned analyses, judge replies, prompts.

All are built-in expressions, so they stay inside generated JVM code. A null text gives null, or an empty array where an
array is returned, unless stated otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, word list and limits that define the results.
SECTIONS = ("Issue", "Rule", "Application", "Conclusion")
STOPWORDS = (
    "this", "that", "these", "those", "with", "from", "have", "shall", "will", "would", "could", "should", "which",
    "their", "there", "under", "into", "such", "than", "then", "also", "been", "being", "were", "each", "other", "some",
    "more", "most", "only", "both", "same", "very", "does", "upon", "when", "where", "what", "while", "must", "party",
    "parties", "clause", "provision", "agreement", "contract",
)
EXCLUDED_CATEGORIES = ("Parties", "Document Name", "Agreement Date", "Effective Date", "Expiration Date")
CATEGORY_PATTERN = 'related to "([^"]+)"'
QUOTE_PATTERN = '"([^"]{4,})"'
MIN_CLAUSE_WORDS = 8

#: White space in the Unicode sense, spelled out because the engines' own classes differ.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGES = f"^{SPACE}+|{SPACE}+$"
IRAC_PATTERN = "(?s)" + "".join(f"{s}:{SPACE}*(.*?){SPACE}*" for s in SECTIONS) + "$"
JUDGE_PATTERN = (
    rf"(?s)GROUNDEDNESS:{SPACE}*([1-5]){SPACE}*REASONING_QUALITY:{SPACE}*([1-5]){SPACE}*"
    rf"OVERALL:{SPACE}*([1-5]){SPACE}*RATIONALE:{SPACE}*(.+)"
)

PROMPT = (
    "You are a legal analyst reviewing a contract clause.\n\nClause category: {category}\nClause text: {clause_text}\n\n"
    "Analyze this clause using IRAC format. Respond with exactly four sections, each starting on its own line with the "
    "section name followed by a colon, in this order: Issue, Rule, Application, Conclusion. Do not include any text before "
    "Issue: or after the Conclusion section.\n\n"
)
TEACHER_PROMPT = PROMPT + (
    "\n\nAdditional instructions for this analysis:\n- Base the Rule section on general, well-established contract law "
    "principles relevant to this clause category — do not invent case citations.\n- The Application section must refer only "
    "to language actually present in the clause text above. Do not assume facts not stated in the clause.\n- Do not introduce "
    "any condition, requirement, or mechanism (such as a consent requirement) that is not stated in the clause text above.\n"
    "- Keep each section to 2-4 sentences.\n- The Conclusion must follow logically from the Application — do not contradict it."
)
RETRY_SUFFIX = (
    "\n\nYour previous response did not follow the required format. Respond with ONLY the four labeled sections, nothing else."
)
JUDGE_PROMPT = (
    "You are an expert legal analyst evaluating an AI-generated IRAC analysis of a contract clause.\n\n"
    "Clause category: {category}\nClause text: {clause_text}\n\nAI-generated analysis:\n{response}\n\n"
    "Score this analysis on three dimensions, each from 1 (poor) to 5 (excellent):\n\n"
    "1. GROUNDEDNESS: Does the analysis stay strictly faithful to the clause text? A high score means every claim in the "
    "Application section is directly supported by the clause; no invented facts, conditions, or requirements not actually "
    "present in the clause text. A low score means the analysis asserts things (e.g. \"requires X's consent\", \"applies only "
    'if Y") that are not actually stated in the clause.\n\n'
    "2. REASONING_QUALITY: Is the legal reasoning (Rule -> Application -> Conclusion) coherent, well-structured, and legally "
    "sound? A high score means the Rule states a real, relevant legal principle, the Application correctly applies it to the "
    "clause, and the Conclusion follows logically. A low score means the reasoning is generic, contradictory, or doesn't "
    "actually connect to the clause.\n\n"
    "3. OVERALL: Your holistic judgment of how useful and correct this analysis would be to a lawyer reviewing this clause.\n\n"
    "Respond with EXACTLY this format, nothing else:\nGROUNDEDNESS: <1-5>\nREASONING_QUALITY: <1-5>\nOVERALL: <1-5>\n"
    "RATIONALE: <one or two sentences explaining your scores, especially if any score is below 4>"
)
# End of fixed values.


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normalized(text: Column) -> Column:
    """Stripped, lower case, each run of white space one blank."""
    return F.regexp_replace(F.lower(strip(text)), f"{SPACE}+", " ")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of four letters or more that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(found(F.lower(text), "[a-zA-Z]{4,}"), stop)


def quoted_spans(text: Column) -> Column:
    return found(text, QUOTE_PATTERN, 1)


def word_count(text: Column) -> Column:
    return F.size(found(text, "[a-zA-Z]+")).cast("bigint")


def is_substantive(text: Column, min_words: int = MIN_CLAUSE_WORDS) -> Column:
    """At least ``min_words`` runs of two letters or more; false for null."""
    return F.size(found(text, "[a-zA-Z]{2,}")) >= min_words


def category_of(question: Column) -> Column:
    c = F.regexp_extract(question, CATEGORY_PATTERN, 1)
    return F.when(c != "", c)


def sentences(text: Column) -> Column:
    return F.split(text, f"(?<=[.!?]){SPACE}+")


def parse_irac(text: Column) -> Column:
    """Struct of the four section bodies; null unless all stand in order and none is empty.

    The bodies are those of :data:`IRAC_PATTERN`, whose groups are as short as can be: each begins behind the first
    place of its label after the label before, and ends at the next label. Looking for the labels one after another
    takes time in proportion to the text, where the pattern would try every way to place repeated labels.
    """
    rest, bodies = text, []
    for s in SECTIONS:
        parts = F.split(rest, f"{s}:", 2)
        bodies.append(strip(F.get(parts, F.lit(0))))
        rest = F.get(parts, F.lit(1))  # null where the label is missing, and so is all that follows
    bodies = [*bodies[1:], strip(rest)]
    full = reduce(lambda x, y: x & y, [F.coalesce(b != "", F.lit(False)) for b in bodies])
    return F.when(full, F.struct(*[b.alias(s) for b, s in zip(bodies, SECTIONS)]))


def with_sections(df: DataFrame, text: str, out: str = "__s") -> DataFrame:
    """Add the struct of :func:`parse_irac`, worked out once a row.

    It is made to look as if it differed from row to row: else a filter on anything that is derived from it would be
    pushed below it and repeat the pattern wherever a section is named.
    """
    return df.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, parse_irac(F.col(text))))


def format_sections(sections: Column, order: tuple[str, ...] = SECTIONS) -> Column:
    """``Name: body`` by name, a blank line between; empty and missing sections are left out."""
    lines = [F.when(sections[s] != "", F.concat(F.lit(f"{s}: "), sections[s])) for s in order]
    return F.when(sections.isNotNull(), F.concat_ws("\n\n", *lines))


def parse_judge(raw: Column) -> Column:
    """Struct of three scores and the rationale; null where the reply does not hold them as asked."""
    clean = strip(raw)
    g = [F.regexp_extract(clean, JUDGE_PATTERN, i) for i in range(1, 5)]
    scores = [x.try_cast("int") for x in g[:3]]
    names = ("groundedness", "reasoning_quality", "overall")
    return F.when(g[0] != "", F.struct(*[s.alias(n) for s, n in zip(scores, names)], strip(g[3]).alias("rationale")))


def filled(template: str, **columns: Column) -> Column:
    """The template with each ``{name}`` replaced by the column; a null column counts as empty."""
    parts = [
        F.coalesce(columns[p[1:-1]].cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in columns else F.lit(p)
        for p in re.split(r"(\{\w+\})", template)
        if p
    ]
    return F.concat(*parts)


def company_key(title: Column) -> Column:
    """Upper-case letters and digits of the title's leading run of letters, commas, periods and blanks, else of it all."""
    head = F.regexp_extract(title, rf"^[A-Za-z][A-Za-z,.{SPACE[1:]}*", 0)
    return F.regexp_replace(F.upper(F.when(head != "", head).otherwise(title)), "[^A-Z0-9]", "")


def row_seed(key: Column) -> Column:
    """A stable number below 2^32 from the key's digest."""
    return F.conv(F.right(F.sha2(key.cast("string"), 256), F.lit(8)), 16, 10).cast("bigint")


def hash_order(seed: int, key: Column) -> Column:
    """A pseudo-random order, the same on every engine: the digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
