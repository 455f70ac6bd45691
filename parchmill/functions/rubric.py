"""The deterministic rubric: structure, groundedness, length and consistency of a sectioned analysis."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions import text as tx

# Phrases and limits that define the scores.
AUTHORITY_FLAGS = (
    "court of chancery", "uniform commercial code", "federal preemption", "held that", "ruling", "case precedent",
    "legal precedent", "binding precedent", "sets a precedent", "sets precedent", "as a precedent", "case law",
    "prior litigation", "consistently upheld", "void as against public policy",
)
REVERSAL_CUES = (
    "contrary to the", "notwithstanding the application", "notwithstanding the analysis", "despite the foregoing",
    "despite the application", "opposite right", "opposite conclusion", "should be disregarded",
)
HEDGES = (
    "may ", "may render", "might ", "could ", "potentially", "to ensure", "in order to", "need to", "needs to",
    "would need", "unless", "if the", "if it", "should be", "clarif",
)
UNCERTAIN = (
    "unclear if", "unclear whether", "not clear whether", "not clear if", "uncertain whether", "ambiguous whether",
    "it is unclear",
)
CONTRASTS = (" but ", ", but", " however", "; however", ", yet ")
OPPOSITES = (
    ("enforceable", "unenforceable"), ("enforceable", "not enforceable"), ("valid", "invalid"), ("permitted", "prohibited"),
    ("permitted", "not permitted"), ("obligated", "not obligated"), ("liable", "not liable"), ("required", "not required"),
    ("ambiguous", "unambiguous"),
)
MIN_WORDS, MAX_WORDS, OVERLAP_SHARE = 40, 400, 0.3
# End of fixed values.

COMPONENTS = ("structure_ok", "groundedness", "length_ok", "no_contradiction")


def any_of(phrases: tuple[str, ...]) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)


def length_score(text: Column, low: int = MIN_WORDS, high: int = MAX_WORDS) -> Column:
    """1 within the limits, else the ratio to the nearer limit."""
    n = tx.word_count(text)
    return F.when(n < low, n / F.lit(float(low))).when(n > high, F.lit(float(high)) / n).otherwise(1.0)


def groundedness(quotes: Column, words: Column, rule: Column, clause: Column) -> Column:
    """Share of quoted spans found in the clause, or word overlap where none is quoted; 0 if the rule cites authority."""
    plain = tx.normalized(clause)
    hits = F.size(F.filter(quotes, lambda q: F.contains(plain, tx.normalized(q))))
    overlap = F.size(F.array_intersect(words, tx.content_words(clause)))
    bar = F.greatest(F.bround(F.size(words) * F.lit(OVERLAP_SHARE), 0), F.lit(1.0))
    by_clause = (
        F.when(F.size(quotes) > 0, hits / F.size(quotes).cast("double"))
        .when(F.size(words) == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), overlap / bar))
    )
    return F.least(by_clause, F.when(F.lower(rule).rlike(any_of(AUTHORITY_FLAGS)), 0.0).otherwise(1.0))


def flat_assertions(text: Column) -> Column:
    """The sentences without a hedge, in lower case, kept apart by a mark that no term spans."""
    return F.array_join(F.filter(tx.sentences(F.lower(text)), lambda s: ~s.rlike(any_of(HEDGES))), "\n|\n")


def no_contradiction(said: Column, drawn: Column, conclusion: Column) -> Column:
    """0 if the conclusion reverses or undermines itself, or asserts the opposite of what the application asserts.

    ``said`` and ``drawn`` are what the application and the conclusion assert.
    """
    low = F.lower(conclusion)
    has = {t: (said.rlike(rf"\b{t}\b"), drawn.rlike(rf"\b{t}\b")) for p in OPPOSITES for t in p}
    clash = F.lit(False)
    for pos, neg in OPPOSITES:
        (ap, cp), (an, cn) = has[pos], has[neg]
        clash = clash | (ap & ~an & cn & ~cp) | (an & ~ap & cp & ~cn)
    undermined = F.exists(tx.sentences(low), lambda s: s.rlike(any_of(UNCERTAIN)) & s.rlike(any_of(CONTRASTS)))
    return F.when(low.rlike(any_of(REVERSAL_CUES)), 0.0).when(undermined, 0.0).when(clash, 0.0).otherwise(1.0)


def with_rubric(df: DataFrame, response: str = "raw_response", clause: str = "clause_text") -> DataFrame:
    """Add the four components and their mean ``aggregate``.

    All are 0 where the response has not all four sections. A null clause counts as empty, a null response as unparsed.
    Columns of these names are replaced; other columns, and repeated rows, pass through. No shuffle.
    """
    parsed = tx.with_sections(df, response)
    s, ok = F.col("__s"), F.col("__s").isNotNull()
    clause_text = F.coalesce(F.col(clause), F.lit(""))
    # what several terms ask for becomes a column, so that it is worked out once a row
    parsed = parsed.withColumns(
        {
            "__said": F.when(ok, flat_assertions(s["Application"])),
            "__drawn": F.when(ok, flat_assertions(s["Conclusion"])),
            "__quotes": F.when(ok, tx.quoted_spans(s["Application"])),
            "__used": F.when(ok, tx.content_words(s["Application"])),
        }
    )
    scored = parsed.withColumns(
        {
            "structure_ok": F.when(ok, 1.0).otherwise(0.0),
            "groundedness": F.when(ok, groundedness(F.col("__quotes"), F.col("__used"), s["Rule"], clause_text)).otherwise(0.0),
            "length_ok": F.when(ok, length_score(F.col(response))).otherwise(0.0),
            "no_contradiction": F.when(ok, no_contradiction(F.col("__said"), F.col("__drawn"), s["Conclusion"])).otherwise(0.0),
        }
    )
    a, b, c, d = (F.col(x) for x in COMPONENTS)
    return scored.drop("__s", "__said", "__drawn", "__quotes", "__used").withColumn("aggregate", (a + b + c + d) / 4)


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Row count, means of the components and the aggregate, and the rate of parsed responses; null means of no rows."""
    means = [F.round(F.avg(c), 10).alias(c) for c in (*COMPONENTS, "aggregate")]
    rate = F.round(F.avg((F.col("structure_ok") == 1.0).cast("int")), 10).alias("parse_ok_rate")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means, rate)
