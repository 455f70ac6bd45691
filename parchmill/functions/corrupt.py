"""Six corruptions that turn a sound analysis into the rejected half of a preference pair.

Two paths, never mixed in one query. The hash path is plain expressions over a seed column, the same on every engine.
The exact path draws from a seeded Mersenne Twister per row and so must run in Python.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions import text as tx

# Types in order of choice, and inserted sentences.
TYPES = ("drop_section", "reorder_sections", "wrong_citation", "unsupported_claim", "contradict_conclusion", "truncate")
FAKE_QUOTES = (
    "either party may terminate immediately without notice upon a change of control",
    "all disputes shall be resolved exclusively by binding arbitration in Delaware",
    "the indemnification obligations survive termination for a period of ten years",
    "liability under this section is uncapped for any breach of confidentiality",
    "this provision automatically terminates upon the filing of bankruptcy by either party",
)
CLAIMS = (
    " This reading is further supported by the Delaware Court of Chancery's holding in a closely analogous dispute.",
    " Under the Uniform Commercial Code, this provision would also govern any related equipment transactions between the parties.",
    " Courts in this jurisdiction have consistently upheld the stricter of the two available readings in comparable cases.",
    " Federal preemption doctrine would override any conflicting state-law interpretation of this language.",
    " This type of provision has previously been held void as against public policy in similar commercial contexts.",
)
CONCLUSIONS = (
    "Therefore, contrary to the analysis above, this clause imposes no enforceable obligation on either party and may be disregarded.",
    "Accordingly, despite the foregoing, the clause should be read as granting the opposite right from the one just described.",
    "In conclusion, the clause is unenforceable as drafted, notwithstanding the application above showing it meets the applicable standard.",
)
CITED = '. The clause further states that "'
CUT_FROM, CUT_TO = 0.5, 0.85
# End of fixed values.

ORDERS = [o for o in itertools.permutations(tx.SECTIONS) if o != tx.SECTIONS]


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (at % len(values) + 1).cast("int"))


def _with(s: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(n, s[n]).alias(n) for n in tx.SECTIONS])


def _bare_end(c: Column) -> Column:
    return F.regexp_replace(c, r"[. ]+$", "")


def drop_section(s: Column, h: Column) -> Column:
    rest = [tuple(n for n in tx.SECTIONS if n != gone) for gone in tx.SECTIONS]
    return _pick([tx.format_sections(s, r) for r in rest], h)


def reorder_sections(s: Column, h: Column) -> Column:
    lines = F.map_from_arrays(
        F.array(*[F.lit(n) for n in tx.SECTIONS]), F.array(*[F.concat(F.lit(f"{n}: "), s[n]) for n in tx.SECTIONS])
    )
    order = _pick([F.array(*[F.lit(n) for n in o]) for o in ORDERS], h)
    return F.array_join(F.transform(order, lambda n: lines[n]), "\n\n")


def wrong_citation(s: Column, h: Column) -> Column:
    body = F.concat(_bare_end(s["Application"]), F.lit(CITED), _pick(FAKE_QUOTES, h), F.lit('."'))
    return tx.format_sections(_with(s, Application=body))


def unsupported_claim(s: Column, h: Column) -> Column:
    return tx.format_sections(_with(s, Rule=F.concat(_bare_end(s["Rule"]), F.lit("."), _pick(CLAIMS, h))))


def contradict_conclusion(s: Column, h: Column) -> Column:
    return tx.format_sections(_with(s, Conclusion=_pick(CONCLUSIONS, h)))


def truncate(s: Column, h: Column) -> Column:
    full = tx.format_sections(s)
    low = F.floor(F.length(full) * F.lit(CUT_FROM)).cast("bigint")
    high = F.floor(F.length(full) * F.lit(CUT_TO)).cast("bigint")
    cut = low + h % (high - low + 1)
    return F.regexp_replace(F.substring(full, F.lit(1), cut.cast("int")), f"{tx.SPACE}+$", "")


#: A registry: further corruptions are added by name.
CORRUPTIONS = {
    "drop_section": drop_section,
    "reorder_sections": reorder_sections,
    "wrong_citation": wrong_citation,
    "unsupported_claim": unsupported_claim,
    "contradict_conclusion": contradict_conclusion,
    "truncate": truncate,
}


def corrupted(df: DataFrame, kind: str, text: str = "target", key: str = "id", out: str = "rejected") -> DataFrame:
    """Add the text corrupted in one way; null where it has not all four sections."""
    step = tx.with_sections(df, text).withColumn("__h", F.floor(tx.row_seed(F.col(key)) / 6).cast("bigint"))
    return step.withColumn(out, F.when(F.col("__s").isNotNull(), CORRUPTIONS[kind](F.col("__s"), F.col("__h")))).drop("__s", "__h")


def preference_pairs(df: DataFrame, text: str = "target", key: str = "id") -> DataFrame:
    """One pair a row by the hash path: chosen, rejected and corruption_type. Rows that do not parse are left out."""
    step = (
        tx.with_sections(df, text)
        .where(F.col("__s").isNotNull())
        .withColumn("__seed", tx.row_seed(F.col(key)))
        .withColumn("__h", F.floor(F.col("__seed") / 6).cast("bigint"))
        .withColumn("corruption_type", _pick(TYPES, F.col("__seed")))
    )
    rejected = F.lit(None).cast("string")
    for kind in reversed(TYPES):
        rejected = F.when(F.col("corruption_type") == kind, CORRUPTIONS[kind](F.col("__s"), F.col("__h"))).otherwise(rejected)
    return step.withColumn("chosen", F.col(text)).withColumn("rejected", rejected).drop("__s", "__seed", "__h")


def training_rows(pairs: DataFrame) -> DataFrame:
    """What preference training reads of the pairs: exactly prompt, chosen and rejected."""
    return pairs.select("prompt", "chosen", "rejected")


def exact_pair(sections: dict[str, str], seed: int) -> tuple[str, str]:
    """(rejected, type) as a Mersenne Twister seeded with ``seed`` decides: first the type, then the detail."""
    rng = random.Random(seed)
    body = dict(sections)
    order = list(tx.SECTIONS)
    kind = rng.choice(list(TYPES))
    if kind == "drop_section":
        order.remove(rng.choice(order))
    elif kind == "reorder_sections":
        while tuple(order) == tx.SECTIONS:
            rng.shuffle(order)
    elif kind == "wrong_citation":
        body["Application"] = body["Application"].rstrip(". ") + CITED + rng.choice(FAKE_QUOTES) + '."'
    elif kind == "unsupported_claim":
        body["Rule"] = body["Rule"].rstrip(". ") + "." + rng.choice(CLAIMS)
    elif kind == "contradict_conclusion":
        body["Conclusion"] = rng.choice(CONCLUSIONS)
    full = "\n\n".join(f"{n}: {body[n]}" for n in order if body[n])
    if kind == "truncate":
        full = full[: rng.randint(int(len(full) * CUT_FROM), int(len(full) * CUT_TO))].rstrip()
    return full, kind


def preference_pairs_exact(df: DataFrame, text: str = "target", key: str = "id") -> DataFrame:
    """As :func:`preference_pairs`, by the seeded generator; an Arrow-batched function, since no expression can draw it."""

    @F.pandas_udf("rejected string, corruption_type string")
    def draw(sections: pd.DataFrame, seed: pd.Series) -> pd.DataFrame:
        rows = [exact_pair(s, int(k)) for s, k in zip(sections.to_dict("records"), seed)]
        return pd.DataFrame(rows, columns=["rejected", "corruption_type"])

    step = tx.with_sections(df, text).where(F.col("__s").isNotNull())
    drawn = step.withColumn("__d", draw(F.col("__s"), tx.row_seed(F.col(key)))).withColumn("chosen", F.col(text))
    return drawn.withColumns({"rejected": F.col("__d.rejected"), "corruption_type": F.col("__d.corruption_type")}).drop("__s", "__d")
