"""Problem 1: per-document text statistics, and fixed-threshold rules that name a reason for each failure.

Everything is a built-in expression over the whole text: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The commonest function words of the languages of the texts, by language.
COMMON = {
    "en": "the of and to in a an is for may shall not any all at as or by on be with within until no has will must that each "
    "are if than more which its from this neither nor once upon unless where even provided except such subject out set",
    "de": "der die das und den dem des ein eine einen einem einer ist mit von zu im in für auf nicht auch oder sowie ohne nach vor "
    "bis gegen unter am alle durch als bei aus über wird kann darf muss soll",
    "fr": "le la les des du de et un une au aux en par pour dans sur que qui ne pas est avec ou sans ainsi après avant sous selon "
    "contre plus tout tous chaque doit peut",
    "es": "el la los las de del y un una en con por para que no se es al o sin según antes tras bajo junto su cada todos debe puede",
}
#: Words that make a sentence: auxiliaries and the verbs of duty, permission and statement.
VERBS = {
    "en": "shall may must will can cannot is are was were be been has have had need agrees undertakes means remain remains does do "
    "did applies survives should would could",
    "de": "muss müssen soll sollen darf dürfen kann können wird werden ist sind war waren hat haben gilt gelten bedeutet verpflichtet",
    "fr": "doit doivent devra devront peut peuvent pourra est sont était ont avait s'engage s'engagent engage signifie reste",
    "es": "debe deben deberá deberán puede pueden podrá son era ha han hay compromete comprometen significa queda",
}
# End of fixed values.

#: Fixed thresholds. Shares are of words or characters.
SHORT_WORDS = 7  # up to here a text may be a phrase without a verb
MIN_VERB_SHARE = 0.012
MIN_COMMON_SHARE = 0.10
MIN_LETTER_SHARE = 0.55
MAX_SYMBOL_SHARE = 0.15
MAX_MEAN_WORD = 14.0
MIN_MEAN_WORD = 2.0
MAX_MEAN_TOKEN = 16.0
MAX_FOREIGN_SHARE = 0.04
MAX_MARKUP_SHARE = 0.02
MIN_ROW_SHARE = 0.6
MIN_ROWS = 3  # fewer lines are no table
MIN_ITEMS = 3

# Thresholds as published for web text with the Gopher models, and the terminal mark of the C4 corpus.
PUBLISHED_WORDS = (50, 100_000)
PUBLISHED_MEAN_WORD = (3, 10)
PUBLISHED_SYMBOLS = 0.1  # of # and ellipses to words
PUBLISHED_BULLETS = 0.9  # of lines that begin with a bullet
PUBLISHED_ELLIPSES = 0.3  # of lines that end with an ellipsis
PUBLISHED_ALPHABETIC = 0.8  # of words with a letter
PUBLISHED_STOP_WORDS = 2
# End of fixed values.

ROW_END = r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]"
#: A line of cells: bars, tabs, dot leaders, columns held apart by blanks, or delimiters without a blank after them.
CELLS = (
    r"\|.*\||\S\s*\t\s*\S|\.{4,}\s*\S|\S {2,}\S.* {2,}\S|\S {3,}\S|^[^;]*\S;\S[^;]*;\S|^[^;]{1,40};\S[^;]*$|"
    r"^(?:\"[^\"]*\"|[^,\"]*),(?:\"[^\"]*\"|[^,\" ][^,\"]*)(?:,(?:\"[^\"]*\"|[^,\" ][^,\"]*))*$"
)
LABEL = r"^\s*(?:[-*•▪◦‣·–—o»]|\(?(?:\d{1,3}|[ivxl]{1,6}|\p{L})[.)]|\d{1,3}\s+[-–])\s+"
MARKUP = r"</?[a-zA-Z][^<>]*>|&#?\w+;|\{[^{}]*[:;][^{}]*\}|\bfunction\s*\(|=\s*function"
#: What UTF-8 read as Latin-1 leaves behind, and the replacement mark.
MOJIBAKE = r"[ÃÂÐÑâ€œ][\x{80}-\x{BF}€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ¡-¿]|ï¿½|\x{FFFD}|Ã.|Å.?"


def _bag(by_language: dict[str, str]) -> list[str]:
    return sorted({w for words in by_language.values() for w in words.split()})


def _in(words: Column, bag: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*bag)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def foreign_marks(text: Column) -> Column:
    """How often :data:`MOJIBAKE` stands in a text; each of its forms begins beyond ASCII, which is asked first."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_count(text, F.lit(MOJIBAKE))).otherwise(0)


def markup_marks(text: Column) -> Column:
    """How often :data:`MARKUP` stands in a text; each of its forms has one of four things, which are asked for first."""
    some = text.contains("<") | text.contains("&") | text.contains("{") | text.contains("function")
    return F.when(some, F.regexp_count(text, F.lit(MARKUP))).otherwise(0)


def measured(df: DataFrame, text: str) -> DataFrame:
    """Add a column ``__s_…`` for each statistic."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumn("__t", F.regexp_replace(t, r"^\s+|\s+$", ""))
    t = F.col("__t")
    step = step.withColumns(
        {
            "__lines": F.filter(F.split(t, ROW_END), lambda x: F.trim(x) != ""),
            "__words": F.split(F.lower(t), r"[^\p{L}'’]+"),
            "__bare": F.regexp_replace(t, r"\s+", " "),
        }
    )
    lines, words = F.col("__lines"), F.col("__words")
    n_chars = F.length(t)
    bare = F.col("__bare")
    n_lines = F.size(lines)
    n_words = F.size(words) - F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) - F.when(words[F.size(words) - 1] == "", 1).otherwise(0)
    n_words = F.greatest(n_words, F.lit(0))
    n_tokens = F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.translate(bare, " ", "")) + 1)
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    blanks = n_chars - F.length(F.translate(bare, " ", ""))
    plain = F.length(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\s.,;:()'\"’“”„«»‘%/&§-]+", ""))
    body = F.when(F.get(lines, F.lit(0)).rlike(r":\s*$") & (n_lines > 1), F.slice(lines, F.lit(2), F.greatest(n_lines, F.lit(1)))).otherwise(lines)
    step = step.withColumn("__body", body)
    body = F.col("__body")
    n_body = F.size(body)
    columns = {
        "n_chars": n_chars.cast("bigint"),
        "n_words": n_words.cast("bigint"),
        "n_lines": n_lines.cast("bigint"),
        "mean_word_length": _ratio(letters.cast("double"), n_words.cast("double")),
        "letter_share": _ratio(letters.cast("double"), (n_chars - blanks).cast("double")),
        "symbol_share": _ratio((n_chars - plain).cast("double"), (n_chars - blanks).cast("double")),
        "line_end_share": _ratio(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;…][\"'’”»)\]]*\s*$"))).cast("double"), n_lines.cast("double")),
        "label_share": _ratio(F.size(F.filter(body, lambda x: x.rlike(LABEL))).cast("double"), n_body.cast("double")),
        "row_share": F.when(n_lines >= MIN_ROWS, F.size(F.filter(lines, lambda x: x.rlike(CELLS))) / n_lines.cast("double")).otherwise(0.0),
        "common_share": _ratio(_in(words, _bag(COMMON)).cast("double"), n_words.cast("double")),
        "verb_share": _ratio(_in(words, _bag(VERBS)).cast("double"), n_words.cast("double")),
        "foreign_share": _ratio(foreign_marks(t).cast("double"), n_chars.cast("double")),
        "markup_share": _ratio(markup_marks(t).cast("double"), (n_words + 1).cast("double")),
        "mean_token_length": _ratio((n_chars - blanks).cast("double"), n_tokens.cast("double")),
        "n_separators": F.regexp_count(t, F.lit(r"[,;]\s")).cast("bigint"),
        "n_body": n_body.cast("bigint"),
        "n_hex": F.regexp_count(t, F.lit(r"(?:^|\s)[0-9a-f]{2}(?=\s|$)")).cast("bigint"),
        "n_tokens": n_tokens.cast("bigint"),
        "n_signs": F.regexp_count(t, F.lit(r"#|…|\.{3}")).cast("bigint"),
        "ellipsis_share": _ratio(F.size(F.filter(lines, lambda x: x.rlike(r"(?:…|\.{3})\s*$"))).cast("double"), n_lines.cast("double")),
    }
    # columns of their own, not fields: else the optimizer would put each pattern wherever its figure is used
    step = step.withColumns({f"__s_{n}": c for n, c in columns.items()})
    return step.drop("__t", "__lines", "__words", "__bare", "__body")


def with_statistics(df: DataFrame, text: str = "clause_text") -> DataFrame:
    """Add one struct ``stats`` for each row; a null text counts as empty, and all shares of an empty text are 0."""
    return _gathered(measured(df, text))


def _gathered(step: DataFrame) -> DataFrame:
    names = [c for c in step.columns if c.startswith("__s_")]
    return step.withColumn("stats", F.struct(*[F.col(c).alias(c[4:]) for c in names])).drop(*names)


def reasons() -> Column:
    """The rules that a measured text fails, in order; an empty array for a text that fails none."""
    sentence = F.col("__s_verb_share") >= MIN_VERB_SHARE
    long = F.col("__s_n_words") > SHORT_WORDS
    rows = (F.col("__s_row_share") >= MIN_ROW_SHARE) & ~sentence
    items = (F.col("__s_n_body") >= MIN_ITEMS) | (F.col("__s_n_separators") >= MIN_ITEMS - 1)
    words_ok = (F.col("__s_letter_share") >= MIN_LETTER_SHARE) & (F.col("__s_mean_word_length") < MAX_MEAN_WORD) & (F.col("__s_mean_word_length") >= MIN_MEAN_WORD)
    checks = {
        "junk: markup": F.col("__s_markup_share") > MAX_MARKUP_SHARE,
        "junk: broken encoding": F.col("__s_foreign_share") > MAX_FOREIGN_SHARE,
        "junk: symbols": (F.col("__s_symbol_share") > MAX_SYMBOL_SHARE) & ~rows,
        "junk: codes": (_ratio(F.col("__s_n_hex").cast("double"), F.col("__s_n_tokens").cast("double")) > 0.5) | ((F.col("__s_mean_token_length") > MAX_MEAN_TOKEN) & ~rows),
        "table: rows of cells": rows,
        "list: items without a sentence": ~rows & ~sentence & long & items & words_ok,
        "junk: no sentence": ~rows & ~sentence & long & ~(items & words_ok),
        "junk: few letters": ~rows & (F.col("__s_letter_share") < 0.35) & (F.col("__s_n_chars") > 0),
        "junk: no common words": ~rows & sentence & long & (F.col("__s_common_share") < MIN_COMMON_SHARE),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def published() -> Column:
    """The published rules that a measured text fails, by name. They were set for whole web pages: a clause of thirty words
    is too short for one of them, so they are told beside the kind and do not make it."""
    n, lines = F.col("__s_n_words"), F.col("__s_n_lines")
    checks = {
        "word count": (n < PUBLISHED_WORDS[0]) | (n > PUBLISHED_WORDS[1]),
        "mean word length": (F.col("__s_mean_word_length") < PUBLISHED_MEAN_WORD[0]) | (F.col("__s_mean_word_length") > PUBLISHED_MEAN_WORD[1]),
        "symbols to words": F.col("__s_n_signs") > PUBLISHED_SYMBOLS * n,
        "bullet lines": (lines > 0) & (F.col("__s_label_share") > PUBLISHED_BULLETS),
        "ellipsis lines": F.col("__s_ellipsis_share") > PUBLISHED_ELLIPSES,
        "alphabetic words": F.col("__s_n_tokens") * PUBLISHED_ALPHABETIC > n,
        "stop words": F.col("__s_common_share") * n < PUBLISHED_STOP_WORDS,
        "no line ends in a mark": (lines > 0) & (F.col("__s_line_end_share") == 0),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def with_kind(df: DataFrame, text: str = "clause_text") -> DataFrame:
    """Add ``stats``, ``reasons``, ``warnings`` and ``kind``: prose, list, table, junk, or empty for null and blank texts.

    The kind is that of the first rule failed; the warnings are the published rules failed, see :func:`published`. Columns of these names are replaced; others pass through, repeated rows too.
    """
    step = measured(df, text).withColumns({"reasons": reasons(), "warnings": published()})
    first = F.get("reasons", F.lit(0))
    kind = F.when(F.col("__s_n_chars") == 0, "empty").when(first.isNull(), "prose").otherwise(F.substring_index(first, ":", 1))
    # a filter on the kind must stay above it: pushed below, it would repeat every pattern in itself
    fixed = F.when(F.monotonically_increasing_id() >= 0, kind)
    return _gathered(step.withColumn("kind", fixed))


def by_category(kinds: DataFrame) -> DataFrame:
    """Means of the statistics and the count of each kind, by category with its spelling evened out; null stays null."""
    category = F.lower(F.regexp_replace(F.trim("category"), r"[\s_]+", " ")).alias("category")
    means = ("n_words", "n_lines", "mean_word_length", "symbol_share", "line_end_share", "common_share", "verb_share")
    return kinds.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(f"stats.{c}"), 6).alias(c) for c in means],
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("prose", "list", "table", "junk", "empty")],
    )
