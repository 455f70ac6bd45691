"""Problem 4: defective answers, each with its type, read against the prompt they answer.

Copies are found by compression: the answer is compressed once alone and once with its prompt as a zstandard
dictionary; a copy nearly vanishes. Refusals and languages come from dictionaries, cuts from the terminal-context model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import lexicon, truncation

# How answers decline, by language.
REFUSALS = {
    "en": (
        r"\b[ITl1](?:['’]m| am)? (?:can ?not|can['’]?t|won['’]?t|will not|must (?:decline|refuse)|have to (?:decline|refuse)|decline|refuse"
        r"|(?:am )?(?:not able|unable)|not able|unable|don['’]?t have|do not have|would (?:rather|prefer) not)",
        r"something I can(?:not|['’]t)",
        r"no opinion will be",
        r"outside (?:my|what I)",
        r"request (?:is |was |has been )?(?:declined|denied|refused|cannot|can ?not)",
        r"not be appropriate for me",
        r"(?:guidelines|policy|policies) (?:prevent|prohibit|do(?:es)? not allow|forbid)",
        r"(?:usage|content) policy",
        r"consult a qualified (?:professional|lawyer|attorney)",
    ),
    "de": (
        r"(?:kann|darf|werde|möchte) (?:ich )?(?:\w+[ ,]+){0,8}(?:nicht|keine)\b",
        r"nicht in der Lage",
        r"(?:muss|möchte) (?:ich )?(?:\w+ ){0,6}ablehnen",
        r"lehne (?:ich )?(?:\w+ ){0,4}ab",
        r"Es tut mir leid|tut mir leid|Leider",
    ),
    "fr": (
        r"je (?:ne )?(?:peux|puis|suis) (?:\w+ ){0,2}pas",
        r"je ne (?:peux|puis) ",
        r"(?:dois|doit) refuser|refuse de|décline",
        r"je (?:suis désolé|regrette)|désolée?\b",
        r"pas en mesure",
    ),
    "es": (
        r"no (?:puedo|debo|me es posible|estoy en condiciones|podemos)",
        r"(?:debo|tengo que) (?:rechazar|declinar|negarme)|rechazo",
        r"lo siento|lamento|disculp",
    ),
}
APOLOGY = r"(?:sorry|apologi[sz]e|my apologies|regret|unfortunately|thank you for|i (?:am|'m) afraid)"
# End of fixed values.

#: An answer that shrinks to this share of its own compressed size, given the prompt, is a copy of it.
COPY_RATIO = 0.45
#: A copy has at most this share of words, or so many, that do not lie in phrases of the prompt; labels and the request
#: itself, given back with it, do not count.
OWN_SHARE, OWN_WORDS = 0.06, 5
#: Below so many bytes of prompt compression tells nothing, and the words alone decide.
FEW_BYTES = 64
#: A declining answer has at most so many words besides the sentences that decline.
REFUSAL_WORDS = 30
#: More than this share of an answer in another language makes it one.
OTHER_SHARE = 0.5
#: Share of function words of one language from which a prompt's language is known.
OWN_EVIDENCE = 0.06
ZSTD_LEVEL = 1

_REFUSAL = re.compile("|".join(p for ps in REFUSALS.values() for p in ps), re.I)
_APOLOGY = re.compile(APOLOGY, re.I)
#: The same for ASCII in lower case, where they are much cheaper.
_LOW_REFUSAL = re.compile(_REFUSAL.pattern.lower())
_LOW_APOLOGY = re.compile(APOLOGY.lower())
#: Without one of these, in lower case, a text matches neither pattern; asked first, because it is much cheaper.
_CUES = (
    " can", "won", "will not", "decline", "refuse", "unable", "not able", "don", "do not", " would", "no opinion", "outside", "request", "not be appropriate",
    "guideline", "polic", "consult", "nicht", "keine", "ablehnen", "lehne", "leid", "je ", "dois", "doit", "décline", "désolé", "regret", "pas en mesure",
    "no p", "no d", "no me", "no est", "rech", "declin", "neg", "lament", "siento", "disculp", "sorry", "apolog", "unfortunately", "thank you", "afraid",
)
_UNITS = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: The same in ASCII, where they are much cheaper.
_ASCII_UNITS = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*)")
_ASCII_WORDS = re.compile(r"[a-zA-Z]+(?:'[a-zA-Z]+)*")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_PROMPT = re.compile(
    r"^\W*(?:you are a legal analyst[^\n]*\n+)?(?:clause category:[^\n]*\n+)?(?:clause text:)?|analy[sz]e this clause using irac format\.?"
    r"(?: respond with exactly four sections[^\n]*)?", re.I,
)
_LABEL_WORDS = frozenset(
    "irac issue rule application conclusion analysis frage regel anwendung ergebnis question règle cuestión regla aplicación conclusión "
    "n a na none null nan nil no answer response output content empty br".split()
)
_NA = re.compile(r"\bn/a\b", re.I)

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")


def units_of(text: str) -> list[str]:
    return (_ASCII_UNITS if text.isascii() else _UNITS).split(text)


def words_of(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


def compressed_ratio(answer: bytes, prompt: bytes) -> float:
    """Size of the answer given the prompt as a dictionary, against its size alone."""
    import zstandard

    alone = len(zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(answer))
    if len(prompt) < 8 or not alone:  # the library takes no shorter dictionary
        return 1.0
    known = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=ZSTD_LEVEL, dict_data=known).compress(answer)) / alone


def own_words(answer: list[str], prompt: list[str], n: int = 4) -> int:
    """How many of the answer's words do not lie in phrases of ``n`` words of the prompt."""
    known = set(zip(*[prompt[k:] for k in range(n)]))
    total = end = 0
    for i, g in enumerate(zip(*[answer[k:] for k in range(n)])):
        if g in known:
            total += i + n - max(i, end)
            end = i + n
    return len(answer) - total


def is_copy(answer: str, prompt: str) -> bool:
    """Compression names the candidates; what the answer adds of its own decides.

    An answer of a few words is a copy only if it adds none; a prompt without words is never copied.
    """
    a, p = answer.lower(), prompt.lower()
    given = p.encode("utf-8", "replace")
    if len(given) >= FEW_BYTES and compressed_ratio(a.encode("utf-8", "replace"), given) >= COPY_RATIO:
        return False
    words = [w for w in words_of(_PROMPT.sub(" ", a)) if w not in _LABEL_WORDS]
    known = [w for w in words_of(p) if w not in _LABEL_WORDS]
    if not words or not known:
        return False
    own = own_words(words, known, min(4, len(known)))
    return own <= (max(OWN_WORDS, OWN_SHARE * len(words)) if len(words) > 4 * OWN_WORDS else 0 if len(given) < FEW_BYTES else OWN_WORDS)


def other_language_share(answer: str, own: str) -> float:
    """Share of the answer, in words, that is in a language other than ``own``; units that tell nothing count for neither."""
    mine = other = 0.0
    last = None
    for unit in units_of(answer):
        words = words_of(unit.lower())
        dense = 0 if unit.isascii() else len(_DENSE.findall(unit))
        n = dense / 1.6 if dense > len(unit) / 3 else len(words)
        if n < 2:
            continue
        lang = lexicon.language(unit, words)
        if lang == "und":
            lang = last
        last = lang or last
        if lang is None:
            continue
        if lang == own:
            mine += n
        else:
            other += n
    return other / (mine + other) if mine + other else 0.0


def cues_in(text: str) -> list[str]:
    low = text.lower()
    return [c for c in _CUES if c in low]


def declines(unit: str, cues: Sequence[str] = _CUES) -> bool:
    """``cues``: those that stand in the text that the unit is of."""
    low = unit.lower()
    if not any(c in low for c in cues):
        return False
    return bool(_LOW_REFUSAL.search(low) or _LOW_APOLOGY.search(low) if unit.isascii() else _REFUSAL.search(unit) or _APOLOGY.search(unit))


def _refuses(text: str) -> bool:
    if not text.isascii():
        return bool(_REFUSAL.search(text))
    low = text.lower()
    return any(c in low for c in _CUES) and bool(_LOW_REFUSAL.search(low))


def is_refusal(answer: str) -> bool:
    """Whether the answer declines: sentences that do so, and hardly anything else or less than they are."""
    total = len(words_of(answer))
    long = total > 3 * REFUSAL_WORDS
    if not long and not _refuses(answer):
        return False
    # headings and placeholders are a few words, which only matter in short answers
    said = answer if long else _NA.sub(" ", truncation._LABELS.sub(" ", answer))
    cues = cues_in(said)
    if not cues:
        return False
    rest = declined = 0
    for unit in units_of(said):
        n = len(words_of(unit))
        if n and declines(unit, cues):
            # what runs on behind a declining phrase without an end declines no more
            declined += min(n, 2 * REFUSAL_WORDS)
            rest += max(0, n - 2 * REFUSAL_WORDS)
        else:
            rest += n
        if rest > REFUSAL_WORDS and 2 * rest >= total:  # what is left cannot outweigh it
            return False
    return declined > 0 and (rest <= REFUSAL_WORDS or declined > rest)


def defects(answer: str | None, prompt: str | None, at_limit: bool, model: truncation.TerminalModel) -> list[str]:
    """The defects of one answer, in the order of :data:`DEFECTS`; none for a sound one."""
    if answer is None:
        return ["empty"]
    words = words_of(answer.lower())
    if _LABEL_WORDS.issuperset(words) and truncation.is_empty(answer):
        return ["empty"]
    out = []
    given = prompt or ""
    copied = is_copy(answer, given)
    refusal = not copied and is_refusal(answer)
    said = answer
    if refusal and _NA.search(answer):  # placeholders under the other headings end no refusal
        said = _NA.sub(" ", truncation._LABELS.sub(" ", answer)).rstrip(" \t\r\n:*#")
    if model.is_cut(said, at_limit):
        # a copy of a prompt that was itself cut ends where the prompt does
        if not (copied and answer.rstrip()[-12:] == given.rstrip()[-12:]):
            out.append("truncated")
    if refusal:
        out.append("refusal")
    if copied:
        out.append("copy")
    own = prompt_language(given)
    if own != "und" and not copied and not _is_clear(answer, words, own) and other_language_share(answer, own) > OTHER_SHARE:
        out.append("other_language")
    return out


@lru_cache(maxsize=16)  # the answers of a prompt come one behind the other
def prompt_language(text: str) -> str:
    """The prompt's language, ``und`` unless enough function words or a script of its own tell it."""
    script = lexicon.script_language(text)
    if script or not text:
        return script or "und"
    words = text.lower().split()
    v = lexicon.votes(words)
    best = max(sorted(v), key=v.get, default="und")
    return best if v.get(best, 0) >= max(2, OWN_EVIDENCE * len(words)) else "und"


def _is_clear(answer: str, words: list[str], own: str) -> bool:
    """Whether function words leave no doubt that the answer is in the language ``own``, in Latin letters throughout."""
    v = lexicon.votes(words)
    return bool(v) and v.get(own, 0) >= 0.8 * sum(v.values()) and (answer.isascii() or not lexicon.OTHER.search(answer))


def with_defects(pairs: DataFrame, model: truncation.TerminalModel, answer: str = "raw_response", prompt: str = "clause_text", at_limit: str = "at_limit") -> DataFrame:
    """Add ``defects``, an array of defect names, empty for a sound answer.

    A null, blank or contentless answer is ``empty`` and nothing else. Where the prompt is null or blank, copies and
    other languages cannot be told and are not. A narrow map over the pairs.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for answers, prompts, at in batches:
            yield pd.Series([defects(a, p, bool(x), m) for a, p, x in zip(answers, prompts, at)], dtype=object)

    # else the filter that goes with an explode would be pushed below and read every answer a second time
    find = find.asNondeterministic()
    return pairs.withColumn("defects", find(F.col(answer), F.col(prompt), F.coalesce(F.col(at_limit), F.lit(False))))


def answered(responses: DataFrame, requests: DataFrame, limits: DataFrame) -> DataFrame:
    """(response_id, source, raw_response, clause_text, at_limit) of each response with the clause of its request.

    A response without a request stays, with a null clause; a null source has limits of its own. Rows delivered again repeat and are told apart later.
    """
    r = responses.select("response_id", "id", "source", "raw_response")
    joined = r.join(requests.select("id", "clause_text"), "id", "left")
    of = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.col("size")))
    spikes = limits.groupBy(F.col("source").alias("from")).agg(of("chars").alias("chars"), of("bytes").alias("octets"))
    hit = F.array_contains("chars", F.length("raw_response")) | F.array_contains("octets", F.octet_length("raw_response"))
    return joined.join(spikes, F.col("source").eqNullSafe(F.col("from")), "left").select(
        "response_id", "source", "raw_response", "clause_text", F.coalesce(hit, F.lit(False)).alias("at_limit")
    )
