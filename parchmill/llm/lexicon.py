"""Language of a text by script and function words; shared by the operators that ask for it."""

from __future__ import annotations

from collections import Counter

import regex

# Function words that tell the four Latin-script languages apart, each in one list only.
FUNCTION_WORDS = {
    "en": "the of and to is for shall not any all at as or by on be with within until has will must that each are if than "
    "which its from this neither nor upon unless where even provided except may under after as does an it into only",
    "de": "der die das und den dem ist mit von zu im für auf nicht auch oder sowie ohne nach vor bis gegen unter alle durch als "
    "bei aus über wird kann darf muss soll ein eine einen einer dass binnen zum zur sich jede werden",
    "fr": "le les des du et une au aux dans sur ne pas est avec ou sans ainsi après avant sous selon contre plus tout tous "
    "chaque doit peut sont cette qui pour par ses leur peuvent devra à",
    "es": "el los las del y una con para no al o sin según antes tras bajo junto cada todos debe puede deberá es su son por "
    "pero esta lo como más se",
}
#: Letters that settle the language at once, by script.
SCRIPTS = {
    "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ru": r"\p{Cyrillic}", "hi": r"\p{Devanagari}",
    "ar": r"\p{Arabic}", "th": r"\p{Thai}", "el": r"\p{Greek}", "ko": r"\p{Hangul}", "he": r"\p{Hebrew}",
}
# End of fixed values.

_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGE = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws.split() if sum(w in o for o in _WORDS.values()) == 1}
_SCRIPT = {k: regex.compile(v) for k, v in SCRIPTS.items()}
OTHER = regex.compile(r"[^\p{Latin}\P{L}]")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")


def votes(words: list[str]) -> dict[str, int]:
    """Function words of each language among lower-case ``words``."""
    out = Counter(map(_LANGUAGE.get, words))
    del out[None]
    return dict(out)


def script_language(text: str) -> str | None:
    """The language of a text that is not mainly in Latin letters, else None."""
    if text.isascii() or not OTHER.search(text):
        return None
    counts = {k: len(p.findall(text)) for k, p in _SCRIPT.items()}
    if counts["ja"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    k = max(counts, key=counts.get)
    latin = len(regex.findall(r"\p{Latin}", text))
    return k if counts[k] * (2 if k in ("ja", "zh") else 1) > latin else None


def language(text: str, words: list[str] | None = None) -> str:
    """ISO code of the main language, ``und`` where nothing tells."""
    k = script_language(text)
    if k:
        return k
    v = votes(words if words is not None else text.lower().split())
    return max(sorted(v), key=v.get) if v else "und"


def is_dense(text: str) -> bool:
    """Whether the text is mainly in a script that writes no blanks between words."""
    return not text.isascii() and 2 * len(_DENSE.findall(text)) > len(text) // 2
