"""Problem 9: sentence units of texts in any script, by a linear-chain model and Viterbi decoding.

Each character is tagged as boundary or inside. Only few can be a boundary: after a terminal mark, at a line break, at a
blank between words of a script without sentence marks; elsewhere the tag is inside at no cost, so the chain runs over
those places and over quotation marks and brackets. The chain's state is what is open (nothing, a quotation, a
parenthesis, one in the other); a boundary is possible only where nothing is.

Emissions are log-odds fitted on a bounded sample: how often a word with a period ends a paragraph rather than goes on, which
words begin paragraphs, and, from texts stripped of their marks, how sentences of unpunctuated scripts begin and end. What
follows a mark is calibrated on places nobody doubts: paragraphs joined by a blank, where a boundary is, and marks before a
small letter, where none is. Transitions out of what is open are fitted on how often such a mark is closed in its paragraph.
Hand-set costs are the priors that counts are added to.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.truncation import sample_texts

#: Texts that the model is fitted on: a bound for the driver; every text is decoded whole.
SAMPLE_ROWS = 4_000
#: Characters of a sentence's beginning and end that the model of unpunctuated scripts looks at.
HEAD = 3
#: Hand-set costs of a mark that opens or closes nothing, by what it would, and how many marks they count for.
STRAY, STRAY_WEIGHT = {"Q": -5.0, "P": -3.0}, 50
#: At most so much do counts move the hand-set log-odds of what follows a mark.
MOVED = 2.0

# Abbreviations and months that a small sample may lack.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st no nos art arts sec secs fig p pp vol v vs e.g i.e cf etc approx incl excl rev ed eds inc ltd co corp llc "
    "jan feb mar apr jun jul aug sep sept oct nov dec a.m p.m b.v s.a d.r u.s d z b u.a nr abs bzw ca vgl usw m mme mlle ex sr sra "
    "dra núm pág ej т д п ст г е παρ डॉ".split()
)
MONTHS = frozenset(
    "january february march april may june july august september october november december januar februar märz april mai juni juli "
    "august oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril "
    "mayo junio julio agosto septiembre octubre noviembre diciembre января февраля марта апреля мая июня июля августа сентября октября "
    "ноября декабря".split()
)
# End of fixed values.

_BREAK = r"(?:\r\n|[\n\r\x0c\x85\u2028\u2029])"
_CLOSE = r"(?:[\"”’')\]）」』》\*_]|“|[ \u00a0\u202f]?»)"
_EVENT = regex.compile(
    rf"(?P<stop>[.!?…。！？।॥؟۔｡]+{_CLOSE}*)(?P<gap>\s*)|(?P<line>[^\S\r\n\x0c\x85\u2028\u2029]*{_BREAK}\s*)"
    r"|(?P<mark>[\"“”„«»()\[\]（）「」『』《》])|(?P<blank>(?<=[\p{Thai}\p{Lao}\p{Khmer}\d)])[ \u00a0]+(?=[\p{Thai}\p{Lao}\p{Khmer}]))"
)
_LINES = regex.compile(_BREAK)
_PARAGRAPH = regex.compile(rf"{_BREAK}\s*{_BREAK}")
_MARKED = regex.compile(r"[.!?。！？।॥؟۔]$")
_SCRIPTED = regex.compile(
    r"(?P<latin>\p{Latin})|(?P<cyrillic>\p{Cyrillic})|(?P<greek>\p{Greek})|(?P<arabic>\p{Arabic})|(?P<devanagari>\p{Devanagari})|(?P<thai>\p{Thai})|(?P<east_asian>[\p{Han}\p{Hiragana}\p{Katakana}])"
)
_LABEL = regex.compile(
    r"[ \t\u00a0]*(?:[-*•▪◦‣·–—»>#]+[ \t\u00a0]+|[(\[]?(?:\d{1,3}(?:\.\d{1,3})*|[ivxlIVXL]{1,6}|\p{L})[.):\]]+(?=[ \t\u00a0]|\p{Lo})|\d{1,3}\s+[-–]\s|\d+(?:\.\d+)+(?=\s))"
)
_NAMED = regex.compile(r"\p{Lu}[\p{L}\p{M}]*(?: [\p{L}\p{M}]+){0,2} ?: ")
#: A table row: bars, tabs, columns held apart by blanks, dot leaders; or cells with a delimiter and no blank after it.
_ROW = re.compile(r"^\s*\|.*\|\s*$|\S\s+\|\s+\S.*\s\|\s|\t\S.*\t|\S {3,}\S.*(?: {2,}|\t)\S|\S {3,}\S+\s*$|\.{4,}\s")
_CELLS = re.compile(r"[^;\s]*;[^;\s]+;|(?:\"[^\"]*\"|[^,\s]+(?: [^,\s]+)?),(?:\"[^\"]*\"|[^,\s]+(?: %)?)(?:,|$)")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'’&/\-]*")
_LETTERS = regex.compile(r"\p{L}")
_NOISE = regex.compile(r"ï¿½|â€|Ã.|Â.|\ufffd|0x[0-9A-F]{2}|%[0-9A-F]{2}|&\w+;|</?\w+>|[=~^|\\{}<>#]")
_NOISY = re.compile(r"[ïâÃÂ\ufffd%&<>=~^|\\{}#]|0x")
_ASCII_WORDS = re.compile(r"[A-Za-z]+")
_TAIL = re.compile(r"[^\s\"“„«(（\[]+$")
_NAME = regex.compile(r"\p{L}+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s")
_OTHER_LETTER = regex.compile(r"\p{Lo}")
_BARE = regex.compile(r"[^\p{Thai}\p{Lao}\p{Khmer}]+")
_HIRAGANA = regex.compile(r"\p{Hiragana}")
_WIDE = frozenset("。！？।॥؟۔｡")
_OPEN = {"(": "P", "[": "P", "（": "P", "「": "Q", "『": "Q", "《": "Q", "„": "Q", "«": "Q"}
_SHUT = {")": "P", "]": "P", "）": "P", "」": "Q", "』": "Q", "》": "Q", "»": "Q", "”": "Q"}
#: What is open: nothing, a quotation, a parenthesis, a parenthesis in a quotation, a quotation in a parenthesis.
_STATES = ("", "Q", "P", "QP", "PQ")
_PUSH = {("", "Q"): 1, ("", "P"): 2, ("Q", "P"): 3, ("P", "Q"): 4}
_POP = {1: ("Q", 0), 2: ("P", 0), 3: ("P", 1), 4: ("Q", 2)}
NEVER = -1e9
#: Log-odds from which on a rule is not moved by counts.
SURE = 6.0
#: A text with a longer line than this is not hard-wrapped.
MAX_WRAP = 110


class SentenceModel:
    """Fitted emissions: see :meth:`fit`."""

    def __init__(
        self, ends: dict[str, float], starts: dict[str, float], heads: dict[str, float], tails: dict[str, float] | None = None,
        moved: dict[tuple[str, str], float] | None = None, stray: dict[str, float] | None = None,
    ):
        self.ends, self.starts, self.heads = ends, starts, heads
        self.tails, self.moved, self.stray = tails or {}, moved or {}, stray or dict(STRAY)

    @classmethod
    def fit(cls, texts: Iterable[str]) -> SentenceModel:
        """Log-odds from where paragraphs end and begin, places at which nobody doubts a boundary."""
        texts = [t for t in texts if t]
        with_period, final, first, inner = Counter(), Counter(), Counter(), Counter()
        heads, mid, tails = Counter(), Counter(), Counter()
        for text in texts:
            for para in _PARAGRAPH.split(text):
                para = para.strip()
                if not para:
                    continue
                words = regex.findall(r"([^\s\"“„«(]+?)\.(?=[\"”»’)]*(?:\s|$))", para)
                with_period.update(_key(w) for w in words)
                m = regex.search(r"([^\s\"“„«(]+?)\.[\"”»’)]*$", para)
                if m:
                    final[_key(m[1])] += 1
                found = _WORD.findall(para)
                if found:
                    first[found[0]] += 1
                    inner.update(regex.findall(r"(?<=\p{Ll} )[\p{L}\p{M}]+", para))
                # unpunctuated scripts: what a paragraph begins with, against what stands elsewhere, marks stripped
                for bare in (_BARE.sub("", x) for x in _LINES.split(para)):
                    if len(bare) > 3 * HEAD:
                        heads[bare[:HEAD]] += 1
                        tails[bare[-HEAD:]] += 1
                        mid.update(bare[k : k + HEAD] for k in range(HEAD, len(bare) - HEAD))
        total = sum(with_period.values()) or 1
        base = max(0.05, sum(final.values()) / total)
        ends = {}
        for w, n in with_period.items():
            p = min(0.98, (final[w] + 0.5 * base) / (n + 0.5) / base)
            if n >= 3:
                ends[w] = max(-6.0, math.log(max(p, 1e-4) / (1 - p)))
        starts = {w: math.log((n + 0.5) / (inner[w] + 0.5)) for w, n in first.items() if n >= 3}
        h, k = sum(heads.values()) or 1, sum(mid.values()) or 1
        log_heads = {g: math.log((n / h) / ((mid[g] + 1) / k)) for g, n in heads.items() if n >= 2}
        log_tails = {g: math.log((n / h) / ((mid[g] + 1) / k)) for g, n in tails.items() if n >= 2}
        plain = cls(ends, starts, log_heads, log_tails)
        return cls(ends, starts, log_heads, log_tails, plain._calibrated(texts), _stray(texts))

    def _calibrated(self, texts: list[str]) -> dict[tuple[str, str], float]:
        """For each mark and kind of character behind it, how far the log-odds are from what the sure places ask for.

        One step of expectation and maximisation: places in a paragraph that nobody can be sure of count as the rules
        see them, so that the sure ones, which are boundaries only before a capital, do not count for all.
        """
        seen: dict[tuple[str, str], list[float]] = {}

        def told(text: str, m: regex.Match, boundary: bool | None) -> None:
            score = self._by_rule(text, m)
            if abs(score) < SURE:
                c = seen.setdefault((m["stop"][0], _kind(text, m.end())), [0.0, 0.0, 0.0])
                expected = 1 / (1 + math.exp(-score))
                c[0] += expected if boundary is None else boundary
                c[1] += expected
                c[2] += 1

        for text in texts:
            paras = [p for p in (x.strip() for x in _PARAGRAPH.split(text)) if p]
            for p, q in zip(paras, paras[1:]):
                joined = f"{p[-60:]} {q[:20]}"
                at = len(p[-60:]) + 1
                for m in _EVENT.finditer(joined):
                    if m["stop"] is not None and m.end() == at:
                        told(joined, m, True)
            for p in paras:
                for m in _EVENT.finditer(p):
                    if m["stop"] is not None and m.end() < len(p):
                        told(p, m, False if _kind(p, m.end()) == "small" else None)
        out = {}
        for key, (is_, expected, n) in seen.items():
            shift = math.log((is_ + 1) / (n - is_ + 1)) - math.log((expected + 1) / (n - expected + 1))
            out[key] = max(-MOVED, min(MOVED, shift))
        return out

    def stop_score(self, text: str, m: regex.Match) -> float:
        """Log-odds of a boundary after the terminal mark that ``m`` matched, with its closing marks."""
        score = self._by_rule(text, m)
        if abs(score) >= SURE or not self.moved:
            return score
        return score + self.moved.get((m["stop"][0], _kind(text, m.end())), 0.0)

    def _by_rule(self, text: str, m: regex.Match) -> float:
        at, end, after = m.start(), m.end("stop"), m.end()
        mark = m["stop"]
        if after >= len(text):
            return 9.0
        nxt = text[after]
        spaced = m.start("gap") < after
        kind = mark[0]
        if kind in _WIDE:
            if nxt in "」』”）)，、,;；" or (mark[-1] in "」』" and _HIRAGANA.match(nxt)):
                return -3.0  # the sentence goes on after what is quoted
            return 6.0
        if not spaced:
            # a missing blank: the mark stands between a word and a capital
            joined = nxt.isupper() and after + 1 < len(text) and (text[after + 1].islower() or text[after + 1] in " '’") and at > 2 and text[at - 1].islower() and text[at - 2].islower() and len(mark) == 1
            return self._next(text, after) + 0.5 if joined else -9.0
        low = self._next(text, after)
        if kind in "!?" or (mark[0] == "." and "!" in mark):
            return 4.0 + low
        if kind == "…" or mark.startswith(".."):
            return 1.0 + low
        m2 = _TAIL.search(text[max(0, at - 30) : at])
        word = m2[0] if m2 else ""
        key = _key(word)
        if not word:
            return -2.0 + low
        score = self.ends.get(key)
        if score is None:
            score = 3.0
            if len(word) == 1 and word.isalpha():
                score = -3.0
            elif "." in word and not word[-1].isdigit():
                score = -1.0
            elif key in ABBREVIATIONS:
                score = -3.0
            elif len(word) <= 3 and word[:1].isupper() and not word.isupper():
                score = 0.0
        elif len(word) == 1 and word.isalpha() and score > -2:
            score = -2.0
        if len(mark) > 1 and mark[1] in "\"”’»“)]）" and score < 0:
            score = min(1.0, score + 3.0)  # a closing mark after an abbreviation: the quotation ended there
        if word[-1].isdigit():
            score = 2.5
            w = _NAME.match(text[after : after + 20])
            if w and w[0].lower() in MONTHS and len(word) <= 2:
                return -6.0
        return score + low

    def _next(self, text: str, at: int) -> float:
        c = text[at]
        if c.islower():
            # a name that is written with a small letter first
            return 0.5 if at + 1 < len(text) and text[at + 1].isupper() else -7.0
        if c.isupper():
            w = _WORD.match(text, at)
            s = self.starts.get(w[0], 0.0) if w else 0.0
            return max(-0.5, min(2.5, s))
        if c in ",;:)]%":
            return -8.0
        return 0.3

    def blank_score(self, text: str, m: regex.Match) -> float:
        head = _BARE.sub("", text[m.end() : m.end() + 12])[:HEAD]
        tail = _BARE.sub("", text[max(0, m.start() - 12) : m.start()])[-HEAD:]
        return 1.5 + max(-1.0, min(3.0, self.heads.get(head, 0.0))) + max(0.0, min(1.0, self.tails.get(tail, 0.0)))


def _kind(text: str, at: int) -> str:
    """What kind of character follows a mark; a small letter before a capital begins a name."""
    c = text[at]
    if c.islower() and text[at + 1 : at + 2].isupper():
        return "capital"
    return "small" if c.islower() else "capital" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "mark"


def _stray(texts: list[str]) -> dict[str, float]:
    """Log-odds that a quotation mark or bracket opens or closes nothing in its paragraph, for each of the two."""
    count = {k: [0.0, STRAY_WEIGHT / (1 + math.exp(v)), STRAY_WEIGHT] for k, v in STRAY.items()}
    for text in texts:
        for p in _PARAGRAPH.split(text):
            open_ = {"Q": 0, "P": 0}
            for c in p:
                if c in '"“”„«»「」『』《》()[]（）':
                    k = "P" if c in "()[]（）" else "Q"
                    count[k][2] += 1
                    if _OPEN.get(c) == k or (c in '"“' and not open_[k]):
                        open_[k] += 1
                    elif open_[k]:
                        open_[k] -= 1
                        count[k][1] += 2
    return {k: max(-7.0, min(-2.0, -math.log(max(1e-6, paired / max(1e-6, total - paired))))) for k, (_, paired, total) in count.items()}


def held_out(texts: Iterable[str], model: SentenceModel) -> dict[str, tuple[int, int]]:
    """For each script, how many of the joins of paragraphs that end in a mark, or of lines of unpunctuated scripts, are found.

    Neighbours are joined by a blank, so that nothing but the text tells where the second begins.
    """
    out: dict[str, list[int]] = {}
    for text in texts:
        if not text:
            continue
        bare = _BARE.sub("", text)
        thai = 2 * len(bare) > len(text) // 2
        paras = [p for p in (x.strip() for x in (_LINES if thai else _PARAGRAPH).split(text)) if p and not _LINES.search(p)]
        for p, q in zip(paras, paras[1:]):
            if thai and min(len(_BARE.sub("", p)), len(_BARE.sub("", q))) > 3 * HEAD or (not thai and _MARKED.search(p)):
                c = out.setdefault(_script(q), [0, 0])
                c[0] += len(p) + 1 in unit_starts(f"{p} {q}", model)
                c[1] += 1
    return {k: (a, b) for k, (a, b) in out.items()}


def _script(text: str) -> str:
    m = _SCRIPTED.search(text)
    return (m.lastgroup if m else None) or "other"


def _key(word: str) -> str:
    return (word if word.isalpha() else _DIGITS.sub("#", word)).lower()


def _is_row(line: str) -> bool:
    spread = "|" in line or "\t" in line or "   " in line or "...." in line
    return bool(_CELLS.match(line)) or (spread and bool(_ROW.search(line)))


def _line_scores(text: str) -> tuple[list[int], list[float], list[bool]]:
    """For each line its start, the log-odds of a boundary at the break before it, and whether it is a row or debris."""
    starts, ends = [0], []
    for m in _LINES.finditer(text):
        ends.append(m.start())
        starts.append(m.end())
    ends.append(len(text))
    lines = [text[a:b] for a, b in zip(starts, ends)]
    bare = [x.strip() for x in lines]
    whole = []
    for x in bare:
        n = len(x) - x.count(" ")
        noise = sum(len(k) for k in _NOISE.findall(x)) if n > 12 and _NOISY.search(x) else 0
        few = n > 12 and (n > 2.5 * sum(map(len, _ASCII_WORDS.findall(x)))) and len(_LETTERS.findall(x)) < 0.35 * n
        whole.append(bool(x) and (_is_row(x) or noise > 0.15 * n or few))
    # a longest line of some width tells a hard-wrapped text from one with lines of their own
    width = max(len(x.rstrip()) for x in lines)
    wrapped = 30 <= width <= MAX_WRAP
    score = [0.0] * len(lines)
    k = 0
    while k < len(lines):
        j = k
        while j < len(lines) and bare[j]:
            j += 1
        for i in range(k + 1, j):
            before, here = bare[i - 1], bare[i]
            if whole[i] or whole[i - 1] or _LABEL.match(lines[i]) or (_NAMED.match(here) and not (wrapped and before[-1:].islower() and len(before) > width - 12)):
                score[i] = 8.0
                continue
            word = here.split(" ", 1)[0].split("\t", 1)[0]
            room = len(lines[i - 1].rstrip()) + 1 + len(word)
            dense = wrapped and not here.isascii() and not _SPACE.search(here) and _OTHER_LETTER.search(here)
            full = wrapped and (room > width - 3 or (dense and len(before) >= width - 2))
            if full:
                score[i] = -7.0 if here[:1].islower() else -4.0
            elif here.startswith(("...", "…", ",", ";", ")")):
                score[i] = -6.0
            elif here[:1].islower() and not here[1:2].isupper() and not before.endswith(":"):
                score[i] = -2.0 if len(before) > 25 else 2.0
            else:
                score[i] = 5.0
        k = max(j, k + 1)
    return starts, score, whole


def unit_starts(text: str | None, model: SentenceModel) -> list[int]:
    """Code-point positions at which the sentence units of ``text`` begin."""
    if not text or not text.strip():
        return []
    lines, line_score, whole = _line_scores(text)
    at_line = {s: i for i, s in enumerate(lines)}
    best = [0.0, NEVER, NEVER, NEVER, NEVER]
    back: list[list[tuple[int, bool]]] = []
    place: list[int] = []
    line_no = 0
    labels_end = _label_end(text, 0)

    def step(moves: list[tuple[int, int, float, bool]], where: int) -> None:
        nonlocal best
        new, how = [NEVER] * 5, [(0, False)] * 5
        for a, b, cost, cut in moves:
            v = best[a] + cost
            if v > new[b]:
                new[b], how[b] = v, (a, cut)
        best = new
        back.append(how)
        place.append(where)

    def gap(score: float, where: int) -> None:
        if score > 0 or best[0] > NEVER / 2:
            step([(0, 0, 0.0, False), (0, 0, score, True), (1, 1, 0, False), (2, 2, 0, False), (3, 3, 0, False), (4, 4, 0, False)], where)

    def new_line(where: int, blank: bool, terminal: float | None) -> None:
        nonlocal line_no, labels_end
        while line_no + 1 < len(lines) and lines[line_no + 1] <= where:
            line_no += 1
        start = lines[line_no]
        labels_end = _label_end(text, start)
        if blank:
            score, leave, stay = 20.0, -2.0, -8.0
        else:
            s = line_score[at_line[start]]
            leave, stay = -3.0, -0.3 if s < 0 else -2.0
            if terminal is None:
                score = s
            elif s < 0:
                score = terminal
            else:
                score = max(terminal, 0.0) + s
            if s >= 8.0:
                leave, stay = -0.5, -6.0
        moves = [(0, 0, 0.0, False), (0, 0, score, True)]
        for k in range(1, 5):
            moves += [(k, k, stay, False), (k, 0, leave, False), (k, 0, leave + score, True)]
        step(moves, where)

    for m in _EVENT.finditer(text):
        where = m.start()
        if m["mark"] is not None:
            if where < labels_end or whole[line_no]:
                continue
            _mark(text, m["mark"], where, step, model.stray)
        elif m["blank"] is not None:
            if where >= labels_end and not whole[line_no]:
                gap(model.blank_score(text, m), m.end())
        elif m["line"] is not None:
            if m.end() < len(text):
                breaks = len(_LINES.findall(m["line"]))
                new_line(m.end(), breaks > 1, None)
        else:
            inside = where < labels_end or whole[line_no]
            for k, c in enumerate(m["stop"]):
                if c in "\"“”„«»()[]（）「」『』《》" and not inside:
                    _mark(text, c, where + k, step, model.stray, closing=True)
            breaks = len(_LINES.findall(m["gap"])) if m["gap"] else 0
            score = -9.0 if inside else model.stop_score(text, m)
            if m.end() >= len(text):
                continue
            if breaks:
                new_line(m.end(), breaks > 1, score)
            else:
                gap(score, m.end())

    state = max(range(5), key=best.__getitem__)
    cuts = []
    for how, where in zip(reversed(back), reversed(place)):
        state, cut = how[state]
        if cut:
            cuts.append(where)
    first = len(text) - len(text.lstrip())
    out = [first]
    for c in reversed(cuts):
        if c > out[-1]:
            out.append(c)
    return out


def _label_end(text: str, start: int) -> int:
    m = _LABEL.match(text, start)
    return m.end() if m else start


def _mark(text: str, c: str, at: int, step, stray: dict[str, float], closing: bool = False) -> None:
    """Moves of the state at a quotation mark or bracket; a stray one leaves the state as it is, at a cost."""
    before = text[at - 1] if at else " "
    after = text[at + 1] if at + 1 < len(text) else " "
    opens = _OPEN.get(c)
    shuts = _SHUT.get(c)
    o = s = 0.0
    if c in "\"“":
        opens = shuts = "Q"
        looks_open = (before.isspace() or before in "([（:：„") and not after.isspace() or at == 0
        o, s = (0.0, -3.0) if looks_open and not closing else (-4.0, 0.0)
        if c == "“" and not before.isspace() and not closing and after.isalnum():
            o, s = 0.0, -1.0  # scripts without blanks open it anywhere
    elif c in "»«":
        opens = shuts = "Q"
        o, s = (0.0, -2.0) if c == "«" else (-3.0, 0.0)
    moves = []
    for k, name in enumerate(_STATES):
        moves.append((k, k, stray["Q"] if (k == 0 and c in "\"“„«「『") or (shuts and k and _POP[k][0] == shuts) else stray["P"], False))
        if opens and (name, opens) in _PUSH:
            moves.append((k, _PUSH[name, opens], o, False))
        if shuts and k in _POP and _POP[k][0] == shuts:
            moves.append((k, _POP[k][1], s, False))
    step(moves, at)


def fit_model(df: DataFrame, text: str, key: str, rows: int = SAMPLE_ROWS) -> SentenceModel:
    """Fit on about ``rows`` texts chosen by the hash of their key; every text is decoded whole."""
    return SentenceModel.fit(sample_texts(df, text, key, rows))


def with_unit_starts(df: DataFrame, model: SentenceModel, text: str = "text", out: str = "starts") -> DataFrame:
    """Add the 0-based code-point positions of the units; an empty array for null, empty and blank texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<bigint>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([unit_starts(x, shared.value) for x in s], dtype=object)

    # else the filter that goes with an explode would be pushed below and decode every text a second time
    return df.withColumn(out, find.asNondeterministic()(F.col(text)))


def units(df: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, unit): one row a sentence unit, without the white space after it; none for a blank text."""
    starts = with_unit_starts(df.select(key, text), model, text, "__s")
    ends = F.concat(F.slice("__s", F.lit(2), F.greatest(F.size("__s"), F.lit(1))), F.array(F.length(text).cast("bigint")))
    each = starts.where(F.size("__s") > 0).select(key, text, F.explode(F.arrays_zip(F.col("__s").alias("a"), ends.alias("b"))).alias("u"))
    piece = F.substring(F.col(text), (F.col("u.a") + 1).cast("int"), (F.col("u.b") - F.col("u.a")).cast("int"))
    return each.select(key, F.col("u.a").alias("start_pos"), F.regexp_replace(piece, r"\s+$", "").alias("unit"))
