"""Problem 6: records of one split that also stand, equal or almost equal, in another.

A sparse suffix array over all texts, word by word, partitioned by the first two words of a suffix and sorted by the words
behind them. Suffixes of two splits with a common prefix are two ends of a shared passage; the passages of a pair are
extended over the whole texts and merged into the share of each record that stands in the other split; an exact count of
differing words decides.

The starts are chosen so that no pair is lost. Of two texts within the limit, ``d`` words apart, the suffixes at the rarest
word pairs are taken from each until ``d + 1`` of their word pairs do not overlap: ``d`` edits cannot touch them all, so the
rarest word pair that is left whole is among those taken on both sides, at places at most ``d`` apart. Counts of word pairs,
taken over all rows, only order the suffixes, drop those whose pair the other side lacks, and spread the work. Equal texts
are one class throughout and are told apart only in the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import written

#: Words of the key that partitions the suffixes.
BLOCK = 2
#: Texts with fewer words are not compared.
MIN_WORDS = 8
#: At most this share of the words of the longer text may differ.
MAX_DIFFERENCE = 0.2
#: Buckets in which keys are counted, and the buckets of each chunk that the counts travel in.
BUCKETS, CHUNK = 1 << 20, 1 << 14
#: Suffixes of one key and side that meet in one task; a key with more is a grid of such cells.
CELL = 8_192
#: Classes a task remembers, so that it emits the suffixes of equal texts once.
SEEN = 500_000
#: Words, padded, and comparisons that are worked on at a time.
PADDED, COMPARED = 1_000_000, 2_000_000
#: Places and sizes are told apart up to here; beyond, every pair of the key is a candidate.
FAR = 0xFFFF
#: Bits of the map that tells which texts are in a candidate pair.
CLASS_BITS = 1 << 24

#: ``first`` has the key, 32 bits, above the numbers of the next two words, 8 bits each; ``at`` has 32 marks, the text's size
#: and the place, 16 bits each; ``m1`` and ``m2`` have 64 marks each; ``who`` has 40 bits of the class, 23 marks and, lowest,
#: whether it is of side 2. A mark is a bit for each word of the text, by its number. What a text's rows have in common stands
#: together, because shuffles are compressed. Two classes may have the same 40 bits: the texts decide.
_MARKS = (64, 64, 32, 23)
_SUFFIX = "first bigint, at bigint, m1 bigint, m2 bigint, who bigint"
#: Words behind the key that order its suffixes.
NEXT = 2

_BROKEN = re.compile(r"[-‐‑­]\s*[\r\n]+\s*")
_JOINS = frozenset("-‐‑'’­​﻿")


class _Plain(dict):
    """What becomes of a character: letters, digits and marks stay, hyphens and apostrophes go, the rest are blanks."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        out = self[code] = None if c in _JOINS else c if unicodedata.category(c)[0] in "LNM" else " "
        return out


_PLAIN = _Plain()
#: The same for ASCII: what becomes of each byte, and which go.
_BYTES = bytes(ord(_PLAIN[c] or " ") if c < 128 else c for c in range(256))
_BYTES_GONE = bytes(c for c in range(128) if _PLAIN[c] is None)
#: The same by code point, filled as they come: 0 is not asked yet, ``_GONE`` goes.
_CODES, _GONE = np.zeros(0x110000, np.uint32), 0xFFFFFFFF


def _plain(text: str) -> str:
    """``text.translate(_PLAIN)``, which is slow beyond ASCII."""
    if text.isascii():
        return text.encode().translate(_BYTES, _BYTES_GONE).decode()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CODES[codes]
    if not out.all():
        for c in set(codes[out == 0].tolist()):
            kept = _PLAIN[c]
            _CODES[c] = _GONE if kept is None else ord(kept)
        out = _CODES[codes]
    return out[out != _GONE].tobytes().decode("utf-32-le")


def words_of(text: str) -> list[str]:
    """Words in lower case; hyphens and soft hyphens join, with a line break after them too."""
    low = text.lower()
    if "\n" in low or "\r" in low:
        low = _BROKEN.sub("", low)
    return _plain(low).split()


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_NUMBERS = _Numbers()


def word_numbers(texts: list[list[str]]) -> np.ndarray:
    """A fixed 64-bit number for each word of all texts, the same on every machine."""
    return np.fromiter(map(_NUMBERS.__getitem__, chain.from_iterable(texts)), np.uint64)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pair_keys(numbers: np.ndarray) -> np.ndarray:
    """A number for each word and the one behind it."""
    return _mixed(numbers[:-1] * _MULT + numbers[1:])


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).astype(np.int64)


def reach(n: np.ndarray) -> np.ndarray:
    """The most words that a text of ``n`` words can be apart from another, longer ones included."""
    return (n * (MAX_DIFFERENCE / (1 - MAX_DIFFERENCE)) + 1e-9).astype(np.int64)


def raw_bit(text: str) -> int:
    """A number of 24 bits that texts delivered alike share: tells at little cost which texts need not be read again."""
    import xxhash

    return xxhash.xxh64_intdigest(text) & (CLASS_BITS - 1)


def class_of(text: str, seed: int = 0) -> int:
    """A number that equal texts share."""
    import xxhash

    n = xxhash.xxh64_intdigest(text, seed)
    return n - (n >> 63 << 64)


def _rows(df: DataFrame, text: str, split: str, left: str, *more: str) -> DataFrame:
    """(key…, text, side) of the rows that can match: side 1 for ``left``, 2 for any other split."""
    side = F.when(F.col(split) == left, 1).otherwise(2).alias("side")
    return df.where(F.col(split).isNotNull() & F.col(text).isNotNull()).select(*more, F.col(text).alias("text"), side)


def scanned(df: DataFrame, key: str, text: str = "clause_text", split: str = "split", left: str = "train") -> tuple[DataFrame, np.ndarray]:
    """The members (key, side, class, same, raw) and how often the keys of each bucket stand in side 1 and side 2, over all rows.

    One pass gives both. The counts have a fixed size; chunks of them are summed in the cluster as they come.
    """
    rows = _rows(df, text, split, left, F.col(key).alias("key"))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T.StructType.fromDDL("side int, class bigint, same bigint, raw int, chunk int, n binary")])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            words = [words_of(t) for t in b["text"]]
            sizes = np.array([len(w) for w in words], np.int64)
            long = sizes >= MIN_WORDS
            words, sizes, b = [w for w, k in zip(words, long) if k], sizes[long], b[long]
            if not words:
                continue
            side = b["side"].to_numpy().astype(np.int64)
            at = np.repeat((side - 1) * BUCKETS, sizes)[:-1] + bucket(pair_keys(word_numbers(words)))
            inner = np.ones(len(at), bool)
            inner[np.cumsum(sizes)[:-1] - 1] = False  # a pair of two texts
            total += np.bincount(at[inner], minlength=2 * BUCKETS)
            plain = [" ".join(w) for w in words]
            names = {"class": [class_of(t) for t in plain], "same": [class_of(t, 1) for t in plain], "raw": [raw_bit(t) for t in b["text"]]}
            yield pd.DataFrame({"key": b["key"], "side": side, **names, "chunk": None, "n": None})
        flat = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).reshape(-1, CHUNK)
        some = [k for k in range(len(flat)) if flat[k].any()]
        yield pd.DataFrame({"key": None, "side": None, "class": None, "same": None, "raw": None, "chunk": some, "n": [flat[k].tobytes() for k in some]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["chunk"], b["n"]):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        out = [np.minimum(x, np.iinfo(np.uint32).max).astype(np.uint32).tobytes() for x in total.values()]
        yield pd.DataFrame({"chunk": pd.Series([*total], dtype="int32"), "n": out})

    table = written(rows.mapInPandas(scan, schema), "members")
    counts = np.zeros((2 * BUCKETS // CHUNK, CHUNK), np.uint32)
    parts = table.where("chunk is not null").select("chunk", "n").repartition("chunk").mapInPandas(add, "chunk int, n binary")
    for r in parts.collect():  # at most 2 * BUCKETS / CHUNK rows
        counts[r["chunk"]] = np.frombuffer(r["n"], np.uint32)
    return table.where("chunk is null").select("key", "side", "class", "same", "raw"), counts.reshape(2, BUCKETS)


def _apart(taken: np.ndarray) -> np.ndarray:
    """How many of the taken places (rows; texts are columns) do not overlap: in a run every second one."""
    places, texts = taken.shape
    if places > 64 * texts:
        out = np.empty(texts, np.int64)
        for k in range(texts):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], taken[:, k].view(np.int8), [0]))))
            out[k] = ((edge[1::2] - edge[::2] + 1) // BLOCK).sum()
        return out
    out, used = np.zeros(texts, np.int32), np.zeros(texts, bool)
    for row in taken:
        used = row & ~used
        out += used
    return out


def thresholds(rank: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The least rank up to which each column has ``need`` places that do not overlap."""
    places, texts = rank.shape
    usual = np.vstack((np.sort(rank, axis=0), np.full((1, texts), np.iinfo(np.int32).max, rank.dtype)))  # only a rank that stands there can be the least
    low, high, column = np.zeros(texts, np.int64), np.full(texts, places), np.arange(texts)
    while (low < high).any():
        middle = (low + high) // 2
        enough = _apart(rank <= usual[middle, column]) >= need
        high, low = np.where(enough, middle, high), np.where(enough, low, np.minimum(middle + 1, high))
    return np.minimum(usual[high, column], np.iinfo(np.int32).max - 1).astype(np.int64)


def starts(texts: list[list[str]], side: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, key, next words, place, marks…) of the suffixes that decide, but those whose key no other side has.

    All of equal rank are taken or none, so that both sides take the same.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    flat = word_numbers(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - begin[owner]
    keys = np.append(pair_keys(flat), np.uint64(0))
    found = bucket(keys)
    usual = np.minimum(counts.sum(axis=0, dtype=np.int64), (1 << 20) - 1)
    rank = ((usual[found] << 11) | (keys & np.uint64(0x7FF)).astype(np.int64)).astype(np.int32)
    rank[place > sizes[owner] - BLOCK] = np.iinfo(np.int32).max
    limit = np.empty(len(texts), np.int64)
    order, k = np.argsort(sizes, kind="stable"), 0
    while k < len(order):
        n = int(np.searchsorted(sizes[order[k:]] * np.arange(1, len(order) - k + 1), PADDED, "right")) or 1
        rows = order[k : k + n]
        k += n
        column = np.arange(int(sizes[rows].max()))[:, None]
        inside = column < sizes[rows][None, :]
        limit[rows] = thresholds(np.where(inside, rank[np.where(inside, begin[rows][None, :] + column, 0)], np.iinfo(np.int32).max), reach(sizes[rows]) + 1)
    o = np.flatnonzero((rank <= limit[owner]) & (counts[2 - side[owner], found] > 0))
    i = owner[o]
    letter = np.append(np.maximum(flat >> np.uint64(56), np.uint64(1)), np.zeros(BLOCK + NEXT, np.uint64)).astype(np.int64)
    behind = np.zeros(len(o), np.int64)
    for b in range(BLOCK, BLOCK + NEXT):
        behind = behind << 8 | np.where(place[o] + b < sizes[i], letter[o + b], 0)
    mark = ((flat >> np.uint64(32) & np.uint64(0xFFFF)) * np.uint64(sum(_MARKS))) >> np.uint64(16)
    marks, low = [], 0
    for n in _MARKS:
        bit = np.where((mark >= low) & (mark < low + n), np.uint64(1) << (mark - np.uint64(low)) % np.uint64(64), np.uint64(0))
        marks.append(np.bitwise_or.reduceat(bit, begin)[i].view(np.int64))
        low += n
    return i, keys[o], behind, place[o], *marks


def grid(counts: np.ndarray) -> np.ndarray:
    """Of each bucket's keys, into how many groups side 1 and side 2 are divided."""
    return np.maximum(1, -(-counts.astype(np.int64) // CELL))


def _emit(counts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        cells = grid(counts)
        for b in batches:
            texts, names, side = [], [], []
            for t, s in zip(b["text"], b["side"].tolist()):
                w = words_of(t)
                if len(w) >= MIN_WORDS:
                    c = class_of(" ".join(w))
                    if (c, s) not in seen:
                        seen.add((c, s))
                        texts.append(w)
                        names.append(c)
                        side.append(s)
            if len(seen) > SEEN:
                seen.clear()
            if not texts:
                continue
            two = np.array(side, np.int64) == 2
            owner, key, behind, place, m1, m2, m3, m4 = starts(texts, two + 1, counts)
            who = (np.array(names, np.int64) >> 24 << 24 | two)[owner] | m4 << 1
            # a key with many suffixes is a grid of cells: each suffix goes to a line of it, so all meet, once
            found, mine = bucket(key), two[owner].astype(np.int64)
            own, across = cells[mine, found], cells[1 - mine, found]
            again = np.repeat(np.arange(len(key)), across)
            column = np.arange(len(again)) - np.repeat(np.cumsum(across) - across, across)
            line = (who[again] >> 24) % own[again]
            cell = np.where(mine[again] == 0, line * across[again] + column, column * own[again] + line).astype(np.uint64)
            short = (_mixed(key[again] + cell * _MULT) >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)
            size = np.minimum(np.array([len(t) for t in texts]), FAR)[owner]
            at = m3 << 32 | size << 16 | np.minimum(place, FAR)
            yield pd.DataFrame({"first": short << 32 | behind[again] << 16, "at": at[again], "m1": m1[again], "m2": m2[again], "who": who[again]})

    return run


#: The most words that two texts may be apart, by the size of the longer one.
_LIMITS = (MAX_DIFFERENCE * np.arange(FAR + 1) + 1e-9).astype(np.int32)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(who of side 1, who of side 2, their places, the starts such texts must have in common) of the suffixes of one key
    that may belong to texts within the limit.

    ``x`` and ``y`` are rows of ``_SUFFIX``.
    """

    def parts(a: np.ndarray) -> tuple:
        place, size = a[1] & FAR, a[1] >> 16 & FAR
        by = a[0] >> 32 << 17 | place
        o = np.argsort(by, kind="stable")
        marks = [m[o].view(np.uint64) for m in (a[2], a[3], a[1] >> 32 & 0xFFFFFFFF, a[4] >> 1 & 0x7FFFFF)]
        return by[o], place[o].astype(np.int32), size[o].astype(np.int32), a[4][o], marks

    xb, xi, xn, xw, xm = parts(x)
    yb, yi, yn, yw, ym = parts(y)
    low, most = yb >> 17 << 17, np.where(yn == FAR, FAR, reach(yn))
    first = np.searchsorted(xb, np.maximum(yb - most, low))
    size = np.searchsorted(xb, np.minimum(yb + most, low + FAR), "right") - first
    out, k, upto = [np.empty((5, 0), np.int64)], 0, np.cumsum(size)
    while k < len(size):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + COMPARED, "right")))
        s = size[k:end]
        j = np.repeat(np.arange(k, end, dtype=np.int32), s)
        i = np.arange(len(j), dtype=np.int32) + np.repeat((first[k:end] - (np.cumsum(s) - s)).astype(np.int32), s)
        k = end
        n, m = xn[i], yn[j]
        left, longer = xi[i] - yi[j], np.maximum(n, m)
        limit = _LIMITS[longer]
        keep = np.abs(left) + np.abs(n - m - left) <= limit
        far = (longer == FAR) & (np.minimum(n, m) >= int(FAR * (1 - MAX_DIFFERENCE)))
        some = np.flatnonzero(keep | far)
        i, j, limit, far = i[some], j[some], limit[some], far[some]
        # each word that only one of them has is a difference of its own; the marks are fewer than 256
        one = two = np.zeros(len(i), np.uint8)
        for p, q in zip(xm, ym):
            u, v = p[i], q[j]
            one, two = one + np.bitwise_count(u & ~v), two + np.bitwise_count(v & ~u)
            some = np.flatnonzero((np.maximum(one, two) <= limit) | far)
            i, j, limit, far, one, two = i[some], j[some], limit[some], far[some], one[some], two[some]
        # of the starts of the text that took fewer, each edit spoils one at most
        need = np.where(far, 1, np.maximum(1, reach(np.minimum(xn[i], yn[j])) + 1 - limit))
        out.append(np.stack((xw[i], yw[j], xi[i], yi[j], need)))
    return np.concatenate(out, axis=1)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted; the suffixes of one key, a cell at most, are compared once they are all there."""
    held: list[np.ndarray] = []

    def compared(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        two = rows[4] & 1 == 1
        found = _near(rows[:, ~two], rows[:, two])
        found = found[:, found[0] != found[1] - 1]  # equal texts are of one class
        if found.shape[1]:
            found[:2] >>= 24
            found = found[:, np.lexsort(found)]
            found = found[:, np.append(True, (found[:, 1:] != found[:, :-1]).any(axis=0))]  # texts delivered again give the same
            yield pd.DataFrame({"a": found[0], "b": found[1], **dict(zip("ijk", found[2:].astype(np.int32)))})

    for b in batches:
        if not len(b):
            continue
        new = b.to_numpy().T
        key = new[0] >> 32
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from compared(np.concatenate([*held, new[:, :cut]], axis=1))
            held = []
        elif held and held[-1][0, -1] >> 32 != key[0]:
            yield from compared(np.concatenate(held, axis=1))
            held = []
        held.append(new[:, cut:])
    if held:
        yield from compared(np.concatenate(held, axis=1))


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, spans) of the pairs that have as many different places on either side as they must; rows come sorted by pair."""
    held: list[np.ndarray] = []

    def kept(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        first = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        begin, pair = np.flatnonzero(first), np.cumsum(first) - 1
        both = np.unique(pair << 32 | rows[2] << 16 | rows[3])
        ones = np.bincount(np.unique(both >> 16) >> 16)
        twos = np.bincount(np.unique(pair << 16 | rows[3]) >> 16)
        enough = np.flatnonzero(np.minimum(ones, twos) >= np.maximum.reduceat(rows[4], begin))
        if len(enough):
            at, upto = (both & 0xFFFFFFFF).astype("<u4"), np.append(0, np.cumsum(np.bincount(both >> 32))).tolist()
            spans = [at[upto[k] : upto[k + 1]].tobytes() for k in enough.tolist()]
            yield pd.DataFrame({"a": rows[0, begin[enough]], "b": rows[1, begin[enough]], "spans": spans})

    for b in batches:
        if not len(b):
            continue
        rows = np.concatenate([*held, b.to_numpy(np.int64).T], axis=1)
        last = (rows[:2] == rows[:2, -1:]).all(axis=0)
        cut = int(np.argmax(last))
        if cut:
            yield from kept(rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield from kept(held[0])


def places_of(spans: bytes) -> list[tuple[int, int]]:
    """The places (i, j) of a pair."""
    return [(v >> 16, v & 0xFFFF) for v in np.frombuffer(spans, "<u4").tolist()]


def links(df: DataFrame, counts: np.ndarray, text: str = "clause_text", split: str = "split", left: str = "train") -> DataFrame:
    """(a, b, spans): texts of side 1 and side 2, by 40 bits of their class, that may be within the limit, every pair that is
    among them, with the places (i, j) at which suffixes with a common prefix start, see :func:`places_of`; these are as few
    as a text's starts."""
    suffixes = _rows(df, text, split, left).mapInPandas(_emit(counts), _SUFFIX)
    array = suffixes.repartition((F.shiftright("first", 32)).alias("key")).sortWithinPartitions("first")
    linked = array.mapInPandas(_linked, "a bigint, b bigint, i int, j int, k int")
    return linked.repartition("a", "b").sortWithinPartitions("a", "b").mapInPandas(_together, "a bigint, b bigint, spans binary")


def difference(a: list[str], b: list[str], most: int) -> int:
    """Words to insert, delete or replace; ``most + 1`` if more than ``most``. Columns of the table are bit vectors."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    for w in b:
        equal = places.get(w, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (every & ~(across | up)), up & across
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every & ~(equal | down | more)), more & (equal | down)
    return min(score, most + 1)


def coverage(a: list[str], b: list[str], at: list[tuple[int, int]]) -> tuple[float, float]:
    """Share of the words of each text that lies in the shared passages around the places (i, j), merged."""
    ones, twos = [], []
    upto: dict[int, int] = {}  # on a diagonal, where the last passage ends
    for i, j in sorted(at):
        if upto.get(i - j, -1) > i or a[i : i + BLOCK] != b[j : j + BLOCK]:
            continue
        low, high = 0, BLOCK
        while i - low > 0 and j - low > 0 and a[i - low - 1] == b[j - low - 1]:
            low += 1
        while i + high < len(a) and j + high < len(b) and a[i + high] == b[j + high]:
            high += 1
        upto[i - j] = i + high
        ones.append((i - low, i + high))
        twos.append((j - low, j + high))
    out = []
    for spans, n in ((ones, len(a)), (twos, len(b))):
        total = end = 0
        for s, e in sorted(spans):
            total += max(0, e - max(s, end))
            end = max(end, e)
        out.append(total / n if n else 0.0)
    return out[0], out[1]


def _bit_map(bits: DataFrame) -> np.ndarray:
    """A bit for each of ``CLASS_BITS`` numbers, from rows (p)."""
    one = bits.select((F.col("p").cast("bigint") + 1).alias("p"))  # the bit maps count from 1
    maps = one.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(CLASS_BITS // 8, np.uint8)
    for r in maps.collect():  # at most CLASS_BITS / 32,768 rows
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def verified(pairs: DataFrame, members: DataFrame, df: DataFrame, text: str = "clause_text", split: str = "split", left: str = "train") -> DataFrame:
    """(a, b, cover_a, cover_b): the classes of the pairs whose texts differ in at most ``MAX_DIFFERENCE`` of the longer one's
    words, and the share of each that lies in shared passages.

    ``pairs`` and ``members``, of :func:`scanned`, are written tables. Only texts that are in a pair are read word by word and
    sent, told by bit maps of fixed size: of the texts as delivered, and of their classes.
    """
    known = _bit_map(pairs.select(F.explode(F.array("a", "b")).alias("p")).select(F.col("p").bitwiseAND(CLASS_BITS - 1).alias("p")))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = b["class"].to_numpy(np.int64) >> 24 & (CLASS_BITS - 1)
            yield pd.DataFrame({"p": b["raw"].to_numpy()[known[p >> 3] >> (p & 7) & 1 == 1]})

    given = _bit_map(members.select("class", "raw").mapInPandas(asked, "p int"))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[int, str] = {}
            for t in b["text"]:
                r = raw_bit(t)
                w = words_of(t) if given[r >> 3] >> (r & 7) & 1 else ()
                if len(w) >= MIN_WORDS:
                    plain = " ".join(w)
                    c = class_of(plain)
                    p = c >> 24 & (CLASS_BITS - 1)
                    if known[p >> 3] >> (p & 7) & 1:
                        out[c] = plain
            yield pd.DataFrame({"class": pd.Series([*out], dtype="int64"), "words": pd.Series([*out.values()], dtype=object)})

    words = _rows(df, text, split, left).select("text").mapInPandas(texts, "class bigint, words string")
    named = words.groupBy(F.shiftright("class", 24).alias("code"), "class").agg(F.max("words").alias("words"))
    one = pairs.join(named.select(F.col("code").alias("a"), F.col("class").alias("class_a"), F.col("words").alias("x")), "a")
    both = one.join(named.select(F.col("code").alias("b"), F.col("class").alias("class_b"), F.col("words").alias("y")), "b")

    @F.pandas_udf("close boolean, cover_a double, cover_b double")
    def measure(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for xs, ys, spans in batches:
            out = []
            split = {t: ((w := t.split(" ")), frozenset(w)) for t in {*xs, *ys}}  # texts are in many pairs
            for x, y, s in zip(xs, ys, spans):
                (p, u), (q, v) = split[x], split[y]
                most = int(MAX_DIFFERENCE * max(len(p), len(q)) + 1e-9)
                # a word that only one text has is a difference of its own
                both = len(u & v)
                close = len(u) - both <= most and len(v) - both <= most and difference(p, q, most) <= most
                out.append((close, *(coverage(p, q, places_of(s)) if close else (0.0, 0.0))))
            yield pd.DataFrame(out, columns=["close", "cover_a", "cover_b"])

    measured = both.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), measure.asNondeterministic()("x", "y", "spans").alias("m"))
    return measured.where("a <> b and m.close").select("a", "b", "m.cover_a", "m.cover_b")


def _found(df: DataFrame, key: str, text: str, split: str, left: str) -> tuple[DataFrame, DataFrame]:
    members, counts = scanned(df, key, text, split, left)
    linked = written(links(df, counts, text, split, left), "links")
    return members.drop("raw").distinct(), written(verified(linked, members, df, text, split, left), "pairs")


def overlapping(df: DataFrame, key: str = "id", text: str = "clause_text", split: str = "split", left: str = "train") -> DataFrame:
    """(left, right): every pair of a ``left`` record and a record of another split that are equal or almost equal.

    Null and blank texts, texts under ``MIN_WORDS`` words and rows without a split match nothing. A row delivered again is
    one record. Other columns are not read. An empty table gives an empty result.
    """
    member, found = _found(df, key, text, split, left)
    one = member.where("side = 1").select("class", "same", F.col("key").alias("left"))
    two = member.where("side = 2").select("class", "same", F.col("key").alias("right"))
    near = one.join(found, one["class"] == found["a"]).select("left", "b").join(two.withColumnRenamed("class", "b"), "b").select("left", "right")
    return near.union(one.join(two, ["class", "same"]).select("left", "right"))


def covered(df: DataFrame, key: str = "id", text: str = "clause_text", split: str = "split", left: str = "train") -> DataFrame:
    """(key, coverage) of each record outside ``left`` that stands there, equal or almost: the largest share of its words
    that lies in passages shared with one record. By class: no pair of records is built. Rows as in :func:`overlapping`.
    """
    member, found = _found(df, key, text, split, left)
    near = found.select(F.col("b").alias("class"), F.col("cover_b").alias("coverage"))
    equal = member.groupBy("class", "same").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
    best = near.union(equal.where("n1 > 0 and n2 > 0").select("class", F.lit(1.0).alias("coverage"))).groupBy("class").agg(F.max("coverage").alias("coverage"))
    return member.where("side = 2").select("key", "class").join(best, "class").groupBy("key").agg(F.max("coverage").alias("coverage"))
