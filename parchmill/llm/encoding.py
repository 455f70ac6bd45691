"""Problem 7: encode texts with a byte-level BPE vocabulary by dynamic programming over byte prefixes.

Every prefix of a piece has exactly one valid encoding, so storing the last token of each prefix stores the encodings
of all of them. A token sequence is the encoding of its bytes exactly when each neighbouring pair of tokens is the
encoding of the pair's own bytes; the last token of a prefix is therefore the one token that ends there and is
compatible with the last token of the prefix before it. Appending bytes only extends the table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.operators.clean import one_per_key

#: Fixed value: the published split pattern of the byte_bpe vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("PARCHMILL_TOKENIZERS", "/opt/tokenizers")
#: Entries a worker keeps in each of its caches before it empties them.
CACHE = 400_000


class PrefixEncoder:
    """Encodes with one vocabulary; ``path`` is a ranks file (base64 token, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.token = {b: a for a, b in self.ranks.items()}
        #: Lengths of the tokens that end in a given byte pair, longest first: what can end at a position.
        ends: dict[bytes, set[int]] = {}
        for t in self.ranks:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.split = regex.compile(SPLIT_PATTERN)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain rank-order merging, for the short byte strings of token pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last[i]`` is the last token of ``data[:i + 1]``; extends the list to all of ``data``, in place."""
        ranks, ends = self.ranks, self.ends
        for end in range(len(last) + 1, len(data) + 1):
            for size in (*ends.get(data[end - 2 : end], ()), 1) if end > 1 else (1,):
                start = end - size
                if start < 0:
                    continue
                token = ranks.get(data[start:end])
                if token is not None and (start == 0 or self.compatible(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding of all bytes behind ``last``."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            data = text.encode("utf-8", "replace")
            token = self.ranks.get(data)
            ids = (token,) if token is not None else tuple(self.read(self.extend(data, [])))
            if len(data) <= 64:
                if len(self.pieces) > CACHE:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty give an empty list, a blank text is encoded as it stands."""
        out: list[int] = []
        if text:
            known, piece = self.pieces.get, self.piece
            for p in self.split.findall(text):
                out += known(p) or piece(p)
        return out

    def count(self, text: str | None) -> int:
        known, piece = self.pieces.get, self.piece
        return sum(len(known(p) or piece(p)) for p in self.split.findall(text)) if text else 0


class Encoding:
    """A text with its encoding, kept up to date under appends and edits.

    A piece of the split depends only on the text from its start to one character past its end, so pieces that end
    before an edit stay, and after it the old pieces hold again from the first boundary that both splits share.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text, self.starts = encoder, "", []
        self.parts: list[tuple[int, ...]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]``; returns how many pieces were encoded anew."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("the edit lies outside the text")
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        kept = 0
        while kept < len(ends) and ends[kept] < start - 1:
            kept += 1
        kept = max(0, kept - 1)
        at = self.starts[kept] if kept < len(self.starts) else 0
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, parts, fresh = self.starts[:kept], self.parts[:kept], 0
        for m in self.encoder.split.finditer(text, at):
            if m.start() > start + len(new) and m.start() in old:
                k = old[m.start()]
                starts += [s + shift for s in self.starts[k:]]
                parts += self.parts[k:]
                break
            starts.append(m.start())
            parts.append(self.encoder.piece(m.group()))
            fresh += 1
        self.text, self.starts, self.parts = text, starts, parts
        return fresh

    @property
    def ids(self) -> list[int]:
        return [i for p in self.parts for i in p]


_loaded: dict[str, PrefixEncoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> PrefixEncoder:
    """The worker's encoder for a vocabulary, loaded once a process."""
    path = f"{folder or TOKENIZERS}/{name}.tiktoken"
    if path not in _loaded:
        _loaded[path] = PrefixEncoder(path)
    return _loaded[path]


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as ``array<int>``; null and empty texts give an empty array.

    A narrow map: no shuffle. ``out`` replaces a column of that name.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(name, folder)
        for s in batches:
            yield pd.Series([e.encode(x) for x in s], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Add the number of tokens of ``text``; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(name, folder)
        for s in batches:
            yield pd.Series([e.count(x) for x in s], dtype="int64")

    return df.withColumn(out, count(F.col(text)))


def one_per_id(documents: DataFrame) -> DataFrame:
    """A document delivered again, with the same id and text, is one record.

    Unequal texts under one id, a null id included, are records of their own: each keeps its row. Only ids and hashes of
    the texts are shuffled; the texts stay where they are, but those that stand twice.
    """
    same = documents.withColumn("__same", F.sha2("text", 256))
    return one_per_key(same, "doc_id", "__same").drop("__same")
