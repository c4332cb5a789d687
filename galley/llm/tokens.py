"""Exact ids of a public byte-level BPE tokenizer, by dynamic programming over prefixes.

For every prefix of a piece of text the table holds the last token of its encoding:
the longest token that ends there (an automaton over all tokens gives the tokens that
are suffixes of the prefix, longest first) such that the rest of the prefix has its own
encoding whose last token may stand before it. Two tokens may stand side by side if
encoding their joined bytes gives back the two. Exactly one token passes for every
prefix; following the table backwards from the end gives the ids.

The whole texts are encoded. An empty text has no ids (an empty list); a null text has
none either (an empty list), so that every document has a list.

Pieces come from the tokenizer's own pattern and are cached per task, so a common word
is encoded once. The cache is bounded by characters and emptied when full.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import spread
from galley.sources.tables import table

TOKENIZERS = os.environ.get("GALLEY_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of pieces that a task's cache holds at most; pieces longer than LONG aren't kept.
CACHE_CHARS, LONG = 4_000_000, 200


class Encoder:
    """Byte-pair encoding with the vocabulary of a .tiktoken file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.split = regex.compile(PATTERN).findall
        self.rank: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, number = line.split()
                # bytes stand as the characters of the same numbers
                self.rank[base64.b64decode(token).decode("latin-1")] = int(number)
        self.text = {i: t for t, i in self.rank.items()}
        self.parts = self._parts()
        self.machine = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.machine.add_word(token, (len(token), number))
        self.machine.make_automaton()
        self.shorter = self._shorter()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}
        self.held = 0

    def _merge(self, text: str, below: int) -> list[str]:
        """The pieces after all merges of rank under `below`, lowest rank first."""
        pieces = list(text)
        while len(pieces) > 1:
            ranks = [self.rank.get(a + b, below) for a, b in zip(pieces, pieces[1:])]
            low = min(ranks)
            if low >= below:
                break
            k = ranks.index(low)
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        return pieces

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens each token was merged from; a single byte is its own."""
        parts = {}
        for token, number in self.rank.items():
            if len(token) > 1:
                two = self._merge(token, number)
                if len(two) == 2:
                    parts[number] = (self.rank[two[0]], self.rank[two[1]])
        return parts

    def _shorter(self) -> dict[int, int]:
        """For each token the longest other token that is its suffix."""
        out = {}
        for token, number in self.rank.items():
            for k in range(1, len(token)):
                if (other := self.rank.get(token[k:])) is not None:
                    out[number] = other
                    break
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both gives back these two tokens.

        The last merge made across the border, were there one, would come before the
        merge that made the left or the right token; so both are taken apart, the one of
        higher rank first, and each border token pair is looked up.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        rank, text, parts = self.rank, self.text, self.parts
        limit = 1 << 60
        while True:
            joined = rank.get(text[a] + text[b])
            if joined is not None and joined < limit:
                return False
            pa, pb = parts.get(a), parts.get(b)
            if pa is None and pb is None:
                return True
            # undo the later of the two merges; the left one on a tie happens first
            if pb is None or (pa is not None and a > b):
                limit, a = a, pa[1]
            elif pa is None or b > a:
                limit, b = b + 1, pb[0]
            else:  # the same token twice: the left merge is made first, so the right is undone first
                limit, b = b + 1, pb[0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.rank.get(raw)
        if whole is not None:
            return [whole]
        n, text, shorter, fits = len(raw), self.text, self.shorter, self.fits
        last = [0] * n
        for end, (_, token) in self._longest(raw):
            while True:
                start = end + 1 - len(text[token])
                if start == 0 or fits(last[start - 1], token):
                    last[end] = token
                    break
                token = shorter[token]
        ids = []
        end = n - 1
        while end >= 0:
            ids.append(last[end])
            end -= len(text[last[end]])
        return ids[::-1]

    def _longest(self, raw: str) -> Iterator[tuple[int, tuple[int, int]]]:
        """For every end position the longest token that ends there."""
        at, best = -1, None
        for end, found in self.machine.iter(raw):
            if end != at:
                if at >= 0:
                    yield at, best
                at, best = end, found
            elif found[0] > best[0]:
                best = found
        if at >= 0:
            yield at, best

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= LONG:
                    self.held += len(piece)
                    if self.held > CACHE_CHARS:
                        cache.clear()
                        self.held = len(piece)
                    if len(self.pairs) > CACHE_CHARS // 4:
                        self.pairs.clear()
                    cache[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens."""
    path = f"{folder or TOKENIZERS}/{tokenizer}.tiktoken"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "ids": [coder.encode(t) for t in b["text"]]})

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows).mapInPandas(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}
QUERIES = {"p8_ids": p8_ids}
