"""Byte-pair encoding and decoding with contiguous rank arrays.

A word's parts are held as a list of ids with a parallel list of the ranks of adjacent pairs. The least rank is
found by scanning, its boundary deleted, and the two neighbouring ranks refreshed; words are short, so scanning
beats a heap. A word that is not short (junk without spaces) goes through a heap over linked parts, so that it
costs n log n. Encoding works word by word, so each different word of a task's texts is merged once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import claim, tidy

#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHORT = 96
_KEPT = 64  # longer words are not kept in the caches, which thus stay within some 100 MB
_NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """Printable symbol -> byte, as byte-level vocabularies write bytes: visible bytes stand for themselves."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self._single = [vocab[s] for s, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self._rank: dict[tuple[int, int], int] = {}
        self._merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._rank[vocab[left], vocab[right]] = rank
            self._merged.append(vocab[left + right])
        self._special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._texts: dict[str, str] = {}
        self._decoded: dict[str, bytes] = {}

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word: merges by rank, the leftmost of equals first."""
        ids = [self._single[b] for b in word]
        if len(ids) > _SHORT:
            return self._encode_long(ids)
        rank, merged = self._rank.get, self._merged
        ranks = [rank(pair, _NEVER) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            k = ranks.index(least)
            ids[k] = merged[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), _NEVER)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), _NEVER)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := self._rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if not alive[k] or nxt >= n or ids[k] != left or ids[nxt] != right:
                continue
            ids[k], alive[nxt], after[k] = self._merged[r], False, after[nxt]
            if after[nxt] < n:
                before[after[nxt]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (s := self._rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (s, a, ids[a], ids[b]))
        return [i for i, x in zip(ids, alive, strict=True) if x]

    def _word_text(self, word: str) -> str:
        out = self._texts.get(word)
        if out is None:
            out = ",".join(map(str, self.encode_word(word.encode("utf-8", "replace"))))
            if len(word) <= _KEPT:
                if len(self._texts) > 250_000:
                    self._texts.clear()
                self._texts[word] = out
        return out

    def encode_parts(self, text: str | None) -> list[str]:
        """Comma-joined ids of each word of a whole text; special tokens in the text are their own ids."""
        if not text:
            return []
        spans = [(0, len(text), None)]
        if self._special_at is not None and any(t in text for t in self.special):
            spans, at = [], 0
            for m in self._special_at.finditer(text):
                spans += [(at, m.start(), None), (m.start(), m.end(), str(self.special[m.group()]))]
                at = m.end()
            spans.append((at, len(text), None))
        out: list[str] = []
        known = self._texts.get
        for s, e, special in spans:
            if special:
                out.append(special)
            else:
                out += [known(w) or self._word_text(w) for w in PATTERN.findall(text[s:e] if e - s < len(text) else text)]
        return out

    def encode(self, text: str | None) -> list[int]:
        joined = ",".join(self.encode_parts(text))
        return list(map(int, joined.split(","))) if joined else []

    def decode_parts(self, parts: list[str]) -> str:
        """Text of comma-joined ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join([self._decoded.get(p) or self._decode(p) for p in parts]).decode("utf-8", "replace")

    def _decode(self, part: str) -> bytes:
        out = b"".join([self.bytes_of[int(i)] for i in part.split(",")])
        if len(part) <= 4 * _KEPT:
            if len(self._decoded) > 250_000:
                self._decoded.clear()
            self._decoded[part] = out
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's own codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(path: str, text: str = "text") -> Column:
    """Column of the ids of each whole text (null and empty: no ids)."""

    @F.pandas_udf("array<int>")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in blocks:
            yield pd.Series([codec(path).encode(x) for x in block])

    return of(F.col(text))


def decoded(path: str, ids: str = "ids") -> Column:
    """Column of the text of each list of ids (null: the empty text)."""

    @F.pandas_udf("string")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in blocks:
            yield pd.Series([codec(path).decode([] if x is None else [int(i) for i in x]) for x in block])

    return of(F.col(ids))


def round_trip(path: str, text: str = "text") -> Column:
    """Column of (n_tokens, ids_sha256, decoded_sha256): the text encoded, its ids decoded again, both digested."""
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("bpe", _codecs)
        own = codec(path)
        for block in blocks:
            out = []
            for x in block:
                parts = own.encode_parts(x)
                ids = ",".join(parts)
                out.append((ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(own.decode_parts(parts).encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return of.asNondeterministic()(F.col(text))
