"""Subword ids of a public tokenizer, word by word.

A tokenizer that lower-cases, drops white space and never joins characters across it gives a text
the ids of its blank-separated words, one after another. Corpora repeat words, so each word is
encoded once and then found by its 64-bit hash in a table of fixed size, many words at a time. The
table lives as long as the worker process and is emptied when half full.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from panelwright.llm.common import word_spans

_SLOTS = 1 << 22
_MOST_PARTS = 200_000
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
# Runs that the tokenizer splits no further: letters, or ASCII signs except the apostrophe and "<".
_PLAIN = re.compile(f"[{_LETTERS}]+|[!-&(-/:;=>?@\\[-`{{-~]+")
_AS_BYTES = str.maketrans({
    c: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
    for c in map(chr, range(0xC0, 0x100))})


class Subwords:
    """Encodes words with the tokenizer in a file and remembers them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.key = np.zeros(_SLOTS, np.uint64)
        self.where = np.full(_SLOTS, -1, np.int32)
        self.first, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.ids = np.empty(1 << 17, np.uint32)
        self.words = self.used = 0

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= _MOST_PARTS:
                self.parts.clear()
            ids = [t.id for t in self.tokenizer.model.tokenize(part.translate(_AS_BYTES))]
            self.parts[part] = ids
        return ids

    def _word_ids(self, word: str) -> list[int]:
        low = word.lower()
        parts = _PLAIN.findall(low)
        if len(low) == len(word) and sum(map(len, parts)) == len(low):
            return [i for part in parts for i in self._part(part)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _remember(self, word: str) -> int:
        ids = self._word_ids(word)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        if self.words == len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.first[self.words], self.size[self.words] = self.used, len(ids)
        self.used += len(ids)
        self.words += 1
        return self.words - 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 where unknown. Slots are probed one after another."""
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        found = self.where[slot]
        other = np.flatnonzero((found >= 0) & (self.key[slot] != hashes))
        while len(other):
            slot[other] = (slot[other] + 1) & (_SLOTS - 1)
            found[other] = self.where[slot[other]]
            other = other[(found[other] >= 0) & (self.key[slot[other]] != hashes[other])]
        return found

    def encode_spans(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray,
                     size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by hash and place in ``data``, and how many ids each word has."""
        number = self._find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.words + len(new) > _SLOTS // 2:
                self._clear()
                missing = np.arange(len(hashes))
                new, at = np.unique(hashes, return_index=True)
            key, where, raw = self.key, self.where, data.tobytes()
            for h, k in zip(new.tolist(), missing[at].tolist(), strict=True):
                slot = h & (_SLOTS - 1)
                while where[slot] >= 0:
                    slot = (slot + 1) & (_SLOTS - 1)
                key[slot] = h
                where[slot] = self._remember(raw[start[k]:start[k] + size[k]].decode())
            number = self._find(hashes)
        length = self.size[number].astype(np.int64)
        shift = self.first[number] - (np.cumsum(length) - length)
        return self.ids[np.repeat(shift, length) + np.arange(int(length.sum()))], length

    def encode_texts(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the number of ids before each text."""
        hashes, start, size, before = word_spans(data, edges)
        ids, length = self.encode_spans(data, hashes, start, size)
        return ids, np.concatenate([[0], np.cumsum(length)])[before]


@functools.lru_cache(maxsize=4)
def shared_subwords(path: str) -> Subwords:
    """One table per worker process and file."""
    return Subwords(path)
