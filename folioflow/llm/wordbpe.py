"""Ids of whole texts under a public word-piece BPE file, by the tokenizers library, at corpus speed.

The file's pipeline turns runs of white space into one space, splits there and drops it, so the ids of a text are
those of its space-separated chunks in order. Chunks repeat a lot: each Python worker keeps the ids of the chunks it met
first in a hash table of fixed size in numpy, found by 64-bit chunk codes for a whole batch at once, and has the
tokenizer encode all others anew. Two chunks of one code would share their ids; with a full table that befalls a new chunk
with probability 4e-14.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from folioflow.llm import textkernels as K

#: Printable ASCII without the apostrophe: here normalising is lower-casing, and bytes stand for themselves.
PLAIN = re.compile(r"[!-&(-~]+")
PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
MOST_IDS = 255
PROBES = 16


class ChunkIds:
    """A tokenizer with a table of 2**bits slots: code, and place and number of the chunk's ids in ``flat``.

    A slot takes 13 bytes and an entry's ids some 6 more, so the default table of a million slots has about 20 MB.
    """

    def __init__(self, path: str, bits: int = 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.bits = Tokenizer.from_file(path), bits
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        # A few slots more, so that probing never wraps around.
        self.code = np.zeros((1 << bits) + PROBES, np.uint64)
        self.place = np.zeros(len(self.code), np.uint32)
        self.count = np.zeros(len(self.code), np.uint8)
        self.flat = np.zeros(1 << 12, self.dtype)
        self.used = self.entries = 0

    def encode_chunk(self, chunk: str) -> list[int]:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return [t.id for piece in PIECES.findall(chunk.lower()) for t in self.model.tokenize(piece)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code, -1 for those that have none."""
        at = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        slot = np.where(self.code[at] == codes, at, -1)
        left = np.flatnonzero((slot < 0) & (self.code[at] != 0))
        for step in range(1, PROBES):
            if not len(left):
                break
            place = at[left] + step
            held = self.code[place]
            same = held == codes[left]
            slot[left[same]] = place[same]
            left = left[~same & (held != 0)]
        return slot

    def add(self, code: int, ids: np.ndarray) -> None:
        """Keep a chunk's ids while the table is under three quarters full and a slot near its own is free."""
        if 4 * self.entries >= 3 << self.bits or len(ids) > MOST_IDS:
            return
        at = code >> (64 - self.bits)
        free = np.flatnonzero(self.code[at : at + PROBES] == 0)
        if not len(free) or not code:
            return
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.dtype)])
        at += int(free[0])
        self.code[at], self.place[at], self.count[at] = code, self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.entries += 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and where each text's begin (one more at the end); null is the empty text."""
        words = K.words_of(texts, K.SPACED, lower=False)
        codes = words.codes(K.LANES[0])
        slot = self.find(codes)
        start, count, source = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64), self.flat
        new = np.flatnonzero(slot < 0)
        if len(new):
            code, first, which = np.unique(codes[new], return_index=True, return_inverse=True)
            spans = zip(words.start[new[first]].tolist(), words.end[new[first]].tolist())
            made = [np.array(self.encode_chunk(words.buf[a:b].tobytes().decode("utf-8")), self.dtype) for a, b in spans]
            sizes = np.array([len(x) for x in made])
            source = np.concatenate([self.flat[: self.used], *made])
            start[new], count[new] = (self.used + np.cumsum(sizes) - sizes)[which], sizes[which]
            for c, ids in zip(code.tolist(), made):
                self.add(c, ids)
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = source[np.repeat(start - ends[:-1], count) + np.arange(int(ends[-1]))]
        return ids, ends[words.first]


_LOADED: dict[tuple[str, int], ChunkIds] = {}


def chunk_ids(path: str, bits: int = 20) -> ChunkIds:
    """The worker's own table for a tokenizer file."""
    key = (path, bits)
    if key not in _LOADED:
        _LOADED[key] = ChunkIds(path, bits)
    return _LOADED[key]
