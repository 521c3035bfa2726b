"""numpy kernels over Arrow text batches: word spans, word codes and window codes.

A batch of texts is one byte buffer with document offsets. Words are runs of bytes of a class; every
class used here treats all bytes of non-ASCII characters alike, so splitting bytes equals splitting
characters. A word's code is a polynomial over random 64-bit byte values, finished by a mixer; a window's
code is a polynomial over its word codes. Two lanes with separate constants give 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def byte_class(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return inside


#: Words of [^\x20\x09-\x0D]+.
SPACED = byte_class(b" \t\n\v\f\r")
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Byte values with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), in place on a fresh array."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Lane:
    """Constants of one 64-bit hash lane and its growing power tables."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte_values = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base, self.window_base = (int(x) * 2 + 1 for x in rng.integers(2**61, 2**62, 2))
        self._tables: dict[int, np.ndarray] = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        table = self._tables.get(base)
        if table is None or len(table) < n:
            size = 1 << max(10, int(n - 1).bit_length())
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            table = np.multiply.accumulate(table)
            if size <= 1 << 22:
                self._tables[base] = table
        return table[:n]


LANES = (Lane(20250117), Lane(74207281))


@dataclass
class Words:
    """Words of a batch: byte spans in buf, codes, and the first word of each document (one more at the end)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def codes(self, lane: Lane) -> np.ndarray:
        """A 64-bit code for each word."""
        out = np.empty(len(self.start), dtype=np.uint64)
        step = 1 << 17
        for i in range(0, len(out), step):
            s, e = self.start[i : i + step], self.end[i : i + step]
            n = e - s
            heads = np.cumsum(n) - n
            at = np.arange(int(n.sum()))
            inside = at - np.repeat(heads, n)
            values = lane.byte_values[self.buf[inside + np.repeat(s, n)]]
            values *= lane.powers(lane.base, int(n.max()))[inside]
            out[i : i + step] = mix(np.add.reduceat(values, heads) + n.astype(np.uint64))
        return out


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def find_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """The words of each document; a word never reaches over a document's end."""
    if lower:
        buf = LOWER[buf]
    mask = np.zeros(len(buf) + 2, dtype=bool)
    mask[1:-1] = inside[buf]
    edge = mask[1:] != mask[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    both = cut[mask[cut] & mask[cut + 1]]
    at = np.flatnonzero(edge)
    if len(both):
        both = np.unique(both)
        at = np.sort(np.concatenate([at, both, both]))
    start, end = at[0::2], at[1::2]
    return Words(buf, start, end, np.searchsorted(start, offsets))


def words_of(column: pa.Array, inside: np.ndarray, lower: bool) -> Words:
    return find_words(*buffer_of(column), inside, lower)


def window_codes(codes: np.ndarray, first: np.ndarray, k: int, lane: Lane) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of k words inside one document, and the index of each one's first word."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    heads = np.cumsum(counts) - counts
    total = int(counts.sum())
    at = np.arange(total) - np.repeat(heads - first[:-1], counts)
    out = np.empty(total, dtype=np.uint64)
    # One window takes the k codes after its start, each times a fixed power: k multiply-adds over the whole batch.
    powers = lane.powers(lane.window_base, k)
    step = 1 << 16
    for i in range(0, total, step):
        part = at[i : i + step]
        acc = np.zeros(len(part), dtype=np.uint64)
        lo, hi = int(part[0]), int(part[-1]) + k
        local, rel = codes[lo:hi], part - lo
        dense = hi - lo - k + 1
        full = np.zeros(dense, dtype=np.uint64)
        for j in range(k):
            full += local[j : j + dense] * powers[j]
        acc += full[rel]
        out[i : i + step] = mix(acc)
    return out, at


def pack_sorted(values: np.ndarray) -> bytes:
    """Non-decreasing non-negative integers as variable-length byte differences."""
    if not len(values):
        return b""
    v = np.diff(values.astype(np.int64), prepend=0)
    return pack_varint(v)


def pack_varint(v: np.ndarray) -> bytes:
    """Non-negative integers, 7 bits a byte, low bits first, the high bit set on all but the last byte."""
    v = v.astype(np.uint64)
    n = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        more = v >> U64(7 * k) > 0
        if not more.any():
            break
        n += more
    heads = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        has = n > k
        byte = (v[has] >> U64(7 * k)) & U64(127)
        out[heads[has] + k] = byte.astype(np.uint8) | np.where(n[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack_varint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    heads = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(heads, last - heads + 1)
    bits = (raw & 127).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(bits, heads).astype(np.int64)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_varint(data))


def word_numbers(words: Words, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, equal for equal bytes and only for these, and the words in order of their numbers.

    ``inside`` is the byte class that the words were found with: its bytes, one after the other, are the words.
    """
    length, data = words.end - words.start, words.buf[inside[words.buf]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary
