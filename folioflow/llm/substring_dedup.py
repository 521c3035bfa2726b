"""Substring dedup with a count-min prefilter.

Documents are dealt into parts by their id and text. Every part makes a sparse count-min sketch of its windows:
``depth`` rows of cells that count to ``FULL`` and stay there, of which only filled ones are sent. The sketches are added
cell by cell, each range of cells in its own task, and each part gets back those of its cells whose sum says that a window
may repeat. A window's estimate is the least of its cells; no cell counts less than the windows that fall into it, so a
window that occurs twice anywhere is never lost. A second pass sends only windows estimated repeated, with two 64-bit codes
over two independent codes of every word, to be grouped exactly; a part sends each of them once, where it is earliest, and
settles copies inside itself. Neither sketch nor windows ever meet in one task or the driver, and a passage that a third of
all documents share is sent once per part. The texts are shuffled once; the three passes read the same exchange.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import shuffle_partitions, text_bytes

CELLS = "range int, part int, once binary, full binary"
REPEATED = "part int, range int, cells binary"
KEYS = "range int, part int, hi binary, lo binary, window binary, doc binary, pos binary"
LATER = "part int, window binary"
#: A counter's greatest value: a window that occurs so often is repeated, however often it is.
FULL = 2
OUT = "doc_id long, n_words long, n_removed long, kept string"


class Part:
    """Words and windows of one part, its documents in order of id and then text."""

    def __init__(self, table: pa.Table, k: int, both: bool):
        order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        self.docs = table.take(order)
        ids = self.docs["doc_id"]
        # Null ids sort last in Arrow; they count as the largest id.
        self.doc_id = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.words = K.words_of(self.docs["text"], K.SPACED, lower=False)
        self.hi, self.at = K.window_codes(self.words.codes(K.LANES[0]), self.words.first, k, K.LANES[0])
        self.lo = K.window_codes(self.words.codes(K.LANES[1]), self.words.first, k, K.LANES[1])[0] if both else None

    def place(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document ids and positions in their documents of windows."""
        word = self.at[window]
        d = np.searchsorted(self.words.first, word, side="right") - 1
        return self.doc_id[d], word - self.words.first[d]


def cells_of(codes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(codes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def cell_counts(codes: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filled cells of one row of a part's sketch, ascending, and their counters."""
    found = np.sort(cells_of(codes, row, bits))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
    return found[first], np.minimum(np.diff(np.append(first, len(found))), FULL)


def full_cells(once: list[np.ndarray], full: list[np.ndarray]) -> np.ndarray:
    """The cells whose counters add up to FULL or more: those full somewhere, and those that two parts have at least."""
    every = np.sort(np.concatenate([*once, *full, *full]))
    return distinct_sorted(every[1:][every[1:] == every[:-1]])


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, depth: int = 2, part_bytes: int = 8 << 20, carry: tuple[str, ...] = (), untouched_as_is: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept, the kept words joined by one space.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. A word is removed
    when a window of ``window`` words that covers it starts earlier too: in a document of smaller id, or earlier in the
    same document. All windows are judged on the input. Rows that share an id and a start are equally early, so neither
    loses its window to the other; rows without an id, or with one that many rows share, are spread by their texts. Null or empty texts give zero counts and an empty string, texts of fewer words than
    a window keep all of them; a null id counts as the largest. Other columns are ignored; an empty table gives no rows.
    ``depth`` is the sketch's number of rows; a row has at least as many cells as the corpus has bytes, some six a window.
    Columns named in ``carry`` come out as a struct ``carried``; with ``untouched_as_is`` a text that loses no word is kept as
    it was, white space and null included.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    n_parts = max(shuffle_partitions(spark), -(-total // part_bytes), 1)
    range_bits = max(3, int(max(shuffle_partitions(spark), total // (16 << 20)) - 1).bit_length())
    cell_bits = max(range_bits + 6, min(60, int(total).bit_length()))
    schema_cols = [F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), F.lit(n_parts)).cast("int").alias("part"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    if carry:
        schema_cols.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    parts = docs.select(*schema_cols).repartition(n_parts, "part")
    out_schema = OUT + (f", carried {parts.schema['carried'].dataType.simpleString()}" if carry else "")

    def sketch(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        codes = Part(table, window, both=False).hi
        ranges, once, full = [], [], []
        for row in range(depth):
            found, count = cell_counts(codes, row, cell_bits)
            cuts = np.searchsorted(found, np.arange((1 << range_bits) + 1) << (cell_bits - range_bits))
            for r in np.flatnonzero(np.diff(cuts)):
                mine, n = found[cuts[r] : cuts[r + 1]] - (int(r) << (cell_bits - range_bits)), count[cuts[r] : cuts[r + 1]]
                ranges.append((row << range_bits) + int(r))
                once.append(K.pack_sorted(mine[n < FULL]))
                full.append(K.pack_sorted(mine[n >= FULL]))
        return pa.table({"range": pa.array(ranges, pa.int32()), "part": pa.array([part] * len(ranges), pa.int32()), "once": pa.array(once, pa.binary()), "full": pa.array(full, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        once, full = ([K.unpack_sorted(x) for x in table[c].to_pylist()] for c in ("once", "full"))
        parts_, r = table["part"].to_pylist(), table["range"][0].as_py()
        shared = full_cells(once, full)
        out = [(p, mine) for p, x, y in zip(parts_, once, full) if len(mine := np.sort(np.concatenate([x[member(x, shared)], y])))]
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "range": pa.array([r] * len(out), pa.int32()), "cells": pa.array([K.pack_sorted(x) for _, x in out], pa.binary())})

    def keys(table: pa.Table, repeated: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in (("range", pa.int32()), ("part", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary()), ("window", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()))})
        if not len(table) or not len(repeated):
            return empty
        part = Part(table, window, both=True)
        found: list[list[np.ndarray]] = [[] for _ in range(depth)]
        for r, x in zip(repeated["range"].to_pylist(), repeated["cells"].to_pylist()):
            row, r = r >> range_bits, r & ((1 << range_bits) - 1)
            found[row].append(K.unpack_sorted(x) + (r << (cell_bits - range_bits)))
        at = np.arange(len(part.hi))
        for row in range(depth):
            shared = np.sort(np.concatenate(found[row])) if found[row] else np.zeros(0, np.int64)
            at = at[member(cells_of(part.hi[at], row, cell_bits), shared)]
        hi = part.hi[at]
        order = np.argsort(hi, kind="stable")
        at = at[order][np.concatenate([[True], np.diff(hi[order]) > 0])] if len(at) else at
        where = (part.hi[at] >> np.uint64(64 - range_bits)).astype(np.int64)
        cuts = np.searchsorted(where, np.arange((1 << range_bits) + 1))
        p, rows = table["part"][0].as_py(), []
        for r in np.flatnonzero(np.diff(cuts)):
            w = np.sort(at[cuts[r] : cuts[r + 1]])
            doc, pos = part.place(w)
            rows.append((int(r), p, part.hi[w].tobytes(), part.lo[w].tobytes(), K.pack_sorted(w), zlib.compress(doc.tobytes(), 1), zlib.compress(pos.astype(np.int64).tobytes(), 1)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), empty.schema.types)], schema=empty.schema) if rows else empty

    def later(table: pa.Table) -> pa.Table:
        def joined(name, kind, get=lambda x: x):
            return np.concatenate([np.frombuffer(get(x), kind) for x in table[name].to_pylist()])

        windows = [K.unpack_sorted(x) for x in table["window"].to_pylist()]
        hi, lo = joined("hi", np.uint64), joined("lo", np.uint64)
        doc, pos = joined("doc", np.int64, zlib.decompress), joined("pos", np.int64, zlib.decompress)
        part, w = np.repeat(np.array(table["part"].to_pylist()), [len(x) for x in windows]), np.concatenate(windows)
        order = np.argsort(hi, kind="stable")
        same = hi[order][1:] == hi[order][:-1]
        multi = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        order = order[multi]  # the rest stand alone
        order = order[np.lexsort((pos[order], doc[order], lo[order], hi[order]))]
        if not len(order):
            return pa.table({"part": pa.array([], pa.int32()), "window": pa.array([], pa.binary())})
        new = np.concatenate([[True], (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        gone = order[(doc[head] != doc[order]) | (pos[head] != pos[order])]
        gone = gone[np.lexsort((w[gone], part[gone]))]
        p, heads = np.unique(part[gone], return_index=True)
        return pa.table({"part": pa.array(p, pa.int32()), "window": pa.array([K.pack_sorted(x) for x in np.split(w[gone], heads[1:])] if len(p) else [], pa.binary())})

    def drop(table: pa.Table, gone: pa.Table) -> pa.Table:
        part = Part(table, window, both=False)
        n_words = part.words.counts
        covered = np.zeros(len(part.words.start) + 1, dtype=np.int64)
        if len(part.hi):
            order = np.argsort(part.hi, kind="stable")
            new = np.concatenate([[True], np.diff(part.hi[order]) > 0])
            first = np.empty(len(order), dtype=np.int64)
            first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            elsewhere = np.zeros(len(order), dtype=bool)
            for x in gone["window"].to_pylist():
                elsewhere[K.unpack_sorted(x)] = True
            removed = elsewhere[first]
            again = np.flatnonzero((first != np.arange(len(first))) & ~removed)
            (d0, p0), (d1, p1) = part.place(first[again]), part.place(again)
            removed[again[(d0 != d1) | (p0 != p1)]] = True
            start = part.at[removed]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + window, -1)
        hit = np.cumsum(covered)[:-1] > 0
        total_hit = np.concatenate([[0], np.cumsum(hit)])
        n_removed = total_hit[part.words.first[1:]] - total_hit[part.words.first[:-1]]
        kept = []
        for i, text in enumerate(part.docs["text"].cast(pa.binary()).to_pylist()):
            words = text.split() if text else []
            if untouched_as_is and not n_removed[i]:
                kept.append(text)
                continue
            if n_removed[i]:
                words = compress(words, (~hit[part.words.first[i] : part.words.first[i + 1]]).tolist())
            kept.append(b" ".join(words))
        out = {"doc_id": part.docs["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out | ({"carried": part.docs["carried"]} if carry else {}))

    repeated = parts.groupBy("part").applyInArrow(sketch, CELLS).groupBy("range").applyInArrow(merge, REPEATED)
    sent = parts.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(keys, KEYS)
    gone = sent.groupBy("range").applyInArrow(later, LATER)
    return parts.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(drop, out_schema)
