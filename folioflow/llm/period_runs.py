"""Periodic runs of words, found by matching aligned blocks.

A run is a maximal stretch of words with smallest period q and a length of at least ``least`` words and ``times`` periods.
For every power of two L a document is cut into aligned blocks of L words; the blocks are integer-sequence keys of an
Aho-Corasick automaton, which is run over the document. Stretches of words have numbers that are made anew for every scale
from pairs of the numbers before (equal numbers, equal words), so that a key has as many numbers at every scale and no chain
of failure links grows with the block. A run of period L <= q < 2L holds an aligned block and its copy q words later, so the distances of a block's occurrences that lie in that range are seeds, and a seed is extended to both
sides word by word as far as words q apart are equal. The smallest scale serves all periods below it as well.

Occurrences of one block that follow each other by at most L / 2 make a cluster with the block's own period as spacing. Of
two clusters only the distances of their first and of their last occurrences can be a run's period (the shorter period ends
where the cluster does, and a run of the longer one repeats these ends), so that seeds grow with the words and not with the
square of a cluster. At the smallest scale a cluster's spacing is a seed too.

Only stretches whose every word lies in a window of L0 words (L0 the smallest scale) that occurs again in the document can
hold runs, since windows of a run recur one period on. The windows are compared by hash over whole batches, which may let
more through and never less; blocks are matched on these stretches alone. A document is one row's work, with memory in
proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import crc32_of_id, pieces

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def smallest_scale(least: int) -> int:
    """The largest power of two L with 3 L - 2 <= least: in ``least`` words an aligned block and a copy fit, up to period L."""
    return 1 << (max((least + 2) // 3, 1).bit_length() - 1)


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two arrays are equal; looked at in pieces that double."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        differ = np.flatnonzero(a[done : min(done + step, n)] != b[done : min(done + step, n)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return n


def named_pairs(names: np.ndarray, apart: int) -> np.ndarray:
    """Numbers of the stretches twice as long: equal numbers where both halves, ``apart`` places from each other, are equal."""
    both = names[:-apart] * (int(names.max()) + 1) + names[apart:]
    return np.unique(both, return_inverse=True)[1].astype(np.int64)


def occurrences(names: np.ndarray, step: int, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block number and position of every occurrence of the aligned blocks marked alive, by block and then position.

    ``names`` numbers the stretches of ``step`` words at each position; a block is ``length`` of them, ``step`` apart.
    """
    n, scale, automaton = len(names), step * length, ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for block in np.flatnonzero(alive).tolist():
        key = tuple(names[block * scale : (block + 1) * scale : step].tolist())
        automaton.add_word(key, automaton.get(key, block))
    if not len(automaton):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton.make_automaton()
    # Positions of equal remainder follow each other; a number that no key has parts the remainders.
    rows = -(-n // step) + 1
    laid = np.full(rows * step, int(names.max()) + 1, dtype=np.int64)
    laid[:n] = names
    found = np.array(list(automaton.iter(tuple(laid.reshape(rows, step).T.ravel().tolist()))), dtype=np.int64).reshape(-1, 2)
    rest, turn = np.divmod(found[:, 0] - (length - 1), rows)
    place = turn * step + rest
    order = np.lexsort((place, found[:, 1]))
    return found[order, 1], place[order]


def seeds(block: np.ndarray, place: np.ndarray, scale: int, smallest: bool) -> np.ndarray:
    """(distance, position) of pairs of equal blocks whose distance suits the scale, sorted."""
    if not len(block):
        return np.zeros((0, 2), np.int64)
    near = (block[1:] == block[:-1]) & (np.diff(place) <= scale // 2)
    head = np.flatnonzero(np.concatenate([[True], ~near]))
    first, last, of = place[head], place[np.append(head[1:], len(place)) - 1], block[head]
    found = []
    if smallest:
        many = first < last
        found.append(np.stack([place[head[many] + 1] - first[many], first[many]], axis=1))
    for k in (1, 2, 3):  # a fourth cluster is 2 L away or more
        same = of[k:] == of[:-k]
        for ends in (first, last):
            pair = np.stack([ends[k:] - ends[:-k], ends[:-k]], axis=1)[same]
            found.append(pair[(pair[:, 0] < 2 * scale) & (pair[:, 0] >= (1 if smallest else scale))])
    return np.unique(np.concatenate(found), axis=0)


def runs_of(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of word numbers, by start and then period."""
    n, smallest, found = len(words), smallest_scale(least), {}
    scale, alive, names = smallest, np.ones(n // smallest, dtype=bool), words
    while alive.any() and (scale == smallest or times * scale <= n):
        block, place = occurrences(names, scale // smallest, smallest, alive)
        reached: tuple[int, int] = (0, 0)  # the last distance and where its last stretch of equal words ends
        for distance, at in seeds(block, place, scale, scale == smallest).tolist():
            if reached[0] == distance and at + scale <= reached[1]:
                continue
            end = at + scale + equal_ahead(words[at + scale : n - distance], words[at + scale + distance :])
            start = at - equal_ahead(words[:at][::-1], words[distance : at + distance][::-1])
            reached, length = (distance, end), end + distance - start
            if length >= max(least, times * distance):
                # A period's multiple has the same stretch: the least of them is the run's.
                found[start, length] = min(distance, found.get((start, length), distance))
        # A longer block of a run recurs, and so do its halves.
        recurs = np.zeros(len(alive), dtype=bool)
        if len(block):
            again = np.isin(block, block[1:][block[1:] == block[:-1]]) & (place % scale == 0)
            recurs[place[again] // scale] = True
        pairs = len(recurs) // 2
        alive = recurs[: 2 * pairs : 2] & recurs[1 : 2 * pairs : 2]
        if alive.any():
            names = named_pairs(names, scale // smallest)
        scale *= 2
    return sorted((start, length, period) for (start, length), period in found.items())


def stretches(texts: pa.Array, window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end word (in the document) of the stretches that may hold runs."""
    words = K.words_of(texts, K.SPACED, lower=False)
    codes, at = K.window_codes(words.codes(K.LANES[0]), words.first, window, K.LANES[0])
    document = words.document()
    marked = K.mix(codes + document[at].astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))
    order = np.argsort(marked)
    same = marked[order[1:]] == marked[order[:-1]]
    again = at[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    edge = np.zeros(len(document) + 1, dtype=np.int64)
    edge[again] += 1
    edge[again + window] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    if not inside.any():
        return (np.zeros(0, np.int64),) * 3
    other = np.concatenate([[True], (inside[1:] != inside[:-1]) | (document[1:] != document[:-1])])
    start = np.flatnonzero(other)
    end = np.append(start[1:], len(document))
    good = inside[start] & (end - start >= least)
    start, end = start[good], end[good]
    return document[start], start - words.first[document[start]], end - words.first[document[start]]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, drop in zip(words, gone.tolist()) if not drop]


def batch_runs(texts: pa.Array, least: int, times: int) -> tuple[list[list[tuple[int, int, int]]], list[str], list[int]]:
    """Runs, collapsed text and number of words of every text."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    split = lambda i: (texts[i].as_py() or "").encode().split()  # noqa: E731  splits at \x20 and \x09-\x0D alone
    held: tuple[int, list[bytes]] = (-1, [])
    for document, start, end in zip(*(x.tolist() for x in stretches(texts, smallest_scale(least), least))):
        if held[0] != document:
            held = (document, split(document))
        numbers: dict[bytes, int] = {}
        here = np.array([numbers.setdefault(w, len(numbers)) for w in held[1][start:end]], dtype=np.int64)
        runs[document] += [(start + s, length, period) for s, length, period in runs_of(here, least, times)]
    kept, counts = [], []
    for i, mine in enumerate(runs):
        words = split(i)
        counts.append(len(words))
        kept.append(b" ".join(collapsed(words, mine)).decode())
    return runs, kept, counts


def find_periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and then period) and collapsed text per row.

    ``collapsed`` joins by one space the words that no run holds after its first period. ``times`` is 3 or more. Words are
    compared exactly; there is no cap on periods, lengths or runs. Null and empty texts have no words, no runs and an empty
    text; null and repeated ids stay rows of their own; other columns are ignored; an empty table gives no rows.
    """
    if times < 3 or least < 1:
        raise ValueError("runs need three periods and one word at least")
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            runs, kept, counts = batch_runs(batch.column(1), least, times)
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in mine] for mine in runs], pa.list_(RUN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), listed, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    id_type = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(find, f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a periodic tail in one text of ten, chosen and shaped by the CRC-32 of its id.

    With h that number and g = h div 10, where h mod 10 is 0 every word from a = g mod n on (n words) becomes the word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8); such a text's words are joined by one space. Rows without an id or
    without words stay as they are.
    """

    @F.arrow_udf("string")
    def planted(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, mark in zip(texts, marks.to_pylist()):
            words = text.as_py().encode().split() if mark is not None and mark % 10 == 0 and text.is_valid else []
            if not words:
                out.append(text.as_py())
                continue
            g, n = mark // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = words[a : a + p]
            out.append(b" ".join(words[:a] + [tail[i % p] for i in range(n - a)]).decode())
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, planted(F.col(f"`{text_col}`"), crc32_of_id(F.col(f"`{id_col}`"))))


def run_digest(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_periodic_runs``: the run of greatest length / period (ties: the first) and two checksums."""
    runs = F.col("runs")

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat_ws(",", r["start"], F.concat(r["length"], F.lit(","), r["period"], F.lit("\n")))))
    digested = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    share = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return digested.select("doc_id", "n_runs", "best.start", "best.length", "best.period", share, "runs_sha256", "collapsed_sha256")
