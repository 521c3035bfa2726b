"""Packing documents into sequences by a configuration linear program.

The pieces' length histogram, at most ``capacity`` counts, is all that reaches the driver. The program over it is "fewest
bins whose configurations hold every length as often as it occurs". Multiplicative weights solve it: a length's price
starts as its share of a bin and falls as the length gets covered, an unbounded-knapsack dynamic program finds the best
configuration at these prices and, from the same table, the best one around every length, and these cover their lengths
further. Any prices bound the optimum from below: their total over all pieces divided by the best configuration's price.

The configurations found, with the weights at which they covered, are the program's solution. It is rounded by running
sums: configurations with next to no room left, heaviest first, are taken as often as the sum of weights passes a whole
number and as there is something left of every length. What remains is priced anew, round by round, by the shares of each
length that are left, so that scarce and large lengths are used before they block, and what no full bin can be made of is
filled up largest first. This is done for a few shares of the solution and the plan of fewest bins is kept. Where largest
first alone already meets a bound, nothing needs a program. Pieces then look their place up in the plan by their rank
among those of their length, counted where they were cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import pieces, stored
from folioflow.llm.wordbpe import chunk_ids

CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, within long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass
class Plan:
    """Configurations as (lengths, counts, bins), and the greatest lower bound on the number of bins that any prices gave."""

    bins: list[tuple[np.ndarray, np.ndarray, int]]
    bound: float

    @property
    def size(self) -> int:
        return sum(n for *_, n in self.bins)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity`` the greatest value of lengths that fit, and the length taken last; lengths ascend.

    Each room is one vector step over the lengths; of equal values the longest is taken. -1: nothing fits.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fits[room]
        got = (values[:k] + best[room - lengths[:k]])[::-1]
        i = int(got.argmax())
        best[room], choice[room] = got[i], k - 1 - i
    return best, choice


def best_around(which: np.ndarray, lengths: np.ndarray, choice: np.ndarray, capacity: int) -> np.ndarray:
    """A row for each of some lengths: the best configuration that holds it, as indices of lengths, padded with -1."""
    room, taken = capacity - lengths[which], [which]
    while (got := choice[room]).max() >= 0:
        taken.append(got)
        room = np.where(got >= 0, room - lengths[got], room)
    return np.stack(taken, axis=1)


@dataclass
class Solution:
    """The program's solution: configurations as rows of indices of lengths, padded with -1, the number of bins that
    each is used in, a fraction, and the best lower bound on the optimum."""

    rows: np.ndarray
    weight: np.ndarray
    bound: float


def solve_program(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int, rate: float) -> Solution:
    """The program by multiplicative weights.

    A round's configurations are weighed by how near they come to the best one and scaled so that no length is covered
    more than once; then the prices of covered lengths fall. Equal configurations are one, their weights added up, and all
    weights are scaled so that lengths are covered once on average.
    """
    covered, bound = np.zeros(len(lengths)), 0.0
    every, found, weights = np.arange(len(lengths)), [], []
    for _ in range(rounds):
        price = lengths / capacity * np.exp(-rate * (covered - covered.mean()))
        best, choice = knapsack(lengths, price, capacity)
        bound = max(bound, float(need @ price) / best[capacity])
        value = price + best[capacity - lengths]
        weight = np.exp(100 * (value / best[capacity] - 1))
        rows = best_around(every, lengths, choice, capacity)
        held = rows >= 0
        gain = np.bincount(rows[held], np.repeat(weight, held.sum(axis=1)), len(lengths)) / need
        covered += gain / gain.max()
        found.append(np.sort(rows, axis=1)[:, ::-1])
        weights.append(weight / gain.max())
    wide = max(rows.shape[1] for rows in found)
    padded = np.concatenate([np.pad(rows, ((0, 0), (0, wide - rows.shape[1])), constant_values=-1) for rows in found])
    rows, which = np.unique(padded, axis=0, return_inverse=True)
    return Solution(rows, np.bincount(which.ravel(), np.concatenate(weights)) / covered.mean(), bound)


def rounded(solution: Solution, left: np.ndarray, lengths: np.ndarray, capacity: int, share: float, room: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole bins of a share of the solution, taken out of ``left``: configurations with at most ``room`` unused."""
    full = np.where(solution.rows >= 0, lengths[solution.rows], 0).sum(axis=1) >= capacity - room
    rows, weight = solution.rows[full], solution.weight[full] * share
    order = np.argsort(-weight, kind="stable")
    times = np.diff(np.floor(np.cumsum(weight[order]) + 1e-9).astype(np.int64), prepend=0)
    bins = []
    for k in np.flatnonzero(times):
        row = rows[order[k]]
        which, counts = np.unique(row[row >= 0], return_counts=True)
        n = min(int((left[which] // counts).min()), int(times[k]))
        if n:
            left[which] -= n * counts
            bins.append((lengths[which], counts, n))
    return bins


def fill(left: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """One bin filled largest first from what is left: indices and counts."""
    room, which, counts = capacity, [], []
    while True:
        reach = np.searchsorted(lengths, room, side="right")
        usable = np.flatnonzero(left[: min(reach, which[-1]) if which else reach])
        if not len(usable):
            break
        i = int(usable[-1])
        n = min(room // int(lengths[i]), int(left[i]))
        which.append(i)
        counts.append(n)
        room -= n * int(lengths[i])
    return np.array(which), np.array(counts)


def largest_first(left: np.ndarray, lengths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Bins filled largest first until nothing is left."""
    bins = []
    while left.any():
        which, counts = fill(left, lengths, capacity)
        n = int((left[which] // counts).min())
        left[which] -= n * counts
        bins.append((lengths[which], counts, n))
    return bins


def priced(left: np.ndarray, lengths: np.ndarray, need: np.ndarray, capacity: int, share: float, rate: float, bend: float, near: float, most: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Bins of what is left by new prices in every round, taken out of ``left``, until hardly a full bin can be made.

    A length's price is its share of a bin to the power of 1 + ``bend`` (of equally full bins those with long lengths come
    first) times exp(``rate`` * share of the length that is left).
    """
    bins, slack = [], 0
    for _ in range(most):
        open_ = np.flatnonzero(left)
        total = int(left @ lengths) // capacity
        if total < 3 or slack > capacity // 32:
            break
        size, rest = lengths[open_], left[open_] / need[open_]
        price = (size / capacity) ** (1 + bend) * np.exp(rate * (rest - np.average(rest, weights=size * left[open_])))
        best, choice = knapsack(size, price, capacity)
        value = price + best[capacity - size]
        which = np.flatnonzero(value >= (1 - near) * best[capacity]) if not slack else np.arange(len(size))
        which = which[np.argsort(-value[which], kind="stable")]
        rows = best_around(which, size, choice, capacity)
        rows = rows[np.where(rows >= 0, size[rows], 0).sum(axis=1) >= capacity - slack]
        allowed = budget = max(1, int(total * share))
        for row in rows:
            i, counts = np.unique(open_[row[row >= 0]], return_counts=True)
            n = int((left[i] // counts).min())
            if n:
                n = min(max(1, int(2 * share * n)), budget)
                left[i] -= n * counts
                bins.append((lengths[i], counts, n))
                budget -= n
            if not budget:
                break
        if budget == allowed:  # no full bin at these prices: allow a little room, then more
            slack = max(1, 2 * slack)
    return bins


def plan_bins(histogram: dict[int, int], capacity: int, rounds: int = 30, shares: tuple[float, ...] = (1.0, 0.5, 0.0), room: int = 4, share: float = 0.15, rate: float = 0.1, bend: float = 0.3, near: float = 0.03, most: int = 400) -> Plan:
    """Configurations that together hold every length exactly as often as the histogram says.

    ``shares`` of the program's solution are rounded in turn and the rest priced anew (``priced`` with the options after
    ``room``); the plan of fewest bins counts, the first of equals. Without ``shares`` the plan is largest first.
    """
    lengths = np.array(sorted(n for n, k in histogram.items() if k and n < capacity), dtype=np.int64)
    need = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    whole = int(histogram.get(capacity, 0))
    bins = [(np.array([capacity]), np.array([1]), whole)] if whole else []
    # Volume, and lengths over half a bin, which need one each, are bounds without a program.
    plan = Plan(largest_first(need.copy(), lengths, capacity), max(float(need @ lengths) / capacity, float(need[2 * lengths > capacity].sum())))
    if shares and plan.size > np.ceil(plan.bound - 1e-6):
        solution = solve_program(lengths, need, capacity, rounds, 0.05)
        plan.bound = max(plan.bound, solution.bound)
        for part in shares:
            if plan.size <= np.ceil(plan.bound - 1e-6):
                break
            left = need.copy()
            tried = rounded(solution, left, lengths, capacity, part, room)
            tried += priced(left, lengths, need, capacity, share, rate, bend, near, most)
            tried += largest_first(left, lengths, capacity)
            if sum(n for *_, n in tried) < plan.size:
                plan.bins = tried
    return Plan(bins + plan.bins, plan.bound + whole)


def placement_table(bins: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[str, np.ndarray]:
    """For every length, ranges of ranks and where they go: (length, first rank) ascend; base bin, copies a bin, offset."""
    rows, base, rank = [], 0, {}
    for lengths, counts, n in bins:
        offset = 0
        for length, count in zip(lengths.tolist(), counts.tolist()):
            first = rank.get(length, 0)
            rows.append((length, first, base, count, offset))
            rank[length] = first + n * count
            offset += length * count
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "copies", "offset"), table.T))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's ids with the end id, cut into pieces of ``capacity`` ids where longer: a row per piece.

    within counts the pieces of one length inside a task, whose number is part.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, part = chunk_ids(tokenizer_path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4"), np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, 1):
            ids, cuts = store.encode(batch.column(1))
            number, first = np.diff(cuts) + 1, []
            n_pieces = -(-number // capacity)
            heads = np.cumsum(n_pieces) - n_pieces
            doc = np.repeat(np.arange(len(number)), n_pieces)
            piece = np.arange(len(doc)) - heads[doc]
            start = piece * capacity
            length = np.minimum(number[doc] - start, capacity)
            crc = []
            for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist()):
                a, b = cuts[d] + s, min(cuts[d] + s + n, cuts[d + 1])
                part_ids = ids[a:b].astype("<u4")
                crc.append(zlib.crc32(end, zlib.crc32(part_ids)) if b - a < n else zlib.crc32(part_ids))
            order = np.argsort(length, kind="stable")
            first = np.concatenate([[True], np.diff(length[order]) > 0])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            within = seen[length] + rank
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(within)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "within"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, CUT)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids: one row per piece with its sequence and offset.

    A null or empty text is the end id alone. Only documents longer than ``capacity`` are cut; rows that share an id
    are separate documents, and so are rows without one. Offsets in a sequence are gapless from 0. An empty table gives no
    rows. Other columns are ignored. A full piece is a sequence of its own with a negative number; it is never shuffled.
    """
    spark = docs.sparkSession
    cut = stored(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    full, rest = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # fewer than capacity rows
    places = spark.sparkContext.broadcast(placement_table(plan_bins(histogram, capacity, **options).bins))
    # Within has no gaps in a task, so tasks' totals by length, a fraction of the pieces, give every piece's rank.
    counts = rest.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    ranked = rest.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ranked") + F.col("within")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        top = int(at["first"].max(initial=0)) + 1
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            # Ranks of one length lie below ``top`` or in its last range, so one sorted key finds the range.
            row = np.searchsorted(at["length"] * top + at["first"], length * top + np.minimum(rank, top - 1), side="right") - 1
            k = rank - at["first"][row]
            sequence = at["base"][row] + k // at["copies"][row]
            offset = at["offset"][row] + k % at["copies"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    alone = -(F.col("part").cast("long") * F.lit(1 << 32) + F.col("within") + 1)
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, PLACED).unionByName(whole)
