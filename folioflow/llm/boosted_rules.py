"""Quality rules by gradient-boosted trees over document statistics.

Every text is reduced to a few exact counts (words, symbols, lines that occur before, words in repeated windows) and these
to a row of statistics. Trees are grown in numpy on the second-order gradients of the logistic loss over quantile bins; on
chosen statistics a tree may only fall (or only rise): a split against the order is refused, and the middle of its two
values bounds everything below it, so the sum of trees keeps the order too. The finished trees are flattened into node arrays
(statistic, threshold, left, right, value; a leaf is its own child), and a batch of documents goes down all trees at once.

Labels are learned from a bounded sample whose statistics are computed by Spark tasks over whole texts; only one row of
numbers per sampled label reaches the driver. Fixed rules go before the trees: too short texts and texts that repeat
themselves are not kept, whatever the trees say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import crc32_of_id, pieces

def only(*members: int) -> np.ndarray:
    """True for the byte values given."""
    return np.isin(np.arange(256), members)


SYMBOLS, STOPS = only(*b"#*$%&|<>"), only(*b".!?")
DIGITS, UPPER, PUNCTUATION = only(*b"0123456789"), only(*range(65, 91)), only(*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))
#: First bytes of characters.
LEADS = ~only(*range(128, 192))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics and the direction a document's verdict may take as they grow: -1 worse only, 1 better only, 0 free.
STATISTICS = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 0,
    "top_word_share": -1,
    "digits_per_char": 0,
    "upper_per_char": 0,
    "stops_per_word": 0,
    "punctuation_per_char": 0,
    "words_per_line": 0,
    "long_word_share": -1,
}


def per_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes are marked between neighbouring offsets."""
    return np.diff(np.searchsorted(np.flatnonzero(marked), offsets))


def line_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of every text, and those with a word that are equal to an earlier line of it."""
    n, breaks = len(offsets) - 1, buf == 10
    lines = per_text(breaks, offsets) + 1
    first = np.cumsum(lines) - lines
    # A text's lines end at its breaks and at its end.
    ends = np.sort(np.concatenate([np.flatnonzero(breaks), offsets[1:]]))
    starts = np.empty(len(ends), dtype=np.int64)
    starts[1:] = ends[:-1] + 1
    starts[first] = offsets[:-1]
    bodies = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bodies), pa.py_buffer(np.ascontiguousarray(buf[~breaks]))]).dictionary_encode()
    filled = np.flatnonzero(K.SPACED[buf])
    good = np.flatnonzero(np.searchsorted(filled, ends) > np.searchsorted(filled, starts))
    text = np.repeat(np.arange(n), lines)[good]
    which = np.sort(text * len(coded.dictionary) + coded.indices.to_numpy().astype(np.int64)[good])
    return lines, np.bincount(which[1:][which[1:] == which[:-1]] // max(len(coded.dictionary), 1), minlength=n)


def repeated_words(words: K.Words, numbers: np.ndarray, window: int) -> np.ndarray:
    """Words of every text that lie in a window found twice or more in it; windows of equal hash are compared word by word."""
    n, document = len(words.first) - 1, words.document()
    for seed in range(20250117, 20250217):
        lane = K.Lane(seed)
        codes, at = K.window_codes(K.mix(numbers.astype(np.uint64) + K.U64(1)), words.first, window, lane)
        codes = K.mix(codes + document[at].astype(np.uint64) * K.U64(lane.base))
        order = np.argsort(codes)
        same = np.flatnonzero(codes[order[1:]] == codes[order[:-1]])
        a, b = at[order[same]], at[order[same + 1]]
        if all((numbers[a + j] == numbers[b + j]).all() for j in range(window)) and (document[a] == document[b]).all():
            break
    edge = np.zeros(len(document) + 1, dtype=np.int64)
    again = np.unique(np.concatenate([a, b]))
    edge[again] += 1
    edge[again + window] -= 1
    return np.bincount(document[np.cumsum(edge)[:-1] > 0], minlength=n)


def counts_and_statistics(texts: pa.Array, window: int = 8, long_word: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The COUNTS (one row each) and the STATISTICS (one column each) of a batch of whole texts; null is empty."""
    buf, offsets = K.buffer_of(texts)
    n = len(texts)
    words = K.find_words(buf, offsets, K.SPACED, lower=False)
    n_words = words.counts
    numbers, dictionary = K.word_numbers(words, K.SPACED)
    document = words.document()
    starts = np.concatenate([[0], np.cumsum(LEADS[buf], dtype=np.int64)])
    sizes = starts[words.end] - starts[words.start]
    word_chars = np.bincount(document, sizes, n).astype(np.int64)
    lines, dup_lines = line_counts(buf, offsets)
    repeats = repeated_words(words, numbers, window)
    chars, symbols = np.diff(starts[offsets]), per_text(SYMBOLS[buf], offsets)
    vocabulary = max(len(dictionary), 1)
    pairs = np.sort(document * vocabulary + numbers)
    head = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    owner = pairs[head] // vocabulary
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, np.diff(np.append(head, len(pairs))))
    distinct = np.bincount(owner, minlength=n)
    some_words, some_chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    made = {
        "log_words": np.log1p(n_words),
        "mean_word_chars": word_chars / some_words,
        "symbols_per_char": symbols / some_chars,
        "dup_line_share": dup_lines / lines,
        "repeat_word_share": repeats / some_words,
        "distinct_word_share": distinct / some_words,
        "top_word_share": top / some_words,
        "digits_per_char": per_text(DIGITS[buf], offsets) / some_chars,
        "upper_per_char": per_text(UPPER[buf], offsets) / some_chars,
        "stops_per_word": per_text(STOPS[buf], offsets) / some_words,
        "punctuation_per_char": per_text(PUNCTUATION[buf], offsets) / some_chars,
        "words_per_line": n_words / lines,
        "long_word_share": np.bincount(document[sizes > long_word], minlength=n) / some_words,
    }
    return np.stack([n_words, word_chars, symbols, dup_lines, repeats]), np.stack([made[s] for s in STATISTICS], axis=1).astype(np.float64).reshape(n, len(STATISTICS))


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Summed leaf values of all trees for each row of statistics."""
        out = np.full(len(rows), self.base)
        step = max(1, (1 << 20) // max(len(self.roots), 1))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            node, each = np.tile(self.roots, (len(part), 1)), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[each, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[i : i + step] += self.value[node].sum(axis=1)
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, direction: np.ndarray, depth: int, ridge: float, least_rows: int, rate: float) -> dict[str, list]:
    """One tree over binned rows: breadth first, the split of greatest gain at every node that the directions allow."""
    n_features, width = binned.shape[1], max(len(c) for c in cuts) + 1
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    usable = np.arange(width - 1)[None, :] < np.array([len(c) for c in cuts])[:, None]

    def leaf(total: float, weight: float, low: float, high: float) -> int:
        at = len(nodes["value"])
        for name, value in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", rate * float(np.clip(-total / (weight + ridge), low, high)))):
            nodes[name].append(value)
        return at

    waiting = [(leaf(gradient.sum(), hessian.sum(), -np.inf, np.inf), np.arange(len(binned)), -np.inf, np.inf, 0)]
    while waiting:
        at, rows, low, high, level = waiting.pop(0)
        if level == depth or len(rows) < 2 * least_rows:
            continue
        flat = (binned[rows] + np.arange(n_features) * width).ravel()
        sums = [np.bincount(flat, np.repeat(w, n_features), n_features * width).reshape(n_features, width).cumsum(axis=1) for w in (gradient[rows], hessian[rows], np.ones(len(rows)))]
        (g, h, c), (all_g, all_h, all_c) = (s[:, :-1] for s in sums), (s[0, -1] for s in sums)
        to_left, to_right = np.clip(-g / (h + ridge), low, high), np.clip(-(all_g - g) / (all_h - h + ridge), low, high)
        worth = lambda w, g, h: -(g * w + 0.5 * (h + ridge) * w * w)
        own = float(np.clip(-all_g / (all_h + ridge), low, high))
        gain = worth(to_left, g, h) + worth(to_right, all_g - g, all_h - h) - worth(own, all_g, all_h)
        allowed = usable & (c >= least_rows) & (all_c - c >= least_rows) & (direction[:, None] * (to_right - to_left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        best = int(gain.argmax())
        feature, cut = divmod(best, width - 1)
        if gain.flat[best] <= 1e-6:
            continue
        goes_left = binned[rows, feature] <= cut
        middle, way = (to_left[feature, cut] + to_right[feature, cut]) / 2, direction[feature]
        bounds = ((low, min(high, middle) if way > 0 else high), (max(low, middle) if way > 0 else low, high)) if way >= 0 else ((max(low, middle), high), (low, min(high, middle)))
        nodes["feature"][at], nodes["threshold"][at] = feature, float(cuts[feature][cut])
        for side, mine, (lower, upper) in (("left", rows[goes_left], bounds[0]), ("right", rows[~goes_left], bounds[1])):
            child = leaf(gradient[mine].sum(), hessian[mine].sum(), lower, upper)
            nodes[side][at] = child
            waiting.append((child, mine, lower, upper, level + 1))
    return nodes


def fit_trees(rows: np.ndarray, labels: np.ndarray, direction: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_rows: int = 8) -> Trees:
    """Boosted trees of label 1 over rows of statistics; without rows, a model that says 0.5 of everything."""
    empty = np.zeros(0, dtype=np.int64)
    model = Trees(empty, np.zeros(0), empty, empty, np.zeros(0), empty, depth, 0.0)
    if not len(rows):
        return model
    cuts = [np.unique(np.quantile(rows[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(rows.shape[1])]
    cuts = [c[c < rows[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, rows[:, f]) for f, c in enumerate(cuts)], axis=1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    logit, grown = np.full(len(rows), model.base), []
    for _ in range(trees if any(len(c) for c in cuts) else 0):
        p = 1 / (1 + np.exp(-logit))
        nodes = grow(binned, cuts, p - labels, p * (1 - p), direction, depth, ridge, least_rows, rate)
        one = Trees(*(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value")), np.zeros(1, dtype=np.int64), depth, 0.0)
        logit += one.logits(rows)
        grown.append(one)
    if grown:
        first = np.cumsum([0, *(len(t.value) for t in grown)])
        joined = lambda name, shift=False: np.concatenate([getattr(t, name) + (first[i] if shift else 0) for i, t in enumerate(grown)])
        model = Trees(joined("feature"), joined("threshold"), joined("left", True), joined("right", True), joined("value"), first[:-1], depth, model.base)
    return model


def statistics_rows(df: DataFrame, keep: str, window: int, model: object = None) -> DataFrame:
    """Per row the columns before the text, which ``keep`` names with types, the counts, and statistics or a model's score."""
    carried = len(df.columns) - 1
    made = "stats array<double>" if model is None else "score double"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, carried):
            counts, rows = counts_and_statistics(batch.column(carried), window)
            last = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64())) if model is None else pa.array(model.value.scores(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(carried)), *(pa.array(c.astype(np.int64)) for c in counts), last], names=[*batch.schema.names[:carried], *COUNTS, "made"])

    return df.mapInArrow(compute, ", ".join([keep, *(f"{c} long" for c in COUNTS), made]))


def fit_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out_fold: int = 0, sample: int = 4000, window: int = 8, **options) -> Trees:
    """Trees of the statistics of at most ``sample`` labelled documents outside the held-out fold (crc32 of the id as text).

    The sample is the first by a hash of the id. Labels other than 0 and 1 and labels without a document are ignored; a
    document with two labels counts with both; of rows that share an id one is taken, the least by its statistics, so that
    no more than ``sample`` rows of numbers reach the driver.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    good = F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) != held_out_fold)
    present = marked.where(good).distinct().join(named.select("doc_id"), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "label").limit(sample)
    id_type = named.schema["doc_id"].dataType.simpleString()
    counted = statistics_rows(named.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), f"doc_id {id_type}, label int", window)
    found = counted.groupBy("doc_id", "label").agg(F.min("stats").alias("stats")).orderBy("doc_id", "label").collect()  # bounded by sample
    rows = np.array([r["stats"] for r in found], dtype=np.float64).reshape(len(found), len(STATISTICS))
    return fit_trees(rows, np.array([r["label"] for r in found], dtype=np.float64), np.array(list(STATISTICS.values())), **options)


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, least_words: int = 20, most_repeated: int = 30, window: int = 8, **options) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept per row.

    ``base_failed``: under ``least_words`` words, or more than ``most_repeated`` percent of them in windows of ``window``
    words that occur twice or more. ``kept``: not failed, and a score of ``threshold`` or more by trees that
    ``fit_quality_rules`` learns from the labels; without labels the score is 0.5. Null and empty texts have no words and
    fail. Null and repeated ids stay rows of their own; other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality_rules(docs, labels, id_col, text_col, window=window, **options))
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = statistics_rows(named, f"doc_id {named.schema['doc_id'].dataType.simpleString()}", window, model)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
