"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item gives windows of ``window`` consecutive words (an item of fewer words is one window). A window's
shingles are ordered by rarity: their document frequencies are counted over the whole corpus first. A document holds a
window only if it holds all of its shingles, so the necessary prefix for exact containment is the single rarest one.
Documents meet windows on that shingle alone; the shingle's place in the window bounds where the window must start and
end in the document, and candidates that fit are verified word by word over the item-sized span.

A benchmark of at most ``broadcast_bytes`` of text is broadcast as arrays of word codes, and documents are never shuffled.
A larger one stays in Spark: shingles, frequencies and prefixes are tables, a bit table of bounded size picks the places of
the documents that can matter, and these, with the words around them, meet the windows in a shuffle join. Results there
belong to texts, by their SHA-256, and so to rows whatever ids they have. Either way the corpus is read once for the
frequencies and once for the hits; the join also reads it to hand results to rows. Words are compared as 64-bit codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import pieces, stored, text_bytes

FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
LANE = K.LANES[0]


class Lookup:
    """Places of values in a sorted array, behind a bit table that rejects most values in one step."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.hint = np.zeros(1 << self.BITS, dtype=bool)
        self.hint[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of values that are keys, and the keys' indices."""
        at = np.flatnonzero(self.hint[(values >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        good = self.keys[key] == values[at]
        return at[good], key[good]


@dataclass
class Windows:
    """Distinct windows of some items, by where they stand in the items' word codes.

    Items of window w are names[owner[owned[w]:owned[w + 1]]]. By shingle width, prefix has the windows' rarest shingles and
    (shingle, window, place of the shingle in it) sorted by shingle.
    """

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owned: np.ndarray
    owner: np.ndarray
    names: list[str]
    prefix: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def shingles(codes: np.ndarray, width: int, lane: K.Lane = LANE) -> np.ndarray:
    """Codes of every run of ``width`` word codes, over document borders too: verification sorts those out."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers, out = lane.powers(lane.window_base, width), np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out += codes[j : j + n] * powers[j]
    return K.mix(out)


def window_places(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word and size of every window; first has the items' first words and the end."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
    item = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count - first[:-1], count)
    return item, start, np.minimum(n, window)[item]


def windows_of(names: list[str], texts: list[str | None], window: int) -> Windows:
    words = K.words_of(pa.array(texts, pa.string()), K.ALNUM, lower=True)
    codes = words.codes(LANE)
    item, start, size = window_places(words.first, window)
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for n in np.unique(size).tolist():  # equal windows by two codes
        rows = size == n
        one[rows], two[rows] = (shingles(codes, n, lane)[start[rows]] for lane in K.LANES)
    order = np.lexsort((item, two, one, size))
    one, two, size, item = one[order], two[order], size[order], item[order]
    new = np.concatenate([[True], (np.diff(one) != 0) | (np.diff(two) != 0) | (np.diff(size) != 0)])[: len(order)]
    which = np.cumsum(new) - 1
    pair = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(item) != 0)])[: len(order)]
    owned = np.concatenate([[0], np.cumsum(np.bincount(which[pair], minlength=int(new.sum())))]).astype(np.int64)
    return Windows(codes, start[order][new], size[new], owned, item[pair], names)


def shingle_places(windows: Windows, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By window size: the width, the windows, and a row for each with the first words of its shingles."""
    for n in np.unique(windows.size).tolist():
        rows, width = np.flatnonzero(windows.size == n), min(n, shingle)
        yield width, rows, windows.start[rows][:, None] + np.arange(n - width + 1)


def all_shingles(windows: Windows, shingle: int) -> dict[int, Lookup]:
    """By width, the distinct shingles of all windows of that width."""
    found: dict[int, list[np.ndarray]] = {}
    for width, _, places in shingle_places(windows, shingle):
        found.setdefault(width, []).append(np.unique(shingles(windows.codes, width)[places]))
    return {width: Lookup(np.unique(np.concatenate(x))) for width, x in found.items()}


def choose_prefixes(windows: Windows, shingle: int, keys: dict[int, Lookup], frequency: dict[int, np.ndarray]) -> None:
    """Give every window its rarest shingle, ties to the first."""
    chosen: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for width, rows, places in shingle_places(windows, shingle):
        own = shingles(windows.codes, width)[places]
        place = frequency[width][np.searchsorted(keys[width].keys, own)].argmin(axis=1)
        chosen.setdefault(width, []).append((own[np.arange(len(own)), place], rows, place))
    for width, parts in chosen.items():
        code, rows, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(code, kind="stable")
        windows.prefix[width] = (Lookup(np.unique(code)), code[order], rows[order], place[order])


def held_shingles(texts: pa.Array, keys: dict[int, Lookup]) -> Iterator[tuple[int, np.ndarray]]:
    """By width, a key's index once for every text of a batch that holds it."""
    words = K.words_of(texts, K.ALNUM, lower=True)
    codes = words.codes(LANE)
    for width, lookup in keys.items():
        at, key = lookup.find(shingles(codes, width))
        d = np.searchsorted(words.first, at, side="right") - 1
        inside = at + width <= words.first[d + 1]
        if inside.any():
            yield width, np.unique(np.stack([d[inside], key[inside]], 1), axis=0)[:, 1]


def count_frequencies(docs: DataFrame, keys: dict[int, Lookup]) -> dict[int, np.ndarray]:
    """Documents that hold each shingle, over the whole corpus; a broadcast benchmark's shingles bound what comes back."""
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {width: np.zeros(len(x.keys), dtype=np.int64) for width, x in held.value.items()}
        for batch in pieces(batches, 0):
            for width, key in held_shingles(batch.column(0), held.value):
                np.add.at(total[width], key, 1)
        for width, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([width] * len(k), pa.int32()), pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], names=["width", "key", "n"])

    counted = docs.select("text").mapInArrow(count, "width int, key long, n long").groupBy("width", "key").agg(F.sum("n").alias("n")).toArrow()
    width, key, n = (counted[c].to_numpy() for c in ("width", "key", "n"))
    out = {g: np.zeros(len(x.keys), dtype=np.int64) for g, x in keys.items()}
    for g in out:
        out[g][key[width == g]] = n[width == g]
    return out


def hits_of(texts: pa.Array, windows: Windows) -> tuple[np.ndarray, list[list], list[list]]:
    """Per text of a batch: words, merged spans of words inside occurring windows, and the items that occur."""
    words = K.words_of(texts, K.ALNUM, lower=True)
    codes, first = words.codes(LANE), words.first
    starts, found = [], []
    for width, (lookup, prefix, window, place) in windows.prefix.items():
        at, key = lookup.find(shingles(codes, width))
        lo, hi = np.searchsorted(prefix, lookup.keys[key]), np.searchsorted(prefix, lookup.keys[key], side="right")
        n = hi - lo
        row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
        at, w = np.repeat(at, n), window[row]
        start, d = at - place[row], np.searchsorted(first, at, side="right") - 1
        fits = (start >= first[d]) & (start + windows.size[w] <= first[d + 1])
        start, w = start[fits], w[fits]
        for j in range(int(windows.size[w].max(initial=0))):
            reach = np.flatnonzero(windows.size[w] > j)
            good = np.ones(len(w), dtype=bool)
            good[reach] = codes[start[reach] + j] == windows.codes[windows.start[w[reach]] + j]
            start, w = start[good], w[good]
        starts.append(start)
        found.append(w)
    start, w = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (starts, found))
    order = np.argsort(start, kind="stable")
    start, w = start[order], w[order]
    end, d = start + windows.size[w], np.searchsorted(first, start, side="right") - 1
    spans: list[list] = [[] for _ in range(len(texts))]
    items: list[set] = [set() for _ in range(len(texts))]
    for doc, s, e, one in zip(d.tolist(), (start - first[d]).tolist(), (end - first[d]).tolist(), w.tolist()):
        mine = spans[doc]
        if mine and s <= mine[-1]["end"]:
            mine[-1]["end"] = max(mine[-1]["end"], e)
        else:
            mine.append({"start": s, "end": e})
        items[doc].update(windows.names[i] for i in windows.owner[windows.owned[one] : windows.owned[one + 1]].tolist())
    return words.counts, spans, [sorted(x) for x in items]


def broadcast_windows(corpus: DataFrame, items: DataFrame, window: int, shingle: int):
    """The windows of a small benchmark with their prefixes chosen, on every executor."""
    rows = items.collect()  # bounded by broadcast_bytes
    windows = windows_of([r["item"] for r in rows], [r["text"] for r in rows], window)
    keys = all_shingles(windows, shingle)
    if keys:
        choose_prefixes(windows, shingle, keys, count_frequencies(corpus, keys))
    return corpus.sparkSession.sparkContext.broadcast(windows)


def bit_table(codes: DataFrame, column: str, most_bits: int = 28) -> tuple[int, np.ndarray]:
    """log2 of a table's size, and the table: a bit for the leading bits of every code; at most 32 MB."""
    bits = int(np.clip(int(8 * codes.count()).bit_length(), 16, most_bits))
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = codes.groupBy(F.shiftrightunsigned(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    table = np.zeros(1 << bits, dtype=bool)
    for r in rows:
        table[r["block"] << 15 : r["block"] + 1 << 15] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return bits, np.packbits(table)


def matched_texts(corpus: DataFrame, items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(text_id, start, end, window) for every window in every different text, and (window, item): by shuffle joins."""
    context = corpus.sparkSession.sparkContext

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words = K.words_of(batch.column(1), K.ALNUM, lower=True)
            codes = words.codes(LANE)
            item, start, size = window_places(words.first, window)
            made = [codes[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(0).take(pa.array(item))], names=["window", "item"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, widths, places, found = [], [], [], []
            for name in batch.column(0).to_pylist():
                codes = np.frombuffer(name, np.uint64)
                width = min(len(codes), shingle)
                own = shingles(codes, width).view(np.int64)
                names += [name] * len(own)
                widths += [width] * len(own)
                places += range(len(own))
                found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(widths, pa.int32()), pa.array(places, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["window", "width", "place", "shingle"])

    members = stored(items.mapInArrow(cut, "window binary, item string").distinct(), "windows")
    spelled = stored(members.select("window").distinct().mapInArrow(spell, "window binary, width int, place int, shingle long"), "spelled")
    widths = sorted(r["width"] for r in spelled.select("width").distinct().collect())  # at most ``shingle`` of them
    bits, table = bit_table(spelled, "shingle")
    held = context.broadcast(table)

    def passing(codes: np.ndarray, width: int, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = shingles(codes, width)
        place = (own >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(table[place >> 3] >> (7 - (place & 7)) & 1)
        return at, own[at]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0, 8 << 20):
            words = K.words_of(batch.column(0), K.ALNUM, lower=True)
            codes = words.codes(LANE)
            for width in widths:
                at, own = passing(codes, width, bits, held.value)
                d = np.searchsorted(words.first, at, side="right") - 1
                inside = at + width <= words.first[d + 1]
                order = np.lexsort((d[inside], own[inside]))
                own, d = own[inside][order], d[inside][order]
                once = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(d) != 0)])[: len(own)]
                code, n = np.unique(own[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), width), pa.int32()), pa.array(code.view(np.int64)), pa.array(n, pa.int64())], names=["width", "shingle", "n"])

    frequency = corpus.select("text").mapInArrow(count, "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle", "width")).alias("p")
    prefix = stored(spelled.join(frequency, ["width", "shingle"], "left").groupBy("window").agg(rarest).select("window", "p.place", "p.shingle", "p.width", F.expr("octet_length(window) div 8").cast("int").alias("size")), "prefixes")
    few_bits, few = bit_table(prefix, "shingle")
    needed = context.broadcast(few)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words = K.words_of(batch.column(1), K.ALNUM, lower=True)
            codes, first = words.codes(LANE), words.first
            for width in widths:
                at, own = passing(codes, width, few_bits, needed.value)
                d = np.searchsorted(first, at, side="right") - 1
                inside = at + width <= first[d + 1]
                at, own, d = at[inside], own[inside], d[inside]
                lo, hi = np.maximum(at - window, first[d]), np.minimum(at + window, first[d + 1])
                around = [codes[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(np.full(len(at), width), pa.int32()), pa.array(own.view(np.int64)), pa.array(at - first[d], pa.int64()), pa.array(at - lo, pa.int32()), pa.array(around, pa.binary())], names=["text_id", "width", "shingle", "at", "before", "around"])

    texts = corpus.where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_id"), "text")
    candidates = texts.mapInArrow(meet, "text_id string, width int, shingle long, at long, before int, around binary").dropDuplicates(["text_id", "width", "at"])
    same = F.substring(F.col("around"), (F.col("before") - F.col("place")) * 8 + 1, F.col("size") * 8) == F.col("window")
    met = candidates.join(prefix, ["width", "shingle"]).where((F.col("before") >= F.col("place")) & same)
    start = F.col("at") - F.col("place")
    return stored(met.select("text_id", start.alias("start"), (start + F.col("size")).alias("end"), "window"), "matched"), members


def items_of(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text_col}`").alias("text"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """One row per document row: doc_id, n_words, spans (word ranges inside occurring windows), items (ids as strings, sorted).

    A-Z are lower-cased; words are runs of 0-9, a-z and all non-ASCII characters. Null or empty texts have no words and no
    hits; items without words have no windows; items with equal windows are all named. Null item ids read "null". Rows that
    share a document id, or have none, are separate rows whatever the benchmark's size. Other columns are ignored; an empty
    benchmark leaves every document clean, an empty corpus gives no rows.
    """
    corpus = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = items_of(benchmark, item_col, item_text_col)
    if text_bytes(items, "text") > broadcast_bytes:
        return joined_contamination(corpus, items, window, shingle)
    held = broadcast_windows(corpus, items, window, shingle)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n_words, spans, names = hits_of(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return corpus.mapInArrow(find, FOUND)


def joined_contamination(corpus: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``find_contamination`` by shuffle joins: hits of different texts, handed to the rows that have them."""
    matched, members = matched_texts(corpus, items, window, shingle)
    by_start = Window.partitionBy("text_id").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = matched.select("text_id", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    merged = islands.withColumn("island", F.sum("new").over(by_start)).groupBy("text_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = matched.select("text_id", "window").distinct().join(members, "window").select("text_id", "item").distinct()
    names = named.groupBy("text_id").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n = K.words_of(batch.column(1), K.ALNUM, lower=True).counts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["doc_id", "n_words", "text_id"])

    rows = corpus.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_id")).mapInArrow(count, "doc_id long, n_words long, text_id string")
    none = F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>")
    return rows.join(spans, "text_id", "left").join(names, "text_id", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def contamination_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of each document's hits."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def clean_text(held, text: Column) -> Column:
    """Whether whole texts hold none of the broadcast windows."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for part in pieces([pa.RecordBatch.from_arrays([texts], names=["text"])], 0):
            out += [not x for x in hits_of(part.column(0), held.value)[1]]
        return pa.array(out, pa.bool_())

    return clean(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """The documents without any benchmark window, all their columns as they were.

    With a broadcast benchmark no row is shuffled; else rows meet the hit texts by a digest of theirs.
    """
    text = F.col(f"`{text_col}`")
    corpus, items = docs.select(F.lit(0).cast("long").alias("doc_id"), text.alias("text")), items_of(benchmark, item_col, item_text_col)
    if text_bytes(items, "text") <= broadcast_bytes:
        return docs.where(clean_text(broadcast_windows(corpus, items, window, shingle), text))
    gone = matched_texts(corpus, items, window, shingle)[0].select(F.col("text_id").alias("__text_id")).distinct()
    return docs.join(gone, F.sha2(text.cast("binary"), 256) == F.col("__text_id"), "left_anti")
