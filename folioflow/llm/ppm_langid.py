"""Language identification by partial matching.

For every language a tree of byte contexts up to ``order`` bytes long is counted on training text and then frozen.
A byte costs -log2 of its probability in the longest context the tree knows; a byte that this context has not seen
costs the context's escape probability (distinct followers / (count + distinct followers)) and goes on to the next
shorter context, at last to a uniform choice of 256. Symbols are all 256 byte values and the start of a text. A text's
score in a language is its exact code length in bits.

Whole training texts are counted in Spark tasks, and every language's ``most_pairs`` most frequent (context, byte) pairs make
its tree; a pair's shorter one is at least as frequent and comes first at a tie, so that trees stay trees. The driver gets no
more than these pairs, of at most ``most_languages`` languages. Frozen trees make every cost a fixed number, so all trees are compiled into sparse tables: by (context, byte) that any tree has seen the code
length in every language, by context the escapes. Nearly every byte of a text is one look-up in the longest contexts' table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import crc32_of_id, pieces
from folioflow.llm.textkernels import buffer_of

#: Symbol 0 is the start of a text, symbol b + 1 the byte b.
BASE = 257
UNIFORM_BITS = 8.0


class Rows:
    """Row numbers of some distinct keys: open addressing in numpy, for look-ups of many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(3 * len(keys)).bit_length())
        self.key, self.row = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        place, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.key[place[left]] < 0
            _, first = np.unique(place[left[free]], return_index=True)
            won = left[free][first]
            self.key[place[won]], self.row[place[won]] = keys[won], won
            left = left[self.key[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    @property
    def nbytes(self) -> int:
        return self.key.nbytes + self.row.nbytes

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        place = self.home(keys)
        held = self.key[place]
        out = np.where(held == keys, self.row[place], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            held = self.key[place[left]]
            same = held == keys[left]
            out[left[same]] = self.row[place[left[same]]]
            left = left[~same & (held >= 0)]
        return out


@dataclass
class Model:
    """Compiled trees: by context length the rows and bits of (context, byte) pairs, and the rows and escapes of contexts."""

    languages: list[str]
    pairs: list[tuple[Rows, np.ndarray]]
    contexts: list[tuple[Rows, np.ndarray]]

    @property
    def order(self) -> int:
        return len(self.pairs) - 1

    @property
    def nbytes(self) -> int:
        return sum(rows.nbytes + bits.nbytes for rows, bits in [*self.pairs, *self.contexts])


def padded_symbols(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``order`` start symbols before every text, and the places of the bytes among them."""
    place = np.arange(len(buf)) + order * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out = np.zeros(len(buf) + order * (len(offsets) - 1), dtype=np.uint16)
    out[place] = buf
    out[place] += 1
    return out, place


def codes_at(symbols: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` symbols that end at each place as one number."""
    code = np.zeros(len(place), dtype=np.int64)
    for back in range(length - 1, -1, -1):
        code = code * BASE + symbols[place - back]
    return code


def count_pairs(texts: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For context lengths 0 to order: the distinct (context, byte) codes of some texts and their counts."""
    symbols, place = padded_symbols(*buffer_of(texts), order)
    for k in range(order + 1):
        code, n = np.unique(codes_at(symbols, place, k + 1), return_counts=True)
        yield k, code, n


def compiled(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """The model of every language's counted codes by context length."""
    languages = sorted(counts)
    orders = max((len(x) for x in counts.values()), default=0)
    pairs, contexts, shorter = [], [], None
    for k in range(orders):
        every = np.unique(np.concatenate([counts[lang][k][0] for lang in languages]))
        above = np.unique(every // BASE)
        bits = np.full((len(every), len(languages)), UNIFORM_BITS, dtype=np.float32)
        if shorter is not None:
            bits[:] = shorter[1][shorter[0].find(every % BASE**k)]  # a pair's shorter one was seen with it
        escapes = np.zeros((len(above), len(languages)), dtype=np.float32)
        for j, lang in enumerate(languages):
            code, n = counts[lang][k]
            mine, context = np.unique(code // BASE, return_inverse=True)
            distinct, total = np.bincount(context, minlength=len(mine)), np.bincount(context, n, len(mine))
            escapes[np.searchsorted(above, mine), j] = -np.log2(distinct / (total + distinct))
            bits[:, j] += escapes[np.searchsorted(above, every // BASE), j]
            bits[np.searchsorted(every, code), j] = -np.log2(n / (total + distinct)[context])
        shorter = (Rows(every), bits)
        pairs.append(shorter)
        contexts.append((Rows(above), escapes))
    return Model(languages, pairs, contexts)


def code_lengths(texts: pa.Array, model: Model, step: int = 1 << 18) -> np.ndarray:
    """Exact code length in bits of each text in each language; a long text is summed over several steps."""
    buf, offsets = buffer_of(texts)
    out = np.zeros((len(texts), len(model.languages)))
    if not model.pairs:
        return out
    symbols, place = padded_symbols(buf, offsets, model.order)
    for lo in range(0, len(buf), step):
        here = place[lo : lo + step]
        cost = np.zeros((len(here), len(model.languages)), dtype=np.float32)
        left = np.arange(len(here))
        for k in range(model.order, -1, -1):
            code = codes_at(symbols, here[left], k + 1)
            rows, bits = model.pairs[k]
            row = rows.find(code)
            hit = row >= 0
            cost[left[hit]] += bits[row[hit]]
            left, code = left[~hit], code[~hit]
            if not len(left):
                break
            rows, escapes = model.contexts[k]
            row = rows.find(code // BASE)
            cost[left[row >= 0]] += escapes[row[row >= 0]]
        cost[left] += UNIFORM_BITS
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        cuts = np.clip(offsets - lo, 0, len(here))
        out += sums[cuts[1:]] - sums[cuts[:-1]]
    return out


def training_rows(docs: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows of each language, spread over all rows by a hash of id and text.

    More than ``most_languages`` languages are an error, as that column then names something else.
    """
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return docs.select("lang", "text")
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * (per_language + 20) / n)))])
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    some = docs.where(bucket < F.element_at(share, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit(7)), "doc_id", "text"))
    return some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")


def train(rows: DataFrame, order: int, most_pairs: int) -> Model:
    """Count the trees of (lang, text) rows in tasks, keep the most frequent pairs of each language, and compile them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for lang in batch.column(0).unique().to_pylist():
                mine = pc.equal(batch.column(0), lang)
                for k, code, n in count_pairs(batch.column(1).filter(mine), order):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n, pa.int64())], names=["lang", "k", "code", "n"])

    summed = rows.mapInArrow(count, "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "k", "code"))
    total = summed.withColumn("rank", rank).where(F.col("rank") <= most_pairs).drop("rank").toArrow()  # bounded by both limits
    names, which = np.unique(np.array(total["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True) if len(total) else (np.array([]), np.array([]))
    k, code, n = (total[c].to_numpy() for c in ("k", "code", "n"))
    counts = {}
    for j, lang in enumerate(names.tolist()):
        tables = []
        for length in range(order + 1):
            mine = np.flatnonzero((which == j) & (k == length))
            mine = mine[np.argsort(code[mine], kind="stable")]
            tables.append((code[mine], n[mine]))
        if len(tables[0][0]):
            counts[lang] = tables
    return compiled(counts)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out_fold: int = 2, order: int = 3, per_language: int = 400, most_pairs: int = 1 << 17, most_languages: int = 256, with_bits: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and ``with_bits`` bits, the code length in each language.

    The model is fitted on the whole texts of at most ``per_language`` rows of each language whose crc32(id as text) mod
    ``folds`` is not ``held_out_fold`` and whose language, id and text are not null; every whole text is scored. A language's
    tree has at most ``most_pairs`` (context, byte) pairs; over ``most_languages`` languages are an error. lang_pred is
    the language of least code length, ties to the first by name, and score the posterior probability of that language
    when code lengths are read as -log2 probabilities. Texts that are null or hold no letter, and all texts when nothing
    could be learned, get ``und`` with score 0. held_out is false for a null id; rows that share an id are scored each.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    held_out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) == held_out_fold, F.lit(False))
    known = named.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    held = spark.sparkContext.broadcast(train(training_rows(known, per_language, most_languages), order, most_pairs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.languages, "und"], dtype=object)
        n = len(names) - 1
        kinds = pa.list_(pa.struct([("lang", pa.string()), ("bits", pa.float64())]))
        for batch in pieces(batches, 2):
            bits = code_lengths(batch.column(2), held.value)
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) & (n > 0)
            best = bits.argmin(axis=1) if n else np.zeros(len(bits), np.int64)
            gap = bits - bits.min(axis=1, keepdims=True) if n else bits
            score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1) if n else np.zeros(len(bits))
            columns = [batch.column(0), batch.column(1), pa.array(names[np.where(letters, best, n)], pa.string()), pa.array(np.where(letters, score, 0.0))]
            if with_bits:
                columns.append(pa.array([[{"lang": names[j], "bits": float(b)} for j, b in enumerate(row)] for row in bits], kinds))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "bits"][: len(columns)])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    id_type = named.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {id_type}, held_out boolean, lang_pred string, score double" + ", bits array<struct<lang:string,bits:double>>" * with_bits
    return named.select("doc_id", held_out.alias("held_out"), "text", letter.alias("letter")).mapInArrow(predict, made)
