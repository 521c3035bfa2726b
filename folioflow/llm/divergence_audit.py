"""How far the sources of a language lie apart, by streaming over sorted runs.

A task takes a block of documents, numbers its words, sorts them by (language, term, source, document) and scans the sorted
numbers by run length: a run of one document counts it once, a run of (language, term, source) becomes one partial row of
documents and occurrences. Partial rows are dealt by (language, term, source), sorted, and scanned again in a stream that
holds one run at a time, so a term that every document has is one row a block before it moves. A term's document frequency
is the sum over its sources; terms of too few documents go here.

For the pairs of sources, the kept rows are dealt by language, pair of blocks of sources and share of the terms, and sorted by
term. A task scans them term by term: a run is one term's counts over the sources of both blocks, which it sets into two rows
of probabilities, and adds the terms' divergences to the sums of all pairs of the two blocks. Its memory is that of two blocks
of sources, whatever the number of terms. What no source of the two blocks holds is added at the end in one product. All
arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import pieces, shuffle_partitions, stored

#: Bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
LETTERS = K.byte_class(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
PARTS = 1_000_000_000
COUNTED = "lang string, source string, term string, docs long, count long"


def block_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted partial rows of a block of (lang, source, text): documents and occurrences of every (lang, term, source)."""
    words = K.words_of(batch.column(2), LETTERS, lower=True)
    terms, names = K.word_numbers(words, LETTERS)
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    document = words.document()
    key = (lang.indices.to_numpy().astype(np.int64)[document] * len(names) + terms) * len(source.dictionary) + source.indices.to_numpy().astype(np.int64)[document]
    order = np.argsort(key, kind="stable")  # documents stay in their order within a run
    key, document = key[order], document[order]
    new_run = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    new_document = new_run | np.concatenate([[True], document[1:] != document[:-1]])[: len(key)]
    head = np.flatnonzero(new_run)
    docs = np.add.reduceat(new_document, head, dtype=np.int64) if len(head) else head
    rest, own_source = np.divmod(key[head], len(source.dictionary))
    own_lang, own_term = np.divmod(rest, max(len(names), 1))
    term = names.take(pa.array(own_term)).cast(pa.large_string()).cast(pa.string())
    columns = [lang.dictionary.take(pa.array(own_lang)), source.dictionary.take(pa.array(own_source)), term, pa.array(docs), pa.array(np.diff(np.append(head, len(key))))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "count"])


def starts_of_runs(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where the values of the key columns change from one row to the next, the first row included."""
    change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for key in keys:
        column = table[key].combine_chunks()
        change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return np.concatenate([[0], np.flatnonzero(change) + 1]) if table.num_rows else np.zeros(0, np.int64)


def merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of docs and count over the runs of sorted rows; the last run of a batch waits for the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        head = starts_of_runs(table, ("lang", "term", "source"))
        if not len(head):
            continue
        sums = table.take(pa.array(head))
        for name in ("docs", "count"):
            sums = sums.set_column(sums.schema.get_field_index(name), name, pa.array(np.add.reduceat(table[name].to_numpy(), head)))
        held = sums.slice(len(head) - 1)
        yield from sums.slice(0, len(head) - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def kept_terms(docs: DataFrame, least_docs: int, block_bytes: int = 4 << 20) -> DataFrame:
    """lang, term, source, count, total (over the language) and head (one row of each term) for the terms that are kept."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, block_bytes):
            yield block_runs(batch)

    keys = ("lang", "term", "source")
    sorted_runs = docs.mapInArrow(count, COUNTED).repartition(shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    term = Window.partitionBy("lang", "term")
    each = sorted_runs.mapInArrow(merged_runs, COUNTED).withColumns({"frequency": F.sum("docs").over(term), "total": F.sum("count").over(term), "head": (F.row_number().over(term.orderBy("source")) == 1).cast("int")})
    return each.where(F.col("frequency") >= least_docs).select(*keys, "count", "total", "head")


def parts_of(count: Column, among: Column) -> Column:
    """1 + floor(PARTS (count + 2) / among), digit by digit in thousands, so that nothing overflows below 9e15."""
    share, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        share, rest = share * 1000 + whole(rest * 1000, among), (rest * 1000) % among
    return share + 1


def whole(a: Column, b: Column) -> Column:
    """Integer quotient of two non-negative longs."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return whole((p - q) * (p - q), p + q)


def parts_array(count: np.ndarray, among: np.ndarray) -> np.ndarray:
    """``parts_of`` in numpy."""
    share, rest = np.zeros_like(count), count + 2
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, among)
        share = share * 1000 + more
    return share + 1


class PairSums:
    """Sums over terms of the divergences between the sources of two blocks (or within one)."""

    def __init__(self, left: pa.Table, right: pa.Table, same: bool):
        self.left, self.right, self.same = left, right, same
        self.among = [t["among"].to_numpy() for t in (left, right)]
        self.first = [int(t["place"][0].as_py()) if t.num_rows else 0 for t in (left, right)]
        self.rest = [parts_array(np.zeros(len(a), np.int64), a) for a in self.among]
        self.sums, self.seen = np.zeros((left.num_rows, right.num_rows), dtype=np.int64), 0

    def add(self, term: np.ndarray, n_terms: int, side: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
        """Counts of ``n_terms`` terms, numbered in ``term``, at the places of sources of a side."""
        step = max(1, (1 << 18) // max(self.sums.shape[1], 1))
        for lo in range(0, n_terms, step):
            here = slice(*np.searchsorted(term, [lo, lo + step]))
            rows = []
            for which in (0, 1):
                parts = np.tile(self.rest[which], (min(step, n_terms - lo), 1))
                mine = side[here] == which
                at = place[here][mine] - self.first[which]
                parts[term[here][mine] - lo, at] = parts_array(count[here][mine], self.among[which][at])
                rows.append(parts)
            if self.same:
                rows[1] = rows[0]
            for i in range(len(self.sums)):
                j = i + 1 if self.same else 0
                p, q = rows[0][:, i : i + 1], rows[1][:, j:]
                apart = (p - q).astype(np.int64)
                self.sums[i, j:] += ((apart * apart).astype(np.uint64) // (p + q).astype(np.uint64)).sum(axis=0).astype(np.int64)
        self.seen += n_terms

    def rows(self, lang: str) -> pa.RecordBatch:
        i, j = np.nonzero(np.triu(np.ones(self.sums.shape, dtype=bool), 1) if self.same else np.ones(self.sums.shape, dtype=bool))
        right = self.left if self.same else self.right
        columns = {"lang": pa.array([lang] * len(i), pa.string())}
        for name, table, at in (("a", self.left, i), ("b", right, j)):
            columns[name] = table["source"].combine_chunks().take(pa.array(at))
            columns[f"among_{name}"] = table["among"].combine_chunks().take(pa.array(at))
        columns |= {"value": pa.array(self.sums[i, j]), "seen": pa.array(np.full(len(i), self.seen, dtype=np.int64))}
        return pa.RecordBatch.from_pydict(columns)


PAIRS = "lang string, a string, among_a long, b string, among_b long, value long, seen long"
TASK = ("lang", "left", "right", "share")


def pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial pair sums of every (lang, left block, right block, share): its sources come first, then terms in order."""
    key, sources, sums, held = None, [], None, None

    def opened() -> PairSums:
        table = pa.concat_tables(sources).sort_by([("side", "ascending"), ("place", "ascending")])
        left, right = (table.filter(pc.equal(table["side"], side)).combine_chunks() for side in (0, 1))
        same = key[1] == key[2]
        return PairSums(left, left if same else right, same)

    def closed() -> Iterator[pa.RecordBatch]:
        done = sums or opened()
        if held is not None:
            add(done, held)
        yield done.rows(key[0])

    def add(to: PairSums, rows: pa.Table) -> None:
        head = starts_of_runs(rows, ("term",))
        number = np.repeat(np.arange(len(head)), np.diff(np.append(head, rows.num_rows)))
        to.add(number, len(head), rows["side"].to_numpy(), rows["place"].to_numpy(), rows["count"].to_numpy())

    for batch in batches:
        table = pa.Table.from_batches([batch])
        cuts = [*starts_of_runs(table, TASK).tolist(), table.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = table.slice(lo, hi - lo)
            now = tuple(part[k][0].as_py() for k in TASK)
            if now != key:
                if key is not None:
                    yield from closed()
                key, sources, sums, held = now, [], None, None
            named = pc.is_null(part["term"])
            if pc.any(named).as_py():
                sources.append(part.filter(named).combine_chunks())
                part = part.filter(pc.invert(named)).combine_chunks()
            if not part.num_rows:
                continue
            sums = sums or opened()
            part = part if held is None else pa.concat_tables([held, part])
            last = int(starts_of_runs(part, ("term",))[-1])
            if last:
                add(sums, part.slice(0, last))
            held = part.slice(last).combine_chunks()
    if key is not None:
        yield from closed()


def pair_values(kept: DataFrame, groups: DataFrame, block: int, evaluations: int) -> DataFrame:
    """lang, source, other source, value for both orders of all pairs of a language's sources."""
    n = F.col("n_sources")
    blocks = F.ceil(n / block).cast("int")
    shares = F.greatest(F.lit(16), F.ceil(F.col("terms") * F.pow(F.least(n, F.lit(block)), F.lit(2)) / evaluations)).cast("int")
    placed = groups.withColumns({"place": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "blocks": blocks, "shares": shares})
    mine = F.floor(F.col("place") / block).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A block meets every block: as the left one where it comes first. Within itself it is the left one alone.
    meets = F.transform(every, lambda other: F.struct(F.least(mine, other).alias("left"), F.greatest(mine, other).alias("right"), F.when(mine <= other, 0).otherwise(1).alias("side")))
    placed = placed.withColumn("meets", meets)
    out = ("left", "right", "share", "side", "place", "source", "term", "among", "count")
    empty = {"term": F.lit(None).cast("string"), "count": F.lit(0).cast("long")}
    heads = placed.withColumns(empty).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    counted = kept.select("lang", "source", "term", "count").join(placed, ["lang", "source"]).withColumn("share", F.pmod(F.xxhash64("term"), F.col("shares")).cast("int"))
    rows = [x.withColumn("meet", F.explode("meets")).withColumns({k: F.col(f"meet.{k}") for k in ("left", "right", "side")}).select("lang", *out) for x in (heads, counted)]
    dealt = rows[0].unionByName(rows[1]).repartition(shuffle_partitions(kept.sparkSession), *TASK)
    partial = dealt.sortWithinPartitions(*TASK, F.col("term").asc_nulls_first(), "side", "place").mapInArrow(pair_runs, PAIRS)
    summed = partial.groupBy("lang", "a", "among_a", "b", "among_b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).join(groups.select("lang", "terms").distinct(), "lang")
    none = F.lit(0).cast("long")
    value = F.col("value") + (F.col("terms") - F.col("seen")) * divergence(parts_of(none, F.col("among_a")), parts_of(none, F.col("among_b")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", value.alias("value"), both.alias("pair")).select("lang", "pair.source", "pair.item", "value")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top_terms: int = 10, block: int = 256, evaluations: int = 1 << 28) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of every (lang, source) group from the others and its terms.

    Terms are maximal runs of characters from A-Z, a-z and above U+007F, A-Z lower-cased; a language's kept terms are those of
    at least ``least_docs`` of its documents. A group has p = 1 + floor(1e9 (count + 2) / (N + 2 V)) for every kept term, with
    N its occurrences of kept terms and V their number; a language has the like over all its sources. Part ``pair``: for every
    other source of the language the sum over kept terms of floor((p - q)^2 / (p + q)), ranked by value and name. Part
    ``term``: the ``top_terms`` terms that the group has, with p above the language's, by the same measure.

    Null text, language and source read as ''. Every row is a document: rows that share an id, or are equal, count each, and
    ids are not read. A group without terms has all pairs and no terms; a language of one source has no pairs. Extra columns
    are ignored; an empty table gives no rows. Values are exact while a group has fewer than 9e15 occurrences.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    named = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    kept = stored(kept_terms(named, least_docs), "kept-terms")
    counts = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    totals = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("count").alias("all"))
    present = named.select("lang", "source").distinct().join(counts, ["lang", "source"], "left")
    width = present.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(totals, "lang", "left").na.fill(0)
    # Without any kept term nothing is divided by N + 2 V; 2 stands in so that no quotient fails.
    among = lambda n: F.greatest(F.col(n) + 2 * F.col("terms"), F.lit(2).cast("long"))
    groups = present.na.fill(0, ["n"]).join(width, "lang").select("lang", "source", "n_sources", "terms", among("n").alias("among"), among("all").alias("among_all"))
    groups = stored(groups, "source-groups")
    pairs = pair_values(kept, groups, block, evaluations)
    p, q = parts_of(F.col("count"), F.col("among")), parts_of(F.col("total"), F.col("among_all"))
    terms = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [x.withColumn("part", F.lit(part)).withColumn("rank", ranked) for part, x in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1].where(F.col("rank") <= top_terms)).select("lang", "source", "part", "item", "value", "rank")
