"""Near-duplicate detection by b-bit MinHash.

Every text becomes its set of distinct word shingles and ``bands * rows`` minima. Bands of minima give candidates; the low
``bits`` bits of all minima, packed, give each candidate pair a collision-corrected similarity estimate by counting
unequal fields; pairs whose estimate is not clearly too low are confirmed on the full sets. Components of the confirmed
links are found with alternating star contractions.

Groups of copies are kept linear. Texts with equal sets are one class from the start. In each band bucket all members
are first compared with the smallest one only. Then only buckets that still hold several components are looked at again,
and there only pairs across components; a bucket of more than ``block`` members is dealt into blocks that meet two at a
time, so that no row holds more than about ``block`` members. Documents that are still unsettled there get a longer signature
of ``fine`` one-bit minima, so that few pairs below the similarity are left to confirm. The first such round gives the most similar pairs that span a
bucket's components, the second the eight most similar ones of every two components that confirmed links have not joined
meanwhile, the third all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import drop_scratch, pieces, scratch_mark, stored

SIGNED = "doc_id long, n int, id1 long, id2 long, signature binary, bands array<long>"
PAIR = "a long, b long"
LANE = K.LANES[0]


class Family:
    """The hash functions: minima of (code xor mask) times factor, and how they are banded and packed."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, self.size = bands, rows, bits, bands * rows
        self.masks = rng.integers(0, 2**63, self.size, dtype=np.uint64) * np.uint64(2)
        self.factors = rng.integers(0, 2**63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """(sets, functions): minima over the runs of codes that begin at heads; no run is empty."""
        out = np.empty((len(heads), self.size), dtype=np.uint64)
        for j in range(self.size):
            out[:, j] = np.minimum.reduceat((codes ^ self.masks[j]) * self.factors[j], heads)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        keyed = K.mix(minima.ravel()).reshape(-1, self.bands, self.rows)
        weights = self.factors[: self.rows]
        return K.mix(((keyed * weights).sum(axis=2) + self.masks[: self.bands]).ravel()).reshape(-1, self.bands).astype(np.int64)

    def pack(self, minima: np.ndarray) -> np.ndarray:
        """The low bits (from bit 20 on, past the multiplier's weakest) of every minimum, field by field, as bytes."""
        fields = (minima >> np.uint64(20)).astype(np.uint8)
        planes = ((fields[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1).reshape(len(minima), -1)
        padded = np.zeros((len(minima), -(-planes.shape[1] // 32) * 32), dtype=np.uint8)
        padded[:, : planes.shape[1]] = planes
        return np.packbits(padded, axis=1, bitorder="little")

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarity from packed signatures (last axis: 32-bit words): share of equal fields, less chance matches."""
        differ = a ^ b
        folded = differ.copy()
        for k in range(1, self.bits):
            folded |= differ >> np.uint32(k)
        low = np.uint32(sum(1 << i for i in range(0, 32, self.bits)))
        unequal = np.bitwise_count(folded & low).sum(axis=-1, dtype=np.int64)
        chance = 0.5**self.bits
        return (1 - unequal / self.size - chance) / (1 - chance)

    def slack(self, similarity: float, deviations: float = 4.0) -> float:
        """Estimates this far below a similarity are too unlikely to matter."""
        chance = 0.5**self.bits
        match = chance + (1 - chance) * similarity
        return deviations * (match * (1 - match) / self.size) ** 0.5 / (1 - chance)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle codes of every text, one after another, and where each set starts (one more at the end)."""
    words = K.words_of(column, K.SPACED, lower=True)
    codes, first = words.codes(LANE), words.first
    windows, _ = K.window_codes(codes, first, width, LANE)
    n_windows = np.maximum(np.diff(first) - (width - 1), 0)
    cuts = np.concatenate([[0], np.cumsum(n_windows)])
    sets = []
    for i in range(len(first) - 1):
        if n_windows[i]:
            got = np.sort(windows[cuts[i] : cuts[i + 1]])
            sets.append(got[np.concatenate([[True], got[1:] != got[:-1]])])
        elif first[i + 1] > first[i]:  # fewer words: the whole sequence is the one shingle
            whole, n = codes[first[i] : first[i + 1]], first[i + 1] - first[i]
            with np.errstate(over="ignore"):
                sets.append(K.mix(np.array([(whole * LANE.powers(LANE.window_base, int(n))).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sign(docs: DataFrame, family: Family, width: int) -> DataFrame:
    """A row per document: size and 128-bit identity of its shingle set, packed signature, band keys (none if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 18):
            ids, texts = batch.column(0), batch.column(1)
            codes, cuts = shingle_sets(texts, width)
            n = np.diff(cuts)
            full = np.flatnonzero(n)
            id1, id2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            signatures, bands = [None] * len(n), [None] * len(n)
            if len(full):
                heads = cuts[:-1][full]
                id1[full] = np.add.reduceat(K.mix(codes), heads).astype(np.int64)
                id2[full] = np.add.reduceat(K.mix(codes * np.uint64(0x9E3779B97F4A7C15)), heads).astype(np.int64)
                minima = family.minima(codes, heads)
                for i, s, k in zip(full.tolist(), family.pack(minima), family.band_keys(minima)):
                    signatures[i], bands[i] = s.tobytes(), k
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(id1), pa.array(id2), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "id1", "id2", "signature", "bands"])

    return docs.mapInArrow(run, SIGNED)


def plausible(pairs: DataFrame, sets: DataFrame, family: Family, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose estimate is not clearly below it."""
    cut = percent / 100 - family.slack(percent / 100)
    left, right = (sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array(family.estimate(a, b) >= cut)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return joined.mapInArrow(run, PAIR)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, broadcast_ids: int, load: int = 1 << 20) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity.

    Sets meet inside the JVM, so that no batch of them is built. The first member of a pair may be that of very many: its
    pairs are dealt into groups whose second members' sets have about ``load`` codes, and its set is sent once to each.
    """
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")
    few = ids.count() <= broadcast_ids  # else both sides are shuffled by id
    needed = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found, cuts = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found.view(np.int64)))], names=["doc_id", "codes"])

    sets = stored(needed.mapInArrow(codes, "doc_id long, codes array<long>"), "shingles")
    sizes = sets.select("doc_id", F.size("codes").cast("long").alias("n"))
    groups = pairs.join(sizes.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.ceil(F.sum("n") / load).cast("int").alias("k"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("group"))
    seconds = dealt.join(sets.select(F.col("doc_id").alias("b"), F.col("codes").alias("c_b")), "b")
    firsts = sets.join(groups.withColumnRenamed("a", "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("group"), F.col("codes").alias("c_a"))
    both = F.size(F.array_intersect("c_a", "c_b"))
    return seconds.join(firsts, ["a", "group"]).where(100 * both >= percent * (F.size("c_a") + F.size("c_b") - both)).select("a", "b").distinct()


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return counts.where("low > 1 or (low > 0 and high > 0)").limit(1).count() == 0


def with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the least of u and all v that u is paired with.

    A node with very many pairs meets them in 64 deals; the least is carried there by one row a deal.
    """
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(64)))
    deals = dealt.groupBy("u", "deal").agg(F.min("v").alias("m"))
    least = deals.groupBy("u").agg(F.least(F.min("m"), F.first("u")).alias("least"))
    return dealt.join(deals.join(least, "u").select("u", "deal", F.col("least").alias("m")), ["u", "deal"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every linked node: the smallest node that it reaches; by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not is_star_forest(edges):
        large = with_least(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = with_least(large.where("u != v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = stored(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def forest(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the pairs, taken in order, join what the pairs before them have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = np.zeros(len(one), dtype=bool)
    for k, (x, y) in enumerate(zip(one.tolist(), other.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x], kept[k] = y, True
    return kept


def long_signatures(ids: DataFrame, docs: DataFrame, family: Family, width: int, broadcast_ids: int) -> DataFrame:
    """(rep, signature) of the documents named by ids, under a family that is only good for estimates."""
    few = ids.count() <= broadcast_ids  # else both sides are shuffled by id
    needed = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, 1):
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                codes, cuts = shingle_sets(batch.column(1), width)
                full = np.flatnonzero(np.diff(cuts))
                packed = family.pack(family.minima(codes, cuts[:-1][full])) if len(full) else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array([x.tobytes() for x in packed], pa.binary())], names=["rep", "signature"])

    return needed.mapInArrow(run, "rep long, signature binary").dropDuplicates(["rep"])


def bucket_tasks(members: DataFrame, block: int) -> DataFrame:
    """(key, left, right, m): every two members of a bucket that carry different labels meet in one row, in no other.

    A bucket of up to ``block`` members is one row. In a larger one the members of the most frequent label and all others
    are dealt by hash into blocks of about half of ``block`` members each; a row holds two blocks, or one for its own
    pairs. Two blocks of the most frequent label never meet. first tells the members of the left block.
    """
    half = max(block // 2, 1)
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("k"))
    shape = sizes.groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "label")).alias("top")).where(F.col("all") > block)
    least_one = lambda n: F.greatest(F.ceil(n / half), F.lit(1)).cast("int")
    hot = stored(shape.select("key", F.col("top.label").alias("top"), least_one(F.col("all") - F.col("top.k")).alias("minors"), least_one(F.col("top.k")).alias("majors")), "hot")
    minors, majors = F.coalesce("minors", F.lit(1)), F.coalesce("majors", F.lit(1))
    major = F.coalesce(F.col("label") == F.col("top"), F.lit(False))
    dealt = F.xxhash64("rep")
    own = F.when(major, minors + F.pmod(dealt, majors)).otherwise(F.pmod(dealt, minors)).cast("int")
    last = F.when(major | F.col("top").isNull(), minors - 1).otherwise(minors + majors - 1)
    placed = members.join(hot, "key", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
    return placed.groupBy("key", "left", "right").agg(F.collect_list(F.struct("rep", "n", "signature", "bands", "label", (F.col("own") == F.col("left")).alias("first"))).alias("m"))


def bucket_pairs(members: DataFrame, family: Family, percent: int, block: int, most: int) -> DataFrame:
    """Pairs across components inside buckets: (a, b, more), and a row (-1, -1, true) for bucket tasks that hold more.

    members has key, rep, n, signature, bands, label. A pair counts in the bucket of the first band it shares and in no
    other. Of every two components in a bucket task the ``most`` most similar pairs are given; for ``most`` 0 only the
    most similar ones that span the task's components, so fewer than it has members.
    """
    cut = percent / 100 - family.slack(percent / 100)
    groups = bucket_tasks(members, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for key, left, right, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                rows = group.values
                rep, n, label, first = (rows.field(x).to_numpy(zero_copy_only=False) for x in ("rep", "n", "label", "first"))
                if left == right:  # all but the most frequent label's members look at larger ids and at that label's
                    names, counts = np.unique(label, return_counts=True)
                    if len(names) < 2:
                        continue
                    passive = label == names[counts.argmax()]
                elif first.all() or not first.any():
                    continue
                else:  # one block looks at the other
                    passive = first if first.sum() > len(first) / 2 else ~first
                bands = rows.field("bands").flatten().to_numpy().reshape(len(rows), -1)
                words = np.frombuffer(b"".join(rows.field("signature").to_pylist()), np.uint32).reshape(len(rep), -1)
                found = []
                for i in np.flatnonzero(~passive).tolist():
                    other = passive | (rep > rep[i]) if left == right else passive.copy()
                    other &= label != label[i]
                    other &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
                    j = np.flatnonzero(other)
                    j = j[bands[i, (bands[j] == bands[i]).argmax(axis=1)] == key] if len(j) else j
                    score = family.estimate(words[j], words[i])
                    good = score >= cut
                    found.append((np.full(int(good.sum()), i), j[good], score[good]))
                i, j, score = (np.concatenate(x) for x in zip(*found))
                one, two = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                order = np.lexsort((-score, two, one))
                new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]) if len(order) else np.zeros(0, bool)
                rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                chosen = order[rank < max(most, 1)]
                if not most:
                    chosen = chosen[np.argsort(-score[chosen], kind="stable")]
                    chosen = chosen[forest(one[chosen], two[chosen])]
                if len(chosen) < len(i):
                    out_a.append(np.array([-1]))
                    out_b.append(np.array([-1]))
                i, j = i[chosen], j[chosen]
                out_a.append(np.minimum(rep[i], rep[j]))
                out_b.append(np.maximum(rep[i], rep[j]))
            a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (out_a, out_b))
            more = pa.array((a == -1) & (b == -1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), more], names=["a", "b", "more"])

    return groups.mapInArrow(run, "a long, b long, more boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, bands: int = 28, rows: int = 4, bits: int = 2, fine: int = 2048, block: int = 2048, broadcast_ids: int = 500_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id it is linked with by any chain), kept.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a document's set holds its distinct shingles of
    ``width`` words, or its whole word sequence if it has fewer. Two documents are linked when 100 * intersection >=
    ``percent`` * union. Texts without words are linked with nothing. kept is doc_id = component_id. Rows that share an id
    count as linked; rows without an id get a null component and are kept. Other columns are ignored; an empty table gives
    no rows. A pair at exactly 75 % shares a band with probability 1 - 2.4e-5, and passes each estimate with 1 - 3.2e-5.
    """
    mark, spark = scratch_mark(), docs.sparkSession
    family = Family(bands, rows, bits)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = stored(sign(named, family, width), "signed")
    linkable = signed.where("n > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("id1", "id2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes")
    sets = classes.select("rep", "n", "signature")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader != last").drop("last")
    buckets = stored(banded.join(leaders, "key"), "buckets")

    stars = buckets.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    tried = stored(plausible(stars, sets, family, percent), "tried")
    links = stored(confirmed(tried, named, width, percent, broadcast_ids), "links")
    most, more = 0, True
    while more:
        labels = stored(components(links), "labels")
        known = buckets.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
        still = stored(known.join(mixed, "key"), "members")
        if not most:
            finer = Family(1, fine, 1, seed=6)
            named_ids = still.select(F.col("rep").alias("doc_id")).distinct()
            signatures = stored(long_signatures(stored(named_ids, "unsettled"), named, finer, width, broadcast_ids).join(classes.select("rep", "n", "bands"), "rep"), "signatures")
        found = stored(bucket_pairs(still.join(signatures, "rep"), finer, percent, block, most), "pairs")
        fresh = stored(found.where("not more").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "fresh")
        more = found.where("more").limit(1).count() > 0
        if fresh.limit(1).count():
            tried = tried.union(fresh)
            links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(confirmed(fresh, named, width, percent, broadcast_ids))
            if not more:
                labels = stored(components(links), "labels")
        most = 1 << 30 if most else 8
    reps = classes.select("id1", "id2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id1", "id2", F.coalesce("label", "rep").alias("component_id"))
    linked = linkable.select("doc_id", "n", "id1", "id2").join(reps, ["id1", "id2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    drop_scratch(spark, mark, result)
    return result


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id, all columns as they were."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
