"""Token-id shards with Elias-Fano document boundaries.

A shard is one binary value, the image of one file:

    header   magic "EFID", format 1, id width in bytes, low-bit width; then as 64-bit integers: documents, null
             document ids, ids, first document id, and the byte lengths of the five sections
    docs     differences of ascending document ids, variable-length bytes
    low      the low bits of all boundaries, packed
    high     the high parts of all boundaries in unary: boundary i sets bit (value >> low-bit width) + i
    select   bit positions of every 256th boundary as 32-bit integers
    ids      the concatenated ids, little-endian, 2 or 4 bytes each

There are documents + 1 boundaries, the first being 0. They take about 2 + log2(ids / documents) bits each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import pieces, scratch_path, shuffle_partitions, text_bytes
from folioflow.llm.textkernels import pack_sorted, unpack_sorted
from folioflow.llm.wordbpe import chunk_ids
from folioflow.operators.scans import running

HEAD = struct.Struct("<4sBBBx" + "q" * 9)
EVERY = 256
SHARDS = "part int, seq int, n_docs long, n_ids long, image binary"


def pack_boundaries(bounds: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Low-bit width, low bits, high bits and select samples of non-decreasing boundaries."""
    width = max(0, int(max(1, int(bounds[-1])) // len(bounds)).bit_length() - 1)
    low = ((bounds[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    at = (bounds >> width) + np.arange(len(bounds))
    high = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
    high[at] = 1
    return width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::EVERY].astype("<u4").tobytes()


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], sizes: list[int], dtype: np.dtype) -> bytes:
    """The image of a shard: document ids (ascending, nulls first), all their ids in any runs, and how many each has."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    width, low, high, select = pack_boundaries(bounds)
    docs = pack_sorted(known - known[0]) if len(known) else b""
    body = np.concatenate([*ids, np.zeros(0, dtype)]).astype(dtype).tobytes()
    parts = [docs, low, high, select, body]
    return HEAD.pack(b"EFID", 1, dtype.itemsize, width, len(doc_ids), len(doc_ids) - len(known), int(bounds[-1]), int(known[0]) if len(known) else 0, *map(len, parts)) + b"".join(parts)


class Shard:
    """Random access to a shard image."""

    def __init__(self, image: bytes):
        magic, form, width, self.width, self.n_docs, self.n_null, self.n_ids, self.first, *sizes = HEAD.unpack_from(image)
        if magic != b"EFID" or form != 1 or HEAD.size + sum(sizes) != len(image):
            raise ValueError("not a whole shard image")
        cuts = HEAD.size + np.concatenate([[0], np.cumsum(sizes)])
        docs, self.low, self.high, select, body = (image[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        self.doc_ids = [None] * self.n_null + (unpack_sorted(docs) + self.first).tolist()
        self.low_bytes, self.high_bytes = np.frombuffer(self.low, np.uint8), np.frombuffer(self.high, np.uint8)
        self.samples = np.frombuffer(select, "<u4")
        self.ids = np.frombuffer(body, f"<u{width}")

    def block(self, i: int) -> np.ndarray:
        """Boundaries i * 256 and following, up to 256 of them: from one select sample to the next, then their low bits."""
        first, last = i * EVERY, min((i + 1) * EVERY, self.n_docs + 1)
        begin = int(self.samples[i])
        end = int(self.samples[i + 1]) if i + 1 < len(self.samples) else 8 * len(self.high_bytes)
        bits = np.unpackbits(self.high_bytes[begin >> 3 : (end + 7) >> 3], bitorder="little")
        at = np.flatnonzero(bits[begin & 7 :])[: last - first] + begin
        places = np.arange(first * self.width, last * self.width)
        low = (self.low_bytes[places >> 3] >> (places & 7) & 1).reshape(last - first, self.width)
        return ((at - np.arange(first, last)) << self.width) + low.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def boundary(self, i: int) -> int:
        """Ids before document i, by the select structure."""
        return int(self.block(i // EVERY)[i % EVERY])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundary(i) : self.boundary(i + 1)]

    def spans(self) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of documents in order: the first one's number, and boundaries from its begin to the last one's end."""
        last = np.zeros(0, np.int64)
        for i in range(len(self.samples)):
            bounds = np.concatenate([last, self.block(i)])
            if len(bounds) > 1:
                yield max(i * EVERY - 1, 0), bounds
            last = bounds[-1:]


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20, part_bytes: int = 16 << 20) -> None:
    """Encode whole texts, end each with ``end_id``, and write shards of about ``shard_ids`` ids in ascending id order.

    The table at ``path`` has a row per shard (part, seq, n_docs, n_ids, image); (part, seq) is the order. A null or
    empty text is one end id; null ids come first; rows that share an id are separate documents. A document is never
    cut. An empty table gives no shards. Other columns are ignored. Ranges are cut by id and then by a hash of the text, so
    that rows that share an id or have none are spread too.
    """
    spark = docs.sparkSession
    n = max(shuffle_partitions(spark), -(-text_bytes(docs, text_col) // part_bytes), 1)
    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    dealt = docs.select(*columns).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, store = TaskContext.get().partitionId(), chunk_ids(tokenizer_path)
        names, ids, sizes, held, seq = [], [], [], 0, 0
        end = np.array([end_id], store.dtype)

        def flush():
            image = write_shard(names, ids, sizes, store.dtype)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "image"])

        for batch in pieces(batches, 1):
            found, cuts = store.encode(batch.column(1))
            for name, a, b in zip(batch.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                names.append(name)
                ids += [found[a:b], end]
                sizes.append(b - a + 1)
                held += b - a + 1
                if held >= shard_ids:
                    yield flush()
                    names, ids, sizes, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    dealt.mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """A row per document from the stored shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Boundaries come from the select structure, 256 documents at a time. Shards' bases are running sums in slices of
    parts, so that no task sums over all shards.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("all", F.lit(0))
    bases = running(totals, ["all"], "part", 1024, base=("sum_before", F.col("n_ids"))).select("part", "base")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "seq", inside.alias("inside")).join(bases, "part").select("part", "seq", (F.col("base") + F.col("inside")).cast("long").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, image = (batch.column(i)[row].as_py() for i in range(3))
                shard = Shard(image)
                for first, bounds in shard.spans():
                    n = len(bounds) - 1
                    crc = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids[first : first + n], pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "image").mapInArrow(read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Write the shards of a corpus to the shared folder and read its documents' rows back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_token_shards(docs, tokenizer_path, end_id, path, **options)
    return read_token_shards(spark.read.schema(SHARDS).parquet(path))
