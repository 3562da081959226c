"""Token-id files with a shared zstandard dictionary.

File format (Parquet containers, so that Spark reads and writes them in any store):

* ``dictionary``: one row (dict_hash, width, dictionary). The dictionary is trained once
  on the serialized id arrays of at most ``sample_docs`` documents, those of the least hash
  over the whole table, of each at most its share of ``sample_bytes``.
* ``blocks``: rows of up to 4 MB, sorted by doc_id over all files. A block holds the
  frames of its documents one after the other (each document is compressed on its own),
  the byte offset of every frame, the doc_ids, the token counts and the dictionary's hash.

One document is read by a pushed-down filter on the blocks' doc_id range, one slice of
the payload and one decompression. A reader refuses a block whose hash is not that of the
dictionary at hand.

Ids are stored as unsigned 16-bit little-endian if the vocabulary fits, else 32-bit.
Defined cases: a null text is empty and holds the end id alone; null doc_ids come first;
rows that repeat a doc_id are stored each, next to each other; an empty table gives an
empty store; other columns are not looked at.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import slices, slim
from .tokens import END_ID, encoder

BLOCK_BYTES, BLOCK_DOCS, LEVEL = 4 << 20, 4096, 1
_BLOCK = ("shard int, block int, dict_hash string, first_doc {id}, last_doc {id}, doc_ids array<{id}>, "
          "n_tokens array<long>, offsets array<long>, payload binary")


def serialized(raw: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids in ``width`` bytes each."""
    return np.frombuffer(raw, "<u4").astype("<u2").tobytes() if width == 2 else raw


def width_of(tokenizer: str | None) -> int:
    return 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary; the samples' own bytes if they are too few to train on."""
    import zstandard
    pieces = [s[i:i + 8192] for s in samples for i in range(0, len(s), 8192)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def sample_ids(docs: DataFrame, tokenizer: str | None, width: int, sample_docs: int, sample_bytes: int) -> list[bytes]:
    """Serialized ids of the ``sample_docs`` documents whose doc_id and text have the least
    hashes in the whole table; of each its share of ``sample_bytes`` at most."""
    end, most = np.uint32(END_ID).tobytes(), max(sample_bytes // sample_docs, 4) // 4 * 4

    def kernel(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialized(raw + end, width)[:most] for raw in encoder(tokenizer).encode_all(b.column(0).to_pylist())], pa.binary())], ["ids"])
    h = F.xxhash64("doc_id", "text")
    limit = docs.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]  # hashes alone are sorted
    chosen = docs.where(h <= F.lit(limit)).select("text").limit(sample_docs)
    return [bytes(r["ids"]) for r in chosen.repartition(8).mapInArrow(kernel, "ids binary").toLocalIterator()]


def frames(docs: DataFrame, tokenizer: str | None, width: int, dictionary: bytes) -> DataFrame:
    """(doc_id, n_tokens, frame) per row of ``docs``: its ids with the end id, compressed."""
    end, kind = np.uint32(END_ID).tobytes(), docs.schema["doc_id"].dataType.simpleString()

    def kernel(batches):
        import zstandard
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        encode = encoder(tokenizer).encode_all
        for b in (part for whole in batches for part in slices(whole, 1)):
            raws = [raw + end for raw in encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) // 4 for r in raws], pa.int64()),
                                              pa.array([press.compress(serialized(r, width)) for r in raws], pa.binary())], ["doc_id", "n_tokens", "frame"])
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {kind}, n_tokens long, frame binary")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, sample_docs: int = 1000,
                sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every whole text where it is read, and write the store below ``path`` in
    doc_id order: only compressed frames are shuffled."""
    spark, d = docs.sparkSession, slim(docs, id_col, text_col)
    width = width_of(tokenizer)
    dictionary = train_dictionary(sample_ids(d, tokenizer, width, sample_docs, sample_bytes))
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(dictionary))], "dict_hash string, width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    kind = d.schema["doc_id"].dataType.simpleString()
    single = written(frames(d, tokenizer, width, dictionary), "frames", "uncompressed")

    def kernel(batches):
        ids, counts, held, size, block = [], [], [], 0, 0
        names = ["shard", "block", "dict_hash", "first_doc", "last_doc", "doc_ids", "n_tokens", "offsets", "payload"]

        def flush(shard, id_type):
            ends = np.cumsum([0, *map(len, held)])
            known = [i for i in ids if i is not None]
            row = [shard, block, digest, min(known, default=None), max(known, default=None), ids, counts, ends.tolist(), b"".join(held)]
            kinds = [pa.int32(), pa.int32(), pa.string(), id_type, id_type, pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)
        shard, id_type = None, None
        for b in batches:
            id_type = b.schema.field(0).type
            for i, n, frame, shard in zip(*(b.column(c).to_pylist() for c in range(4))):
                ids.append(i)
                counts.append(n)
                held.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush(shard, id_type)
                    ids, counts, held, size, block = [], [], [], 0, block + 1
        if ids:
            yield flush(shard, id_type)

    # rows of one doc_id, or of none, are parted by a hash of their frame
    tied = single.withColumn("tie", F.xxhash64("frame"))
    ordered = tied.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n_tokens", "frame", F.spark_partition_id().alias("shard"))
    ordered.mapInArrow(kernel, _BLOCK.format(id=kind)).write.parquet(f"{path}/blocks", compression="uncompressed")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    return r["dict_hash"], r["width"], bytes(r["dictionary"])


def _frames(b: pa.RecordBatch, digest: str, dictionary: bytes, wanted: set | None = None):
    """(row, place, doc_id, raw ids) of the documents in a batch of blocks."""
    import zstandard
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for row in range(len(b)):
        if b.column("dict_hash")[row].as_py() != digest:
            raise ValueError("the block was written with another dictionary")
        payload, offsets = memoryview(b.column("payload")[row].as_buffer()), b.column("offsets")[row].as_py()
        for place, i in enumerate(b.column("doc_ids")[row].as_py()):
            if wanted is None or i in wanted:
                yield row, place, i, unpress.decompress(payload[offsets[place]:offsets[place + 1]])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files: every frame is
    decompressed. start is the number of ids of all documents before it."""
    digest, width, dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["first_doc"].dataType.simpleString()

    def kernel(batches):
        for b in batches:
            out = []
            for row, _, i, raw in _frames(b, digest, dictionary):
                raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw
                out.append((row, i, len(raw) // 4, zlib.crc32(raw)))
            rows, ids, n, crc = zip(*out) if out else [()] * 4
            n, at = np.array(n, np.int64), pa.array(rows, pa.int64())
            before = np.cumsum(n) - n
            first = np.concatenate([[True], np.diff(rows) > 0]) if len(rows) else np.empty(0, bool)
            before -= np.repeat(before[first], np.diff([*np.flatnonzero(first), len(n)])) if len(n) else 0
            yield pa.RecordBatch.from_arrays([b.column("shard").take(at), b.column("block").take(at), pa.array(ids, b.schema.field("first_doc").type),
                                              pa.array(before), pa.array(n), pa.array(crc, pa.int64())],
                                             ["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32"])
    docs = blocks.mapInArrow(kernel, f"shard int, block int, doc_id {kind}, before long, n_tokens long, ids_crc32 long")
    total = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = total.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", earlier(Window.orderBy("shard")).alias("shards"))  # a row per file
    base = total.select("shard", "block", earlier(Window.partitionBy("shard").orderBy("block")).alias("blocks")).join(shards, "shard")
    return docs.join(base, ["shard", "block"]).select("doc_id", (F.col("shards") + F.col("blocks") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: only blocks whose range may hold one are read,
    and of those only the asked frames are decompressed."""
    digest, width, dictionary = _dictionary(spark, path)
    blocks, wanted = spark.read.parquet(f"{path}/blocks"), set(doc_ids)
    kind = blocks.schema["first_doc"].dataType.simpleString()
    may = F.lit(False)
    for i in sorted(wanted):
        may = may | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))

    def kernel(batches):
        for b in batches:
            got = [(i, np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.int64).tolist()) for _, _, i, raw in _frames(b, digest, dictionary, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], b.schema.field("first_doc").type), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])
    return blocks.where(may).mapInArrow(kernel, f"doc_id {kind}, ids array<long>")
