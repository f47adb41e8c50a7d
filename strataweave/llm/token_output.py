"""Token ids as a binary store: a shared zstandard dictionary, and one frame for each document.

Ids are serialised as little-endian uint16, or uint32 where the vocabulary is larger. zstd's trainer takes a bounded set
of samples by design, about a hundred times the dictionary's size. So texts count as blocks of BLOCK_CHARS characters, from
their beginning to their end, and the dictionary is trained on the serialised ids of an even sample of the blocks of all
texts: with more of them than TRAIN_BLOCKS, those whose hash is below the share that leaves about as many; blocks that
are equal count once. Everything else covers every token of every text. Each document is a frame of its own, so one short document is read
by one look-up of its shard, offset and length and is decompressed alone. Rows of kind `document` carry the frame and its
index entry; one row of kind `dictionary` carries the dictionary. dict_hash, the first 16 hexadecimal digits of the
SHA-256 of the dictionary, is on every row, and reading with another dictionary is refused.

Defined cases: null and empty texts give no tokens and the frame of an empty document; null ids stay null; repeated
rows give repeated rows. Texts without an id are sampled too. If there are too few texts to train on, the dictionary is empty and frames do without.
Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BPE_BYTES, PATTERN, VOCABULARY, Encoder, ranks
from .text import documents, pieces

TRAIN_BLOCKS = 2000
BLOCK_CHARS = 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHARD_BYTES = 64 << 20
SCHEMA = "kind string, doc_id long, shard int, offset long, length int, n_tokens int, dict_hash string, payload binary"


def train(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def sampled(docs: DataFrame, most: int, chars: int = BLOCK_CHARS) -> list[str]:
    """About that many blocks of text at most, evenly from all blocks of all texts."""
    number = F.ceil(F.length("text") / F.lit(chars)).cast("int")
    total = docs.agg(F.sum(number)).first()[0] or 0
    if not total:
        return []
    block = F.explode(F.sequence(F.lit(0), number - 1)).alias("k")
    h = F.xxhash64("text", "k")
    picked = docs.where(number > 0).select("text", block).where(F.pmod(h, F.lit(1 << 20)) < math.ceil(min(1.0, most / total) * (1 << 20)))
    part = picked.select(F.substring("text", F.col("k") * chars + 1, F.lit(chars)).alias("part")).distinct()
    return sorted(r["part"] for r in part.orderBy(F.xxhash64("part"), "part").limit(2 * most).collect())


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, train_blocks: int = TRAIN_BLOCKS, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of the store."""
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col)
    words = spark.sparkContext.broadcast(ranks(vocabulary))
    kind = np.dtype("<u2" if max(words.value.values()) < 1 << 16 else "<u4")
    chosen = sampled(docs, train_blocks)
    flat, before = Encoder(words.value, pattern).ids(pa.array(chosen, pa.string()))
    data = flat.astype(kind)
    trained = train([data[a:b].tobytes() for a, b in zip(before[:-1], before[1:])], dictionary_bytes)
    shared, name = spark.sparkContext.broadcast(trained), hashlib.sha256(trained).hexdigest()[:16]

    def frames(batches):
        import zstandard

        extra = {"dict_data": zstandard.ZstdCompressionDict(shared.value)} if shared.value else {}
        squeeze = zstandard.ZstdCompressor(level=level, **extra)
        coder, shard, at = Encoder(words.value, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text", BPE_BYTES):
                flat, before = coder.ids(piece["text"])
                raw = flat.astype(kind)
                out = [squeeze.compress(raw[a:b].tobytes()) for a, b in zip(before[:-1], before[1:])]
                length = np.array([len(x) for x in out], np.int64)
                offset = at + np.cumsum(length) - length
                at += int(length.sum())
                n = len(out)
                yield pa.record_batch([pa.array(["document"] * n), piece["doc_id"], pa.array(np.full(n, shard, np.int32)), pa.array(offset), pa.array(length.astype(np.int32)), pa.array(np.diff(before).astype(np.int32)), pa.array([name] * n), pa.array(out, pa.binary())], names=["kind", "doc_id", "shard", "offset", "length", "n_tokens", "dict_hash", "payload"])

    head = spark.createDataFrame([("dictionary", None, None, None, len(trained), None, name, bytearray(trained))], SCHEMA)
    return docs.mapInArrow(frames, SCHEMA).union(head)


def read_tokens(payload: bytes, dictionary: bytes, dict_hash: str, wide: bool = False) -> np.ndarray:
    """The ids of one document, from its frame."""
    import zstandard

    if hashlib.sha256(dictionary).hexdigest()[:16] != dict_hash:
        raise ValueError("the frame was written with another dictionary")
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return np.frombuffer(zstandard.ZstdDecompressor(**extra).decompress(payload), "<u4" if wide else "<u2")


def shards(store: DataFrame, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, start and data: the frames of each shard one after the other, where offset and length find them, in blocks of about that many bytes at most.

    A block begins and ends with whole frames, so the document at an offset is in the last block that starts there or before.
    """

    def joined(batches):
        held: list[bytes] = []
        at = size = 0
        shard = None

        def block():
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "start": pa.array([at], pa.int64()), "data": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for k, offset, frame in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "payload"))):
                if held and (k != shard or size + len(frame) > most_bytes):
                    yield block()
                    held.clear()
                if not held:
                    shard, at, size = k, offset, 0
                held.append(frame)
                size += len(frame)
        if held:
            yield block()

    rows = store.where("kind = 'document'").select("shard", "offset", "payload").repartition("shard").sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(joined, "shard int, start long, data binary")
