"""Vectorised text primitives that run on Arrow batches in Python workers.

A *piece* is a run of documents of one Arrow batch with at most ``PIECE_BYTES`` of text (or one longer document),
so the memory of a worker depends on the longest document and not on the batch.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType

PIECE_BYTES = 2_000_000
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and the underline in lower case, and everything beyond ASCII; SQL: [0-9a-z_\x{80}-\x{10FFFF}]+ of lower(text)
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[95] = WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES):
    """Slices of the batch by bytes of text."""
    if not batch.num_rows:
        return
    size = np.nan_to_num(pc.binary_length(batch[text]).to_numpy(zero_copy_only=False).astype(float))
    which = (np.cumsum(size) // most).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def strings(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, start of each text and end of the last); a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, tokens before each text): maximal runs of bytes of the table that don't cross texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[buf]
    new = np.zeros(len(buf) + 1, bool)
    new[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | new[1:-1]
    end[:-1] &= ~inside[1:] | new[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, eight bytes at a time."""
    out = (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
    if not len(starts):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + 1,), strides=(1,))
    left, at, who = ends - starts, starts, None
    while True:
        lane = lanes[at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(U64))
        now = mix((out if who is None else out[who]) ^ lane)
        if who is None:
            out = now
        else:
            out[who] = now
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        left, at, who = left[more] - 8, at[more] + 8, more if who is None else who[more]


def owners(before: np.ndarray) -> np.ndarray:
    """The text of each token, from the tokens before each text."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def ngrams(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of n words; a text of 1 to n - 1 words gives one gram of all its words."""
    own = owners(before)
    salt = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
    m = max(0, len(words) - n + 1)
    gram = np.zeros(m, U64)
    for k in range(n):
        gram = (gram ^ words[k : k + m]) * salt[k % 5]
        gram ^= gram >> U64(29)
    whole = own[:m] == own[n - 1 : n - 1 + m]
    gram, who = mix(gram[whole]), own[:m][whole]
    count = np.diff(before)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(n - 1):
            there = count[short] > k
            at = before[short[there]] + k
            extra[there] = (extra[there] ^ words[at]) * salt[k % 5] + U64(1)
            extra[there] ^= extra[there] >> U64(29)
        gram, who = np.concatenate([gram, mix(extra)]), np.concatenate([who, short])
        order = np.argsort(who, kind="stable")
        gram, who = gram[order], who[order]
    return gram, who


def unique_by_owner(value: np.ndarray, own: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct (owner, value), by owner, then rank, then value. Owners must be sorted; rank must follow from the value."""
    if not len(value):
        return value, own, rank
    key = own.astype(U64) << U64(48) | value >> U64(24) if rank is None else own.astype(U64) << U64(48) | rank.astype(U64) << U64(40) | value >> U64(24)
    at = np.argsort(key)
    key, value = key[at], value[at]
    if own[-1] >= 1 << 16 or ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
        value = value[np.argsort(at)]
        at = np.lexsort((value, own) if rank is None else (value, rank, own))
        value = value[at]
    own = own[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])]
    return value[new], own[new], None if rank is None else rank[at][new]


def char_index(buf: np.ndarray) -> np.ndarray:
    """Characters that begin before each byte, and before the end."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def ready(spark: SparkSession) -> SparkSession:
    """Makes sure that checkpoint() has a folder: that of the cluster or, in local mode (tests) alone, one of our own."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id column as a long. Ids of another type are refused, as they can't be ranked or packed: map them to integers first."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType, NullType)):
        raise TypeError(f"{id_col} must be a column of integers, not of {kind.simpleString()}")
    return quoted(id_col).cast("long")


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """doc_id (long), text and the other columns asked for, by their new names."""
    return docs.select(integer_id(docs, id_col).alias("doc_id"), quoted(text_col).alias("text"), *[quoted(c).alias(n) for n, c in more.items()])


def filtered(docs: DataFrame, text_col: str, good, most: int = PIECE_BYTES) -> DataFrame:
    """The rows, in all their columns, for whose texts good(array of texts) is true; nothing is shuffled."""
    place = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def keep(batches):
        for batch in batches:
            for piece in pieces(batch, f"c{place}", most):
                yield piece.filter(pa.array(good(piece[f"c{place}"])))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def free(docs: DataFrame, name: str) -> str:
    """The name, made longer until the table has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def counts_sketch(docs: DataFrame, text: str, keys, bits: int) -> np.ndarray:
    """How often each of 2**bits buckets of hashed keys occurs in the whole table.

    keys(batch) gives the hashes of a piece. The size is fixed, so it may be sent to every executor whatever the
    input; a bucket's count is never below the count of any of its keys. Where there are far more keys than buckets, rare keys
    share a level of noise, above which frequent keys still stand out: that is all that an order by rarity needs.
    """
    block = 1 << 10
    blocks = max(1, (1 << bits) // block)

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        some, task = False, TaskContext.get().partitionId()
        for batch in batches:
            for piece in pieces(batch, text):
                h = keys(piece)
                if len(h):
                    some = True
                    total += np.bincount((h >> U64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if some:
            parts = total.reshape(blocks, -1)
            yield pa.record_batch({"block": pa.array(np.arange(blocks), pa.int32()), "task": pa.array(np.full(blocks, task, np.int32)), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(key, table):
        total = np.zeros((1 << bits) // blocks, np.int64)
        for x in table["counts"].to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    # in two steps, so that no group grows with the number of tasks beyond its square root
    schema = "block int, task int, counts binary"
    some = docs.select(F.col(text)).mapInArrow(count, schema).groupBy("block", F.expr("task div 1024").alias("part")).applyInArrow(add, schema)
    rows = some.groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros((blocks, (1 << bits) // blocks), np.uint32)
    for r in rows:
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out.reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A rank of 0 (rare) to 255 for each bucket: twice the logarithm to the base 2 of its count, which keeps a broadcast to a byte a bucket."""
    return np.minimum(255, np.floor(2 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def membership(keys: DataFrame, column: str, most: int) -> np.ndarray:
    """A bitmap with one bit set for each 64-bit key, of 16 bits a key but 2**most bits at most: one that fills up lets more through, never less.

    keys should be a checkpoint, as it is counted first.
    """
    block, bits = 1 << 15, min(most, max(20, (16 * keys.count()).bit_length()))

    def mark(key, table):
        on = np.zeros(block, bool)
        on[table["at"].to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "on": pa.array([np.packbits(on).tobytes()], pa.binary())})

    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = keys.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(F.lit(block - 1).cast("long")).alias("at")).groupBy("block").applyInArrow(mark, "block long, on binary").collect()
    out = np.zeros((1 << bits) // block * (block // 8), np.uint8)
    for r in rows:
        out[r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = np.frombuffer(bytes(r["on"]), np.uint8)
    return out


def member(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> U64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> U64(3)).astype(np.int64)] >> (7 - (at & U64(7))).astype(np.uint8)) & 1 == 1


class Seen:
    """Which keys a task has met already; it forgets all when there are too many, so that its memory is bounded and some may count as new again."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.keys = most, np.zeros(0, U64)

    def new(self, keys: np.ndarray) -> np.ndarray:
        """True at the first place of each key that wasn't met before."""
        names, first = np.unique(keys, return_index=True)
        at = np.minimum(np.searchsorted(self.keys, names), max(0, len(self.keys) - 1))
        fresh = np.ones(len(names), bool) if not len(self.keys) else self.keys[at] != names
        self.keys = np.union1d(self.keys, names[fresh]) if len(self.keys) <= self.most else names
        out = np.zeros(len(keys), bool)
        out[first[fresh]] = True
        return out


def set_keys(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A hash of the set of values of each owner, whatever their order."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values), out=total[1:])
    return mix(total[before[1:]] - total[before[:-1]] + np.diff(before).astype(U64))


def lists(values: np.ndarray, before: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(values))
