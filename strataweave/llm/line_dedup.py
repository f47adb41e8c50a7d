"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words (letters, digits and underlines in lower case). The words of a line are ordered by
rarity, counted over the whole table. Two different sets whose Jaccard similarity reaches the threshold share a word
within short prefixes of that order; prefix, length and position filters cut the pairs that can't reach it, and so does
the parity of the words in each of 64 classes, as two sets differ in a word at least for each class in which it
differs. The rest are verified on their whole sets. Equal sets need no join. A line goes if an earlier line, by (doc_id, number of
the line), has an equal or a similar set.

Defined cases: a row whose doc_id or text is null, an empty text and a line without words neither go nor make others
go. Rows that repeat a doc_id are one document: lines of the same id and number aren't compared with each other.
Ties can't occur, as (doc_id, line) orders all lines. Extra columns are left alone. Sets are named by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import U64, WORD, Seen, counts_sketch, documents, free, hashes, integer_id, lists, member, membership, owners, pieces, quoted, rarity, ready, set_keys, signed, spans, strings, unique_by_owner

THRESHOLD = 0.9
SKETCH_BITS = 20
BITMAP_BITS = 28


def parity(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """64 bits for each owner: whether it has an odd number of values whose last six bits say so."""
    out = np.zeros(len(before) - 1, U64)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        out[some] = np.bitwise_xor.reduceat(U64(1) << (values & U64(63)), before[some])
    return out


def line_words(piece: pa.RecordBatch, text: str):
    """(hashes of the words of all lines, words before each line, document of each line, number of each line)."""
    buf, off = strings(piece[text], lower=True)
    ends = np.flatnonzero(buf == 10) + 1
    at = np.concatenate([off[:-1], ends])
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, ends - 1, "right") - 1])
    order = np.lexsort((at, doc))
    at, doc = at[order], doc[order]
    starts, stops, before = spans(buf, np.append(at, off[-1]), WORD)
    return hashes(buf, starts, stops), before, doc, np.arange(len(doc)) - np.searchsorted(doc, doc)


def line_sets(piece: pa.RecordBatch, text: str, ranks: np.ndarray | None = None):
    """(words of each line without repetition, by rarity if ranks are given; words before each line; document; number of the line)."""
    words, before, doc, number = line_words(piece, text)
    rank = None if ranks is None else ranks[(words >> U64(64 - len(ranks).bit_length() + 1)).astype(np.int64)]
    words, own, _ = unique_by_owner(words, owners(before), rank)
    return words, np.searchsorted(own, np.arange(len(doc) + 1)), doc, number


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """The lines that go: doc_id, line (from 0), kept_doc_id and kept_line of the earliest match, jaccard."""
    spark = ready(docs.sparkSession)
    docs = documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    # a set that small has no similar set but an equal one
    least = next(n for n in range(1, 1 << 20) if math.floor(n / threshold + 1e-9) > n or (n - 1) / (n + 1) >= threshold - 1e-12 or (n - 1) / n >= threshold - 1e-12)
    ranks = spark.sparkContext.broadcast(rarity(counts_sketch(docs, "text", lambda p: line_words(p, "text")[0], sketch_bits)))

    def entries(batches):
        seen = Seen()
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, before, _, _ = line_sets(piece, "text", ranks.value)
                n, key = np.diff(before), set_keys(words, before)
                use = seen.new(key) & (n >= least)
                length = np.where(use, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
                line = np.repeat(np.arange(len(n)), length)
                pos = np.arange(len(line)) - (np.cumsum(length) - length)[line]
                yield pa.record_batch({"word": pa.array(signed(words[before[line] + pos])), "s": pa.array(signed(key[line])), "meta": pa.array(n[line] << 31 | pos), "mask": pa.array(signed(parity(words, before)[line]))})

    entry = docs.select("text").mapInArrow(entries, "word long, s long, meta long, mask long").repartition("word").dropDuplicates(["word", "s", "meta", "mask"])
    n, pos = (lambda a: F.shiftright(f"{a}.meta", 31)), (lambda a: F.col(f"{a}.meta").bitwiseAND(F.lit((1 << 31) - 1).cast("long")))
    short = entry.where(F.expr(f"(meta & {(1 << 31) - 1}L) < shiftright(meta, 31) - ceil({2 * threshold / (1 + threshold)!r}D * shiftright(meta, 31) - 1e-9D) + 1"))
    pairs = (
        short.alias("a")
        .join(entry.alias("b"), F.col("a.word") == F.col("b.word"))
        .where((n("a") < n("b")) | ((n("a") == n("b")) & (F.col("a.s") < F.col("b.s"))))
        .where(n("a") >= F.lit(threshold) * n("b") - 1e-9)
        .where(F.least(n("a") - pos("a"), n("b") - pos("b")) >= F.lit(threshold / (1 + threshold)) * (n("a") + n("b")) - 1e-9)
        .where(F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= F.lit((1 - threshold) / (1 + threshold)) * (n("a") + n("b")) + 1e-9)
        .select(F.col("a.s").alias("sa"), F.col("b.s").alias("sb"))
        .distinct()
        .checkpoint()
    )
    wanted = spark.sparkContext.broadcast(membership(pairs.select(F.explode(F.array("sa", "sb")).alias("s")), "s", bitmap_bits))

    def names(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, before, doc, number = line_sets(piece, "text")
                at = np.flatnonzero(np.diff(before))
                yield pa.record_batch({"s": pa.array(signed(set_keys(words, before)[at])), "doc_id": piece["doc_id"].take(pa.array(doc[at])), "line": pa.array(number[at].astype(np.int32))})

    def members(batches):
        seen = Seen()
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, before, _, _ = line_sets(piece, "text")
                key = set_keys(words, before)
                some = np.flatnonzero(np.diff(before))
                some = some[member(wanted.value, key[some])]
                at = some[seen.new(key[some])]
                yield pa.record_batch({"s": pa.array(signed(key[at])), "words": lists(signed(words), before).take(pa.array(at))})

    line = docs.mapInArrow(names, "s long, doc_id long, line int").checkpoint()
    # a line that is everywhere has one first place, found by partial aggregation; joining it back is split where it is skewed
    first = line.groupBy("s").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    word = docs.select("text").mapInArrow(members, "s long, words array<long>").dropDuplicates(["s"])
    sets = word.join(first, "s").checkpoint()
    shared = F.size(F.array_intersect("wa", "wb"))
    similar = (
        pairs.join(sets.select(F.col("s").alias("sa"), F.col("first").alias("fa"), F.col("words").alias("wa")), "sa")
        .join(sets.select(F.col("s").alias("sb"), F.col("first").alias("fb"), F.col("words").alias("wb")), "sb")
        .withColumn("jaccard", shared / (F.size("wa") + F.size("wb") - shared))
        .where(F.col("jaccard") >= threshold - 1e-9)
    )
    other = similar.select(F.inline(F.array(F.struct(F.col("sa").alias("s"), F.col("fb").alias("first"), "jaccard"), F.struct(F.col("sb").alias("s"), F.col("fa").alias("first"), "jaccard"))))
    other = other.groupBy("s").agg(F.min(F.struct("first", "jaccard")).alias("other"))
    known = first.join(other, "s", "left").select("s", F.col("first").alias("same"), "other")
    best = F.when(F.col("other.first") < F.col("same"), F.col("other")).otherwise(F.struct(F.col("same").alias("first"), F.lit(1.0).alias("jaccard")))
    return (
        line.join(known, "s")
        .withColumn("best", best)
        .where(F.col("best.first") < F.struct("doc_id", "line"))
        .select("doc_id", "line", F.col("best.first.doc_id").alias("kept_doc_id"), F.col("best.first.line").alias("kept_line"), F.col("best.jaccard").alias("jaccard"))
        .distinct()
    )


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents without their removed lines. A document that loses lines and has no visible character left goes."""
    own, lost, new = (free(docs, name) for name in ("own_id", "lost_lines", "new_text"))
    gone = removed.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line").alias(lost))
    kept = F.array_join(F.filter(F.split(quoted(text_col), "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    out = docs.join(gone, integer_id(docs, id_col) == F.col(own), "left").withColumn(new, F.when(F.col(lost).isNotNull(), kept).otherwise(quoted(text_col)))
    out = out.where(F.col(lost).isNull() | F.col(new).rlike(r"\S"))

    def column(c, kind):
        if c == text_col:
            return F.col(new).alias(c)
        if c == chars_col:
            return F.when(F.col(lost).isNotNull(), F.length(new)).otherwise(quoted(c)).cast(kind).alias(c)
        return quoted(c)

    return out.select(*[column(c, kind) for c, kind in docs.dtypes])
